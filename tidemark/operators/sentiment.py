"""A five-part market sentiment index, causally normalised, its tests, and exposure rules.

Series hold one row per trading date (a few thousand), so windows over dates are partitioned by series
name where there are several and by nothing where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.stats import by_ticker, causal_percentile, pearson, rolling, with_bucket

#: lower bounds of the regimes (fixed values)
REGIMES = ((25.0, "extreme fear"), (45.0, "fear"), (55.0, "neutral"), (75.0, "greed"))
HIGHEST = "extreme greed"
COMPONENTS = ("volatility", "credit", "safe_haven", "momentum", "breadth")


def dates():
    """All rows in date order."""
    return Window.orderBy("date")


def _series(proxies: DataFrame, name: str) -> DataFrame:
    """date, x of one proxy, on its own dates."""
    return proxies.where((F.regexp_replace("name", r"^\^", "") == name) & F.col("px").isNotNull()).select("date", F.col("px").alias("x"))


def _percentile(df: DataFrame, value: Column, name: str, window: int, least: int, flip: bool = False) -> DataFrame:
    rows = df.withColumn("__v", value)
    p = causal_percentile(F.col("__v"), window, least, dates())
    return rows.select("date", F.lit(name).alias("component"), (100 - p if flip else p).alias("value"))


def _relative(proxies: DataFrame, a: str, b: str, back: int) -> tuple[DataFrame, Column]:
    """Growth over `back` own rows of one proxy less the other's, on the dates of either."""
    parts = [_series(proxies, n).withColumn("g", F.try_divide(F.col("x"), F.lag("x", back).over(dates()))).select("date", F.col("g").alias(k)) for n, k in ((a, "ga"), (b, "gb"))]
    return parts[0].join(parts[1], "date", "full"), F.col("ga") - F.col("gb")


def component(proxies: DataFrame, name: str, grid: DataFrame | None = None, membership: DataFrame | None = None, window: int = SETTINGS.norm_window, least: int = SETTINGS.norm_min, spans: dict[str, int] | None = None) -> DataFrame:
    """date, component, value (0 to 100, high is greedy)."""
    span = {"volatility": 50, "credit": 20, "safe_haven": 20, "momentum": 125, "breadth": 200, **(spans or {})}[name]
    if name == "volatility":
        s = _series(proxies, "VIX")
        return _percentile(s, F.try_divide(F.col("x"), rolling(F.avg, F.col("x"), span, span // 2, dates())), name, window, least, flip=True)
    if name == "credit":
        s, v = _relative(proxies, "HYG", "LQD", span)
        return _percentile(s, v, name, window, least)
    if name == "safe_haven":
        s, v = _relative(proxies, "SPY", "TLT", span)
        return _percentile(s, v, name, window, least)
    if name == "momentum":
        s = _series(proxies, "SPY")
        return _percentile(s, F.try_divide(F.col("x"), rolling(F.avg, F.col("x"), span, span // 2, dates())), name, window, least)
    if name == "breadth":
        return _percentile(breadth(grid, span, membership), F.col("breadth"), name, window, least)
    raise ValueError(f"unknown component {name!r}")


def breadth(grid: DataFrame, span: int = 200, membership: DataFrame | None = None) -> DataFrame:
    """date, breadth: percent of names above their rolling mean; of members, priced or not, if a membership is given."""
    above = F.coalesce(F.col("close") > rolling(F.avg, F.col("close"), span, span // 2, by_ticker()), F.lit(False))
    x = grid.withColumn("__a", above)
    counts = F.col("close").isNotNull()
    if membership is not None:
        x = x.join(membership.select("date", "ticker").distinct().withColumn("__m", F.lit(True)), ["date", "ticker"], "left")
        counts = F.coalesce(F.col("__m"), F.lit(False))
    share = F.try_divide(F.sum((F.col("__a") & counts).cast("double")), F.sum(counts.cast("double")))
    return x.groupBy("date").agg((100 * share).alias("breadth"))


def index(proxies: DataFrame, grid: DataFrame | None = None, membership: DataFrame | None = None, **kw) -> DataFrame:
    """date, the components, composite (mean of those there are), n_components."""
    names = [c for c in COMPONENTS if c != "breadth" or grid is not None]
    parts = component(proxies, names[0], grid, membership, **kw)
    for c in names[1:]:
        parts = parts.unionByName(component(proxies, c, grid, membership, **kw))
    wide = parts.groupBy("date").pivot("component", names).agg(F.first("value"))
    n = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0))
    return wide.withColumn("n_components", n).withColumn("composite", F.try_divide(total, F.col("n_components")))


def label(value: Column) -> Column:
    out = F.when(value.isNull(), "unavailable")
    for bound, name in REGIMES:
        out = out.when(value < bound, name)
    return out.otherwise(HIGHEST)


def regimes(sentiment: DataFrame) -> DataFrame:
    """Share of the dated composites in each regime."""
    rows = sentiment.where("composite is not null").groupBy(label(F.col("composite")).alias("regime")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def describe(sentiment: DataFrame, names: tuple[str, ...] = (*COMPONENTS, "composite")) -> DataFrame:
    """component, n, mean, std, low, high."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in names]))
    return sentiment.select(rows.alias("x")).select("x.*").groupBy("component").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def correlation(sentiment: DataFrame, names: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """a, b, corr on the dates that have both."""
    pairs = [(a, b) for a in names for b in names]
    row = sentiment.agg(*[pearson(F.col(a), F.col(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def exposure(composite: Column, direction: str = "contrarian", floor: float = 0.5, ceiling: float = 1.5) -> Column:
    """A multiplier between floor and ceiling: high when others are fearful (contrarian) or greedy (momentum)."""
    if direction not in ("contrarian", "momentum"):
        raise ValueError(f"unknown direction {direction!r}")
    share = F.when(composite.isNotNull(), F.least(F.greatest(composite, F.lit(0.0)), F.lit(100.0)) / 100)
    return floor + (1 - share if direction == "contrarian" else share) * (ceiling - floor)


def joint(sentiment: DataFrame, market: DataFrame) -> DataFrame:
    """date, composite, px on the dates that have both."""
    return sentiment.select("date", "composite").join(market.select("date", "px"), "date").where("composite is not null and px is not null")


def forward(rows: DataFrame, horizon: int) -> DataFrame:
    """+ fwd: the return over `horizon` joint rows from the next row on, which is the first that can be traded."""
    return rows.withColumn("fwd", F.try_divide(F.lead("px", 1 + horizon).over(dates()), F.lead("px", 1).over(dates())) - 1).where("fwd is not null")


def predictive_stats(sentiment: DataFrame, market: DataFrame, horizon: int, buckets: int = 5, least: int = 200) -> DataFrame:
    """One row (none under `least` dates): n, slope, r2, corr, and yearly mean return in the lowest and highest bucket, low less high."""
    x = with_bucket(forward(joint(sentiment, market), horizon), "composite", buckets, (), "b")
    top = x.agg(F.max("b").alias("top"))
    year = SETTINGS.periods_per_year / horizon
    out = x.crossJoin(F.broadcast(top)).agg(
        F.count("*").alias("n"),
        F.regr_slope("fwd", "composite").alias("slope"),
        F.regr_r2("fwd", "composite").alias("r2"),
        pearson(F.col("composite"), F.col("fwd")).alias("corr"),
        (F.avg(F.when(F.col("b") == 0, F.col("fwd"))) * year).alias("low_ann"),
        (F.avg(F.when(F.col("b") == F.col("top"), F.col("fwd"))) * year).alias("high_ann"),
    )
    return out.where(F.col("n") >= least).select(F.lit(horizon).alias("horizon"), "*", (F.col("low_ann") - F.col("high_ann")).alias("spread_ann"))


def coincident(sentiment: DataFrame, market: DataFrame, window: int = 21) -> DataFrame:
    """One row: correlation with the return of the past and of the coming `window` rows, on dates that have both."""
    x = joint(sentiment, market)
    past = F.try_divide(F.col("px"), F.lag("px", window).over(dates())) - 1
    ahead = F.try_divide(F.lead("px", 1 + window).over(dates()), F.lead("px", 1).over(dates())) - 1
    x = x.withColumns({"past": past, "ahead": ahead}).where("past is not null and ahead is not null")
    return x.agg(pearson(F.col("composite"), F.col("past")).alias("trailing_corr"), pearson(F.col("composite"), F.col("ahead")).alias("forward_corr"), F.count("*").alias("n"))


def timed_market(market: DataFrame, scaler: DataFrame | None, cost_bps: float = SETTINGS.cost_bps) -> DataFrame:
    """date, w, gross, cost, net of holding the market at a weekly set exposure, traded the day after; 1 before any."""
    from ..sources.panels import friday_of

    x = market.where("px is not null").select("date", "px").withColumn("ret", F.try_divide(F.col("px"), F.lag("px").over(dates())) - 1)
    if scaler is None:
        x = x.withColumn("w", F.lit(1.0))
    else:
        upto = dates().rowsBetween(Window.unboundedPreceding, 0)
        daily = x.join(scaler.select("date", "exposure"), "date", "left").withColumn("exposure", F.last("exposure", True).over(upto))
        weeks = daily.groupBy(friday_of(F.col("date")).alias("date")).agg(F.max_by("exposure", F.when(F.col("exposure").isNotNull(), F.col("date"))).alias("e"))
        x = x.join(weeks, "date", "left").withColumn("e", F.last("e", True).over(upto))
        x = x.withColumn("w", F.coalesce(F.lag("e").over(dates()), F.lit(1.0))).drop("e")
    x = x.withColumn("gross", F.coalesce(F.col("w") * F.col("ret"), F.lit(0.0)))
    x = x.withColumn("cost", F.coalesce(F.abs(F.col("w") - F.lag("w").over(dates())), F.lit(0.0)) * cost_bps / 1e4)
    return x.select("date", "w", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"))


def fallback_market(proxies: DataFrame | None, grid: DataFrame | None) -> DataFrame:
    """date, px: SPY if there is one, else the mean close of all names."""
    if proxies is not None:
        spy = _series(proxies, "SPY").select("date", F.col("x").alias("px"))
        if spy.limit(1).count():
            return spy
    return grid.groupBy("date").agg(F.avg("close").alias("px")).where("px is not null")
