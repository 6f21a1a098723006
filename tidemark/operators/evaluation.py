"""Signal evaluation: information coefficients, decay, quantile returns, turnover, correlations, league table.

Long scores (date, ticker, signal, score) meet long forward returns (date, ticker, horizon, fwd) once;
every statistic of every signal and horizon is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, newey_west_lags
from ..functions.stats import average_rank, by_ticker, mean_t, pearson, two_sided, with_bucket
from . import prices

YEAR = SETTINGS.periods_per_year


def information_coefficient(scores: DataFrame, fwd: DataFrame, method: str = "spearman", least: int = SETTINGS.min_names, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """date, signal, horizon, ic, n for dates with at least `least` joint names and some variance.

    Spearman ranks each side among all its own values of the date, before names are matched. With the
    horizons named, they lie side by side, so a score meets its name's forward returns once.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")
    x, y = scores.select("date", "ticker", "signal", F.col("score").alias("x")), fwd.select("date", "ticker", "horizon", F.col("fwd").alias("y"))
    if method == "spearman":
        x = x.withColumn("x", average_rank(F.col("x"), "signal", "date"))
        y = y.withColumn("y", average_rank(F.col("y"), "horizon", "date"))
    x, y = x.where("x is not null"), y.where("y is not null")
    if horizons is None:
        per = x.join(y, ["date", "ticker"]).groupBy("date", "signal", "horizon").agg(pearson(F.col("x"), F.col("y"), least).alias("ic"), F.count("*").alias("n"))
    else:
        wide = y.groupBy("date", "ticker").agg(*[F.max(F.when(F.col("horizon") == h, F.col("y"))).alias(f"y{h}") for h in horizons])
        sides = x.join(wide, ["date", "ticker"]).groupBy("date", "signal").agg(*[c for h in horizons for c in (pearson(F.col("x"), F.col(f"y{h}"), least).alias(f"c{h}"), F.count(f"y{h}").alias(f"n{h}"))])
        cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"c{h}").alias("ic"), F.col(f"n{h}").alias("n")) for h in horizons]))
        per = sides.select("date", "signal", cells.alias("x")).select("date", "signal", "x.*")
    return per.where("ic is not null")


def ic_summary(ic: DataFrame, most_horizon: int | None = None) -> DataFrame:
    """Per signal and horizon: n, mean_ic, ic_std, t_stat (autocorrelation-robust), ic_ir, hit_rate; nulls under 10 dates."""
    most = most_horizon or ic.agg(F.max("horizon")).first()[0] or 1
    lags = F.greatest(F.col("horizon") - 1, F.lit(1))
    s = mean_t(ic, "ic", lags, ["signal", "horizon"], most=max(newey_west_lags(most), 1))
    enough = F.col("n") >= 10
    return s.select(
        "signal",
        "horizon",
        "n",
        *[F.when(enough, c).alias(a) for a, c in (("mean_ic", F.col("mean")), ("ic_std", F.col("std")), ("t_stat", F.col("t_stat")), ("ic_ir", F.try_divide(F.col("mean"), F.col("std"))), ("hit_rate", F.col("hit_rate")))],
    )


def with_p(summary: DataFrame) -> DataFrame:
    """+ p_value of the t statistic as a z."""
    return summary.withColumn("p_value", two_sided(F.col("t_stat")))


def ic_decay(scores: DataFrame, grid: DataFrame, horizons: tuple[int, ...] = SETTINGS.horizons, lag: int = 1, method: str = "spearman") -> DataFrame:
    ic = information_coefficient(scores, prices.forward_returns(grid, horizons, lag), method, horizons=horizons)
    return ic_summary(ic, max(horizons))


def quantile_returns(scores: DataFrame, grid: DataFrame, horizon: int = 5, lag: int = 1, n: int = 5) -> DataFrame:
    """date, signal, q1..qn, spread: mean forward return per bucket of the date's scores; rows without any are dropped.

    Buckets come from the scores alone; dates with fewer than 2n scores have none.
    """
    x = with_bucket(scores, "score", n, ("signal", "date"), "__b").withColumn("__n", F.count("score").over(Window.partitionBy("signal", "date")))
    x = x.where((F.col("__n") >= 2 * n) & F.col("__b").isNotNull())
    both = x.join(prices.forward_returns(grid, (horizon,), lag), ["date", "ticker"], "left")
    wide = both.groupBy("date", "signal").agg(*[F.avg(F.when(F.col("__b") == k, F.col("fwd"))).alias(f"q{k + 1}") for k in range(n)])
    return wide.withColumn("spread", F.col(f"q{n}") - F.col("q1")).where(F.coalesce(*[F.col(f"q{k + 1}") for k in range(n)]).isNotNull())


def quantile_summary(qret: DataFrame, horizon: int, n: int = 5) -> DataFrame:
    """Per signal: annualised mean, volatility and Sharpe of the spread and each bucket's mean, and monotonicity."""
    aggs = []
    for c in [*(f"q{k + 1}" for k in range(n)), "spread"]:
        mean, vol = F.avg(c) * (YEAR / horizon), F.stddev_samp(c) * F.sqrt(F.lit(YEAR / horizon))
        aggs += [mean.alias(f"{c}_ret"), vol.alias(f"{c}_vol"), F.try_divide(mean, vol).alias(f"{c}_sharpe")]
    s = qret.groupBy("signal").agg(*aggs)
    means = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"q{k + 1}_ret").alias("m")) for k in range(n)])
    rows = s.select("signal", F.explode(means).alias("x")).select("signal", "x.k", "x.m").where("m is not null")
    ranked = rows.select("signal", average_rank(F.col("k"), "signal").alias("a"), average_rank(F.col("m"), "signal").alias("b"))
    mono = ranked.groupBy("signal").agg(pearson(F.col("a"), F.col("b"), 3).alias("monotonicity"))
    return s.join(mono, "signal", "left")


def turnover(scores: DataFrame, normalize: bool = True) -> DataFrame:
    """date, signal, turnover: sum of absolute changes of scores (as shares of their gross if normalize); 0 where nothing compares."""
    x = F.col("score")
    if normalize:
        x = F.try_divide(x, F.sum(F.abs("score")).over(Window.partitionBy("signal", "date")))
    rows = scores.withColumn("__x", x)
    change = F.abs(F.col("__x") - F.lag("__x").over(by_ticker("signal")))
    return rows.withColumn("__d", change).groupBy("date", "signal").agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("turnover"))


def cost_drag(turn: DataFrame, cost_bps: float, periods: float) -> DataFrame:
    """Yearly cost of trading at a signal's mean turnover."""
    return turn.groupBy("signal").agg((F.avg("turnover") * cost_bps / 1e4 * periods).alias("cost_drag"))


def signal_correlation(scores: DataFrame, least: int = SETTINGS.min_names, names: list[str] | None = None) -> DataFrame:
    """signal_a, signal_b, corr: mean over dates of the cross-sectional correlation; symmetric, 1 on the diagonal.

    Signals are put side by side, and all pairs of a date are aggregates of one pass, combined map-side.
    names: the signals (asked of the table if not given).
    """
    names = sorted(names if names is not None else [r[0] for r in scores.select("signal").distinct().collect()])
    spark = scores.sparkSession
    if not names:
        return spark.createDataFrame([], "signal_a string, signal_b string, corr double")
    wide = scores.groupBy("date", "ticker").agg(*[F.max(F.when(F.col("signal") == n, F.col("score"))).alias(f"s{k}") for k, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    per = wide.groupBy("date").agg(F.lit(1).alias("one"), *[pearson(F.col(f"s{i}"), F.col(f"s{j}"), least).alias(f"c{i}_{j}") for i, j in pairs])
    means = per.agg(F.lit(1).alias("one"), *[F.avg(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = [(names[i], names[j], F.col(f"c{min(i, j)}_{max(i, j)}") if i != j else F.lit(1.0)) for i in range(len(names)) for j in range(len(names))]
    return means.select(F.explode(F.array(*[F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), c.alias("corr")) for a, b, c in cells])).alias("x")).select("x.*")


def ic_correlation(ic: DataFrame) -> DataFrame:
    """signal_a, signal_b, horizon, corr of the IC series on common dates."""
    a, b = ic.alias("a"), ic.alias("b")
    both = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.horizon") == F.col("b.horizon")))
    return both.groupBy(F.col("a.signal").alias("signal_a"), F.col("b.signal").alias("signal_b"), F.col("a.horizon").alias("horizon")).agg(pearson(F.col("a.ic"), F.col("b.ic")).alias("corr"))


def redundant_pairs(corr: DataFrame, bound: float = 0.8) -> DataFrame:
    return corr.where((F.col("signal_a") < F.col("signal_b")) & (F.abs("corr") > bound))


def league_table(scores: DataFrame, grid: DataFrame, horizons: tuple[int, ...] = SETTINGS.horizons, primary: int = 5, lag: int = 1, cost_bps: float = SETTINGS.cost_bps) -> DataFrame:
    """One row per signal with its headline figures, best information ratio first. Three statistics read the scores: hand over stored ones."""
    decay = ic_decay(scores, grid, tuple(sorted({*horizons, primary})), lag).where(F.col("horizon") == primary)
    q = quantile_summary(quantile_returns(scores, grid, primary, lag), primary)
    t = turnover(scores).groupBy("signal").agg(F.avg("turnover").alias("turnover"))
    drag = F.col("turnover") * cost_bps / 1e4 * (YEAR / primary)
    out = decay.join(q.select("signal", "spread_ret", "spread_sharpe", "monotonicity"), "signal", "left").join(t, "signal", "left")
    out = out.select("signal", "mean_ic", "t_stat", "ic_ir", "hit_rate", "spread_ret", "spread_sharpe", "monotonicity", "turnover", drag.alias("cost_drag"), (F.col("spread_ret") - drag).alias("net_spread_ret"))
    return out.orderBy(F.desc_nulls_last("ic_ir"), "signal")


def horizon_sweep(scores: DataFrame, grid: DataFrame, horizons: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    """signal and one t column per horizon, of the ICs."""
    s = ic_decay(scores, grid, horizons)
    return s.groupBy("signal").pivot("horizon", list(horizons)).agg(F.first("t_stat")).select("signal", *[F.col(str(h)).alias(f"t_{h}") for h in horizons])


def strongest(sweep_long: DataFrame) -> DataFrame:
    """The cell with the largest |t| and how many pass the hurdle, from ic_decay() rows."""
    t = F.abs("t_stat")
    return sweep_long.agg(F.max_by(F.struct("signal", "horizon", "t_stat"), F.struct(t, "signal")).alias("x"), F.coalesce(F.sum((t > SETTINGS.t_hurdle).cast("bigint")), F.lit(0)).alias("survivors")).select("x.signal", "x.horizon", "x.t_stat", "survivors")
