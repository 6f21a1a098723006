"""Cross-sectional transforms of long scores (date, ticker, signal, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.stats import average_rank, by_date, clip, normal_quantile, with_quantiles
from ..sources.panels import friday_of

KEYS = ("signal",)


def _keys(df: DataFrame) -> tuple[str, ...]:
    """Partition keys besides the date that the table has."""
    return tuple(k for k in ("signal", "variant", "fold") if k in df.columns)


def winsorize(df: DataFrame, limits: tuple[float, float] = SETTINGS.winsor) -> DataFrame:
    """Scores clipped to their date's exact linear quantiles."""
    x = with_quantiles(df, "score", limits, (*_keys(df), "date"), "__e")
    return x.withColumn("score", clip(F.col("score"), F.col("__e")[0], F.col("__e")[1])).drop("__e")


def zscore(df: DataFrame) -> DataFrame:
    w = by_date(*_keys(df))
    return df.withColumn("score", F.try_divide(F.col("score") - F.avg("score").over(w), F.stddev_samp("score").over(w)))


def rank_normalize(df: DataFrame) -> DataFrame:
    """Normal quantiles of average ranks as shares, kept 1e-6 from 0 and 1."""
    share = average_rank(F.col("score"), *_keys(df), "date") / F.count("score").over(by_date(*_keys(df)))
    ranked = df.withColumn("__p", clip(share, F.lit(1e-6), F.lit(1 - 1e-6)))
    return ranked.withColumn("score", normal_quantile(F.col("__p"))).drop("__p")


def rank_share(df: DataFrame) -> DataFrame:
    """Average ranks as shares of the date's names (what rank_normalize feeds to the normal quantile)."""
    return df.withColumn("score", average_rank(F.col("score"), *_keys(df), "date") / F.count("score").over(by_date(*_keys(df))))


def sector_neutralize(df: DataFrame, sectors: DataFrame | None) -> DataFrame:
    """Scores less their sector's mean of the date.

    Names without a sector share one; a sector with a single name in the panel is left alone. The table
    has a row for every name on every date, as panels and signals give (missing scores are null), so the
    rows of a sector on a date are its names in the panel. Without sectors nothing changes.
    """
    if sectors is None or sectors.limit(1).count() == 0:
        return df
    names = sectors.select("ticker", F.col("sector").alias("__sector")).dropDuplicates(["ticker"])
    joined = df.join(names, "ticker", "left").withColumn("__sector", F.coalesce("__sector", F.lit("_UNMAPPED")))
    w = Window.partitionBy(*_keys(df), "date", "__sector")
    return joined.withColumn("score", F.when(F.count(F.lit(1)).over(w) >= 2, F.col("score") - F.avg("score").over(w)).otherwise(F.col("score"))).select(*df.columns)


def prepare(df: DataFrame, sectors: DataFrame | None = None, neutralize: bool = True, method: str = "zscore", limits: tuple[float, float] = SETTINGS.winsor) -> DataFrame:
    if method not in ("zscore", "rank"):
        raise ValueError(f"unknown method {method!r}")
    out = winsorize(df, limits)
    if neutralize:
        out = sector_neutralize(out, sectors)
    return zscore(out) if method == "zscore" else rank_normalize(out)


def display_scores(df: DataFrame, sectors: DataFrame | None) -> DataFrame:
    """For ranking tables: neutral z-scores without clipping, so that the ends are not tied."""
    return zscore(sector_neutralize(df, sectors))


def weekly(df: DataFrame, value: str = "score") -> DataFrame:
    """The last non-null value of each Saturday-to-Friday week, dated its Friday; weeks without any value are dropped."""
    keys = _keys(df)
    rows = df.withColumn("week", friday_of(F.col("date")))
    last = rows.groupBy(*keys, "week", "ticker").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias(value))
    alive = F.count(value).over(Window.partitionBy(*keys, "week"))
    return last.withColumn("__n", alive).where("__n > 0").drop("__n").withColumnRenamed("week", "date")


def combine(df: DataFrame, weights: dict[str, float] | None = None, names: list[str] | None = None) -> DataFrame:
    """date, ticker, score: the weighted mean of the signals that a name has, by the weights it has them with.

    names: the table's signals, as the registry knows them; weights are checked against the table if not given.
    """
    if weights is not None and not weights or names is not None and not names:
        raise ValueError("no signals to combine")
    if weights is not None:
        missing = [n for n in (names if names is not None else [r[0] for r in df.select("signal").distinct().collect()]) if n not in weights]
        if missing:
            raise ValueError(f"no weight for {', '.join(sorted(missing))}")
        if sum(map(abs, weights.values())) == 0:
            raise ValueError("the weights are all zero")
    w = F.lit(1.0) if weights is None else F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("signal"))
    keys = [k for k in ("variant", "fold") if k in df.columns]
    some = df.withColumn("__w", F.when(F.col("score").isNotNull(), w))
    return some.groupBy(*keys, "date", "ticker").agg(F.try_divide(F.sum(F.col("__w") * F.col("score")), F.sum(F.abs("__w"))).alias("score"))


def extremes(df: DataFrame, n: int = 15) -> DataFrame:
    """The n highest and lowest names of each signal's latest date with any score."""
    keys = _keys(df)
    latest = df.where("score is not null").groupBy(*keys).agg(F.max("date").alias("date"))
    rows = df.join(F.broadcast(latest), [*keys, "date"]).where("score is not null")
    up, down = (Window.partitionBy(*keys).orderBy(o, "ticker") for o in (F.desc("score"), F.asc("score")))
    ranked = rows.withColumns({"top": F.row_number().over(up), "bottom": F.row_number().over(down)})
    return ranked.where((F.col("top") <= n) | (F.col("bottom") <= n))
