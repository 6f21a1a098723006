"""Returns, price cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import by_ticker


def returns(grid: DataFrame, *keys: str) -> DataFrame:
    """grid + ret: simple return over one grid row, without filling gaps; null where the base price is 0."""
    return grid.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by_ticker(*keys))) - 1)


def forward_return(close, horizon: int, lag: int, over):
    """Return from `lag` rows ahead over `horizon` rows."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    return F.try_divide(F.lead(close, lag + horizon).over(over), F.lead(close, lag).over(over) if lag else F.col(close)) - 1


def forward_returns(grid: DataFrame, horizons: tuple[int, ...] = (1,), lag: int = 1) -> DataFrame:
    """date, ticker, horizon, fwd: all horizons from one sort of the grid."""
    w = by_ticker()
    wide = grid.select("date", "ticker", *[forward_return("close", h, lag, w).alias(f"h{h}") for h in horizons])
    return wide.select("date", "ticker", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("fwd")) for h in horizons])).alias("x")).select("date", "ticker", "x.horizon", "x.fwd")


def quality(grid: DataFrame, max_move: float = 0.60, min_price: float = 5.0) -> DataFrame:
    """One row per ticker: coverage, span, extreme and flat days, lowest price, and whether it is suspect."""
    r = returns(grid)
    per = r.groupBy("ticker").agg(
        F.count("close").alias("n_obs"),
        F.round(1 - F.count("close") / F.count(F.lit(1)), 4).alias("pct_missing"),
        F.min(F.when(F.col("close").isNotNull(), F.col("date"))).alias("first_date"),
        F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_date"),
        F.coalesce(F.sum((F.abs("ret") > max_move).cast("bigint")), F.lit(0)).alias("extreme_moves"),
        F.coalesce(F.sum((F.col("ret") == 0).cast("bigint")), F.lit(0)).alias("zero_var_days"),
        F.min("close").alias("min_price"),
    )
    return per.withColumn("suspect", (F.col("pct_missing") > 0.30) | (F.col("extreme_moves") > 0) | F.coalesce(F.col("min_price") < min_price / 5, F.lit(False)))


def clean(grid: DataFrame, max_move: float = 1.0, min_obs: int = 252) -> DataFrame:
    """Tickers with at least min_obs prices; a price whose return exceeds max_move either way is masked, its volume kept.

    Returns are those of the unmasked prices, once; nothing is masked again after that.
    """
    kept = grid.join(grid.groupBy("ticker").agg(F.count("close").alias("__n")).where(F.col("__n") >= max(min_obs, 1)).select("ticker"), "ticker", "left_semi")
    r = returns(kept)
    return r.withColumn("close", F.when(F.coalesce(F.abs("ret") > max_move, F.lit(False)), None).otherwise(F.col("close"))).drop("ret")


def clean_report(grid: DataFrame, max_move: float = 1.0, min_obs: int = 252) -> DataFrame:
    """One row: tickers without prices, with too few, kept, and masked prints."""
    n = grid.groupBy("ticker").agg(F.count("close").alias("n"))
    tickers = n.agg(F.coalesce(F.sum((F.col("n") == 0).cast("bigint")), F.lit(0)).alias("empty"), F.coalesce(F.sum(((F.col("n") > 0) & (F.col("n") < min_obs)).cast("bigint")), F.lit(0)).alias("thin"), F.coalesce(F.sum((F.col("n") >= max(min_obs, 1)).cast("bigint")), F.lit(0)).alias("kept"))
    kept = grid.join(n.where(F.col("n") >= max(min_obs, 1)).select("ticker"), "ticker", "left_semi")
    masked = returns(kept).agg(F.coalesce(F.sum((F.abs("ret") > max_move).cast("bigint")), F.lit(0)).alias("masked"))
    return tickers.crossJoin(masked)
