"""Regressions with autocorrelation-robust errors and the block-bootstrap null, as grouped-map numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ols_hac, two_sided_p
from . import sentiment as st


def regression(rows: DataFrame, y: str, xs: list[str], lags: int, keys: list[str] | None = None, order: str = "date") -> DataFrame:
    """keys, term (const first), coef, t_stat, p_value, r2, n: one least-squares fit per key over its ordered complete rows."""
    keys = keys or []
    data = rows.select(*keys, order, y, *xs).dropna(subset=[y, *xs])
    if not keys:
        data, keys_ = data.withColumn("__k", F.lit(1)), ["__k"]
    else:
        keys_ = keys

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        if len(p) <= len(xs) + 1:
            return pd.DataFrame(columns=[*keys_, "term", "coef", "t_stat", "p_value", "r2", "n"])
        beta, t, r2 = ols_hac(p[y].to_numpy(float), p[xs].to_numpy(float), lags)
        out = pd.DataFrame({"term": ["const", *xs], "coef": beta, "t_stat": t, "p_value": [two_sided_p(v) for v in t], "r2": r2, "n": len(p)})
        for k in reversed(keys_):
            out.insert(0, k, p[k].iat[0])
        return out

    kinds = dict(data.dtypes)
    shape = ", ".join([*(f"{k} {kinds[k]}" for k in keys_), "term string, coef double, t_stat double, p_value double, r2 double, n long"])
    return data.groupBy(*keys_).applyInPandas(run, shape).drop("__k")


def predictive_test(sentiment: DataFrame, market: DataFrame, horizons: tuple[int, ...] = (5, 21, 63), buckets: int = 5) -> DataFrame:
    """One row per horizon with at least 200 joint rows: the statistics of predictive_stats and the slope's robust t and p."""
    stats = tests = None
    for h in horizons:
        s = st.predictive_stats(sentiment, market, h, buckets)
        r = regression(st.forward(st.joint(sentiment, market), h), "fwd", ["composite"], max(h - 1, 1)).where("term = 'composite'").select(F.lit(h).alias("horizon"), "t_stat", "p_value")
        stats, tests = (s, r) if stats is None else (stats.unionByName(s), tests.unionByName(r))
    return stats.join(tests, "horizon")


def slope_t(x: np.ndarray, returns: np.ndarray, horizon: int, least: int = 200) -> float:
    """Robust t of forward returns (from the next row on) on x; prices are rebuilt from returns."""
    px = np.cumprod(1 + returns)
    fwd = px[1 + horizon :] / px[1 : len(px) - horizon] - 1
    if len(fwd) < least:
        return float("nan")
    _, t, _ = ols_hac(fwd, x[: len(fwd), None], max(horizon - 1, 1))
    return float(t[1])


def block_starts(n: int, block: int, seed: int, sim: int) -> np.ndarray:
    """Block starts of one simulation, from a seed of its own."""
    return np.random.default_rng([seed, sim]).integers(0, max(n - block, 1), size=-(-n // block))


def null_calibration(sentiment: DataFrame, market: DataFrame, horizon: int = 63, n_sims: int = 500, block: int = 63, seed: int = 0, least: int = 300) -> DataFrame:
    """One row: the observed slope t against its distribution when blocks of market returns are drawn anew.

    Each simulation draws from its own seed where it runs, so a seed gives the same draws whatever the
    cluster; tasks hold the series of a few thousand dates. There is no row under `least` dates or 50
    usable simulations.
    """
    spark = sentiment.sparkSession
    rows = st.joint(sentiment, market).orderBy("date").toPandas()  # one row per trading date
    shape = "observed_t double, null_mean_t double, null_std_t double, null_p05 double, null_p95 double, null_p99 double, p_value double, n_sims long, significant boolean"
    if len(rows) < least:
        return spark.createDataFrame([], shape)
    px = rows["px"].to_numpy(float)
    ret = px[1:] / px[:-1] - 1
    x = rows["composite"].to_numpy(float)[1:]
    observed = slope_t(x, ret, horizon)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        paths = (np.concatenate([ret[i : i + block] for i in block_starts(len(ret), block, seed, k)])[: len(ret)] for k in p["sim"])
        return pd.DataFrame({"t": [slope_t(x[: len(path)], path, horizon) for path in paths]})

    sims = spark.range(n_sims).withColumnRenamed("id", "sim")
    t = sims.groupBy(F.pmod("sim", F.lit(64)).alias("g")).applyInPandas(run, "t double").where("t is not null and not isnan(t)")
    a = F.abs("t")
    quantiles = [F.percentile(a, q).alias(f"null_p{int(q * 100):02d}") for q in (0.05, 0.95, 0.99)]
    out = t.agg(F.lit(observed).alias("observed_t"), F.avg("t").alias("null_mean_t"), F.stddev_samp("t").alias("null_std_t"), *quantiles, F.avg((a >= abs(observed)).cast("double")).alias("p_value"), F.count("*").alias("n_sims"))
    return out.where("n_sims >= 50").withColumn("significant", F.col("p_value") < 0.05)
