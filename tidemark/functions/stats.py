"""Column expressions and small numpy kernels that Spark doesn't have built in."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def by_ticker(*more: str):
    return Window.partitionBy(*more, "ticker").orderBy("date")


def by_date(*more: str):
    return Window.partitionBy(*more, "date")


def rolling(agg, c: Column, window: int, least: int, over) -> Column:
    """agg(c) over the last `window` rows, null with fewer than `least` values."""
    frame = over.rowsBetween(-(window - 1), 0)
    return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))


def average_rank(c: Column, *partition: str) -> Column:
    """Rank of the non-null values of a partition, ties averaged; null for null."""
    ordered = Window.partitionBy(*partition).orderBy(c.asc_nulls_last())
    ties = Window.partitionBy(*partition, c)
    return F.when(c.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def with_quantiles(df: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...], name: str = "__q") -> DataFrame:
    """df + an array of each partition's exact linear quantiles of value.

    One sort numbers the values; a quantile lies between two of these numbers, which two conditional
    maxima pick out, so no value list is gathered.
    """
    over = Window.partitionBy(*keys)
    i, n, v = F.col("__i"), F.col("__n"), F.col(value)
    x = df.withColumns({"__i": F.row_number().over(over.orderBy(v.asc_nulls_last())) - 1, "__n": F.count(v).over(over)})
    edges = []
    for p in shares:
        at = (n - 1) * F.lit(float(p))
        low, high = (F.max(F.when(i == f(at), v)).over(over) for f in (F.floor, F.ceil))
        edges.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return x.withColumn(name, F.array(*edges)).drop("__i", "__n")


def with_bucket(df: DataFrame, value: str, n: int, keys: tuple[str, ...], name: str) -> DataFrame:
    """df + 0-based bucket between exact linear quantiles: right-closed, equal edges dropped, null if only one edge is left.

    Values and edges are compared at 12 decimals: an edge that falls on a value may be off by its last bit.
    """
    x = with_quantiles(df, value, tuple(k / n for k in range(n + 1)), keys, "__edges")
    edges = F.array_distinct(F.transform("__edges", lambda e: F.round(e, 12)))
    # the first edge is included in the lowest bucket, so it never counts
    inner = F.filter(F.slice(edges, 2, n), lambda e: e < F.round(F.col(value), 12))
    return x.withColumn(name, F.when(F.col(value).isNotNull() & (F.size(edges) >= 2), F.size(inner))).drop("__edges")


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Aggregate: Pearson correlation of rows where both exist; null under `least` rows or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(F.when(both, 1)) >= least, value)


def causal_percentile(c: Column, window: int, least: int, over) -> Column:
    """100 * share of the last `window` rows' values, this one's included, that lie strictly below it."""
    seen = F.collect_list(c).over(over.rowsBetween(-(window - 1), 0))
    below = F.size(F.filter(seen, lambda v: v < c)).cast("double")
    return F.when(c.isNotNull() & (F.size(seen) >= least), F.lit(100.0) * below / F.size(seen))


def normal_cdf(z: float) -> float:
    return NormalDist().cdf(z)


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


#: Wichura's algorithm AS 241 (PPND16), fixed values: numerator and denominator by falling powers,
#: for the centre, the middle and the tails
AS241 = (
    (
        (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
        (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
    ),
    (
        (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
        (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
    ),
    (
        (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
    ),
)
#: Hart's approximation of the normal distribution's tail (5666), fixed values by falling powers, for z under 50 ** 0.5
HART = (
    (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def _polynomial(x: Column, by_falling_powers: tuple[float, ...]) -> Column:
    out = F.lit(by_falling_powers[0])
    for c in by_falling_powers[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of probabilities inside (0, 1), by AS 241; null for null."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    centre, middle, tail = ((_polynomial(x, a) / _polynomial(x, b)) for x, (a, b) in zip((0.180625 - q * q, r - 1.6, r - 5.0), AS241, strict=True))
    outer = F.when(r <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, q * centre).when(q < 0, -outer).when(q >= 0, outer)


def two_sided(t: Column) -> Column:
    """p value of a z statistic, both ways."""
    z = F.abs(t)
    near = _polynomial(z, HART[0]) / _polynomial(z, HART[1])
    far = 1 / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    return 2 * F.exp(-z * z / 2) * F.when(z < 7.07106781186547, near).otherwise(far)


def two_sided_p(t: float) -> float:
    """Of a z statistic."""
    return math.erfc(abs(t) / math.sqrt(2))


def bartlett(lags: int) -> list[float]:
    return [1 - k / (lags + 1) for k in range(1, lags + 1)]


def mean_t(series: DataFrame, value: str, lags: Column | int, keys: list[str], order: str = "date", most: int | None = None) -> DataFrame:
    """Mean of each series with its autocorrelation-robust t: keys, n, mean, std, t_stat, hit_rate.

    Lags are positions among the non-null values. `lags` may differ by series; `most` bounds it.
    The variance of the mean is the sum of squares plus twice the Bartlett-weighted sums of products
    of deviations `lag` positions apart, over n squared; all in one window pass.
    """
    most = most if most is not None else int(lags)
    lags = lags if isinstance(lags, Column) else F.lit(lags)
    rows = series.where(F.col(value).isNotNull())
    all_ = Window.partitionBy(*keys)
    ordered = all_.orderBy(order)
    rows = rows.withColumn("__l", lags).withColumn("__u", F.col(value) - F.avg(value).over(all_))
    products = [F.col("__u") * F.lag("__u", k).over(ordered) * F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / (F.col("__l") + 1)) for k in range(1, most + 1)]
    cross = F.lit(0.0)
    for p in products:
        cross = cross + F.coalesce(p, F.lit(0.0))
    rows = rows.withColumn("__s", F.col("__u") * F.col("__u") + 2 * cross)
    n = F.count(value)
    out = rows.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.sum("__s").alias("__v"), F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"))
    t = F.when(F.col("__v") > 0, F.try_divide(F.col("mean"), F.sqrt(F.when(F.col("__v") > 0, F.col("__v"))) / F.col("n")))
    return out.withColumn("t_stat", t).drop("__v")


def ols_hac(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (constant first), their Bartlett-kernel t values, and R squared."""
    x = np.column_stack([np.ones(len(y)), x])
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    u = y - x @ beta
    g = x * u[:, None]
    meat = g.T @ g
    for k, w in enumerate(bartlett(lags), 1):
        c = g[k:].T @ g[:-k]
        meat += w * (c + c.T)
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0))
    total = ((y - y.mean()) ** 2).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return beta, beta / se, float(1 - (u @ u) / total) if total > 0 else float("nan")
