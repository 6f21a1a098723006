"""Long-short portfolios: positions, backtest with lag and costs, statistics, purged walk-forward."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.stats import by_ticker, normal_ppf, normal_quantile
from . import prices
from .transforms import weekly

YEAR = SETTINGS.periods_per_year


def positions(scores: DataFrame, top: float = 0.2, bottom: float = 0.2, gross: float = 1.0, least: int = SETTINGS.min_names) -> DataFrame:
    """date, ticker, w for every ticker of the table on every date: +-gross/2 spread over the highest and lowest scores.

    Equal scores are taken in ticker order. A date with fewer than `least` scores is flat. Names without a
    score have weight 0; a name that is in both ends is short.
    """
    keys = [k for k in ("variant", "fold") if k in scores.columns]
    n = F.count("score").over(Window.partitionBy(*keys, "date"))
    up = F.row_number().over(Window.partitionBy(*keys, "date").orderBy(F.desc_nulls_last("score"), "ticker"))
    k_long, k_short = (F.greatest(F.floor(F.col("__n") * f), F.lit(1)) for f in (top, bottom))
    x = scores.withColumn("__n", n).withColumn("__k", up)
    usable = (F.col("__n") >= least) & F.col("score").isNotNull()
    w = F.when(usable & (F.col("__k") > F.col("__n") - k_short), -(gross / 2) / k_short).when(usable & (F.col("__k") <= k_long), (gross / 2) / k_long).otherwise(0.0)
    return x.withColumn("w", w).select(*keys, "date", "ticker", "w")


def scaled(book: DataFrame, scaler: DataFrame) -> DataFrame:
    """Weights times scaler(date, exposure): the rebalance date's own value, else the last earlier rebalance's, else 1."""
    dates = book.select("date").distinct().join(scaler.select("date", "exposure"), "date", "left")
    dates = dates.withColumn("exposure", F.coalesce(F.last("exposure", True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    return book.join(F.broadcast(dates), "date").withColumn("w", F.col("w") * F.col("exposure")).drop("exposure")


def held(book: DataFrame, grid: DataFrame, lag: int = SETTINGS.execution_lag) -> DataFrame:
    """date, ticker, ret, held: weights of the last rebalance that fell on a grid date, `lag` rows later; 0 before any."""
    keys = [k for k in ("variant", "fold") if k in book.columns]
    r = prices.returns(grid).select("date", "ticker", "ret", *[k for k in keys if k in grid.columns])
    if keys and not all(k in grid.columns for k in keys):
        r = r.crossJoin(F.broadcast(book.select(*keys).distinct()))
    on = [*keys, "date", "ticker"]
    # a rebalance touches all tickers of its book, so a date in the book means a weight for each of them
    x = r.join(book, on, "left")
    over = by_ticker(*keys)
    x = x.withColumn("w", F.last("w", True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("held", F.coalesce(F.lag("w", lag).over(over) if lag else F.col("w"), F.lit(0.0))).drop("w")


def pnl(book: DataFrame, grid: DataFrame, lag: int = SETTINGS.execution_lag, cost_bps: float = SETTINGS.cost_bps) -> DataFrame:
    """date, gross, cost, net (per variant or fold if the book has them)."""
    keys = [k for k in ("variant", "fold") if k in book.columns]
    x = held(book, grid, lag)
    change = F.coalesce(F.abs(F.col("held") - F.lag("held").over(by_ticker(*keys))), F.lit(0.0))
    x = x.withColumn("__c", change)
    out = x.groupBy(*keys, "date").agg(F.coalesce(F.sum(F.col("held") * F.col("ret")), F.lit(0.0)).alias("gross"), (F.sum("__c") * cost_bps / 1e4).alias("cost"))
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def equity(returns: DataFrame, value: str = "net") -> DataFrame:
    """+ equity (growth of 1) and drawdown from the highest equity so far, which starts at the first row's."""
    keys = [k for k in ("signal", "variant", "fold") if k in returns.columns]
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = returns.withColumn("equity", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))
    return x.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def backtest(scores: DataFrame, grid: DataFrame, top: float = 0.2, bottom: float = 0.2, cost_bps: float = SETTINGS.cost_bps, lag: int = SETTINGS.execution_lag, scaler: DataFrame | None = None, least: int = SETTINGS.min_names, dense: bool = True) -> DataFrame:
    """Weekly rebalanced long-short backtest: date, gross, cost, net, equity, drawdown.

    dense: the scores have a row for every name on every date, as combine() of panel scores gives; else
    rows are filled in, so that a name without a score leaves the book.
    """
    sampled = weekly(scores)
    book = positions(sampled if dense else filled(sampled), top, bottom, least=least)
    if scaler is not None:
        book = scaled(book, scaler)
    return equity(pnl(book, grid, lag, cost_bps))


def filled(scores: DataFrame) -> DataFrame:
    """A row for every ticker on every date of the table, so that names without a score leave the book."""
    keys = [k for k in ("variant", "fold") if k in scores.columns]
    dates = scores.select(*keys, "date").distinct()
    return dates.crossJoin(scores.select("ticker").distinct()).join(scores, [*keys, "date", "ticker"], "left")


def performance(returns: DataFrame, value: str = "net", periods: int = YEAR, least: int = 20) -> DataFrame:
    """Yearly return and volatility, Sharpe, largest drawdown, Calmar, hit rate, corrected skew, n_periods; all null under `least` rows."""
    keys = [k for k in ("signal", "variant", "fold") if k in returns.columns]
    x = equity(returns.where(F.col(value).isNotNull()).select(*keys, "date", value), value)
    s = x.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.min("drawdown").alias("dd"), F.avg((F.col(value) > 0).cast("double")).alias("hit"), F.skewness(value).alias("g"))
    n = F.col("n").cast("double")
    ret, vol = F.col("m") * periods, F.col("sd") * math.sqrt(periods)
    skew = F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)
    figures = (("ann_return", ret), ("ann_vol", vol), ("sharpe", F.try_divide(ret, vol)), ("max_drawdown", F.col("dd")), ("calmar", F.try_divide(ret, F.abs("dd"))), ("hit_rate", F.col("hit")), ("skew", skew), ("n_periods", F.col("n")))
    return s.select(*keys, *[F.when(F.col("n") >= least, c).alias(a) for a, c in figures])


def split_bounds(n: int, k: int = 4, embargo: int = 21) -> list[tuple[int, int, int, int]]:
    """fold, rows trained on, first and last test row + 1: expanding windows, the test starts `embargo` rows after training."""
    if n < (k + 1) * (embargo + 20):
        raise ValueError(f"{n} dates are too few for {k} folds with an embargo of {embargo}")
    size = n // (k + 1)
    out = [(i, size * i, size * i + embargo, min(size * i + size, n)) for i in range(1, k + 1)]
    return [(f, t, a, b) for f, t, a, b in out if a < b]


def fold_dates(dates: DataFrame, k: int = 4, embargo: int = 21) -> list[tuple]:
    """fold, train_start, train_end, test_start, test_end of each fold: a handful of rows, found by one ranking of the distinct dates."""
    days = dates.select("date").distinct().where("date is not null")
    bounds = split_bounds(days.count(), k, embargo)
    numbered = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    asked = sorted({i for _, n, a, b in bounds for i in (0, n - 1, a, b - 1)})
    at = {r.i: r.date for r in numbered.where(F.col("i").isin(asked)).collect()}
    return [(f, at[0], at[n - 1], at[a], at[b - 1]) for f, n, a, b in bounds]


def walk_forward_splits(dates: DataFrame, k: int = 4, embargo: int = 21) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end (inclusive dates) over the distinct dates."""
    rows = fold_dates(dates, k, embargo)
    literals = ", ".join(f"({f}, " + ", ".join(f"date'{d}'" for d in ds) + ")" for f, *ds in rows)
    return dates.sparkSession.sql(f"select * from values {literals} as f(fold, train_start, train_end, test_start, test_end)")


def in_folds(rows: DataFrame, folds: list[tuple], bounded: bool = True) -> DataFrame:
    """rows + fold, once for each fold whose test dates have the row's date (or, not bounded, from its start on); no join."""
    day = F.col("date").cast("date")
    of = F.array(*[F.when((day >= F.lit(a)) & ((day <= F.lit(b)) if bounded else F.lit(True)), F.lit(f)) for f, _, _, a, b in folds])
    return rows.withColumn("fold", F.explode(F.array_compact(of)))


def walk_forward(scores: DataFrame, grid: DataFrame, k: int = 4, embargo: int = 21, bounded: bool = False, **kw) -> DataFrame:
    """performance() of each fold's backtest, all folds in one job.

    Scores are those of the fold's test dates; prices run from its start to the end of the sample (as the
    research protocol has it), or to the fold's end if bounded. Scores have a row for every name and date.
    """
    folds = fold_dates(grid, k, embargo)
    s = in_folds(scores, folds).select("fold", "date", "ticker", "score")
    g = in_folds(grid, folds, bounded)
    book = positions(weekly(s), kw.pop("top", 0.2), kw.pop("bottom", 0.2), least=kw.pop("least", SETTINGS.min_names))
    lag, cost = kw.pop("lag", SETTINGS.execution_lag), kw.pop("cost_bps", SETTINGS.cost_bps)
    r = returns_by_fold(g)
    x = r.join(book, ["fold", "date", "ticker"], "left")
    over = by_ticker("fold")
    x = x.withColumn("w", F.last("w", True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("held", F.coalesce(F.lag("w", lag).over(over), F.lit(0.0)))
    x = x.withColumn("__c", F.coalesce(F.abs(F.col("held") - F.lag("held").over(over)), F.lit(0.0)))
    out = x.groupBy("fold", "date").agg((F.coalesce(F.sum(F.col("held") * F.col("ret")), F.lit(0.0)) - F.sum("__c") * cost / 1e4).alias("net"))
    return performance(out)


def returns_by_fold(grid: DataFrame) -> DataFrame:
    return prices.returns(grid, "fold").select("fold", "date", "ticker", "ret")


#: the share of the second quantile in an expected maximum (Euler's constant, fixed value)
EULER = 0.5772156649


def deflated_sharpe(n_trials: int, observed: float, n_obs: int) -> dict[str, float]:
    """The Sharpe ratio that the best of n_trials worthless strategies should reach, and whether the observed one beats it."""
    if n_trials < 1 or n_obs < 20:
        return {"hurdle": float("nan"), "observed": observed, "passes": False}
    e = max(n_trials, 2)
    z = (1 - EULER) * normal_ppf(1 - 1 / e) + EULER * normal_ppf(1 - 1 / (e * math.e))
    hurdle = z / math.sqrt(n_obs) * math.sqrt(YEAR)
    return {"hurdle": hurdle, "observed": observed, "passes": observed > hurdle}


def sharpe_hurdle(n_trials: Column, n_obs: Column) -> Column:
    """deflated_sharpe()'s hurdle of columns; null without a trial or under 20 observations."""
    e = F.greatest(n_trials, F.lit(2)).cast("double")
    z = (1 - EULER) * normal_quantile(1 - 1 / e) + EULER * normal_quantile(1 - 1 / (e * math.e))
    return F.when((n_trials >= 1) & (n_obs >= 20), z / F.sqrt(n_obs) * math.sqrt(YEAR))
