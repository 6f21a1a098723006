"""Studies over prepared scores: persistence, spanning, sign selection, ablations, diagnostics, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.stage import settled
from ..functions.stats import average_rank, by_date, by_ticker, pearson, rolling
from ..operators import backtest as bt
from ..operators import evaluation as ev
from ..operators import inference, prices, sentiment, transforms


def rank_autocorrelation(scores: DataFrame, lags: tuple[int, ...] = (1, 21, 63, 252)) -> DataFrame:
    """signal, lag, rank_autocorr: mean over dates of the correlation with the ranks `lag` rows before."""
    r = scores.select("date", "ticker", "signal", average_rank(F.col("score"), "signal", "date").alias("r"))
    w = by_ticker("signal")
    wide = r.select("date", "signal", "r", *[F.lag("r", k).over(w).alias(f"p{k}") for k in lags])
    pairs = wide.select("date", "signal", "r", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{k}").alias("past")) for k in lags])).alias("x"))
    per = pairs.groupBy("signal", "date", F.col("x.lag").alias("lag")).agg(pearson(F.col("r"), F.col("x.past")).alias("c"))
    return per.groupBy("signal", "lag").agg(F.avg("c").alias("rank_autocorr"))


def long_books(scores: DataFrame) -> DataFrame:
    """i, date, names: the long names of each weekly rebalance that has any, numbered in order."""
    book = bt.positions(transforms.weekly(scores)).where("w > 0").groupBy("date").agg(F.collect_set("ticker").alias("names"))
    return book.withColumn("i", F.row_number().over(Window.orderBy("date")))


def book_overlap(scores: DataFrame, offsets: tuple[int, ...] = (1, 13, 52)) -> DataFrame:
    """weeks, overlap: mean share of a long book that is still held so many rebalances later."""
    w = Window.orderBy("i")
    b = long_books(scores)
    wide = b.select("i", "names", *[F.lead("names", k).over(w).alias(f"n{k}") for k in offsets])
    later = F.explode(F.array(*[F.struct(F.lit(k).alias("weeks"), F.col(f"n{k}").alias("later")) for k in offsets]))
    x = wide.select("i", "names", later.alias("x")).where("x.later is not null")
    return x.groupBy(F.col("x.weeks").alias("weeks")).agg(F.avg(F.size(F.array_intersect("names", "x.later")) / F.size("names")).alias("overlap"))


def spanning_factors(grid: DataFrame, window: int = 63, least: int = 20) -> DataFrame:
    """date, market, megacap_spread: mean return of all names, and of the top tenth by dollar volume less the lower half."""
    r = prices.returns(grid).withColumn("dv", rolling(F.avg, F.col("close") * F.col("volume"), window, least, by_ticker()))
    share = average_rank(F.col("dv"), "date") / F.count("dv").over(by_date())
    x = r.withColumn("share", share)
    return x.groupBy("date").agg(F.avg("ret").alias("market"), (F.avg(F.when(F.col("share") > 0.9, F.col("ret"))) - F.avg(F.when(F.col("share") < 0.5, F.col("ret")))).alias("megacap_spread"))


def spanning_regression(scores: DataFrame, grid: DataFrame, lags: int = 21, window: int = 63, least: int = 20) -> DataFrame:
    """Terms of the regression of a signal's gross book return on the factors."""
    book = bt.positions(transforms.weekly(scores))
    rows = bt.pnl(book, grid, cost_bps=0).select("date", F.col("gross").alias("pnl")).join(spanning_factors(grid, window, least), "date")
    return inference.regression(rows, "pnl", ["market", "megacap_spread"], lags)


def effective_breadth(scores: DataFrame, weeks: int = 52) -> DataFrame:
    """One row: mean number of positions, overlap a year on, and independent bets a year."""
    n = bt.positions(transforms.weekly(scores)).groupBy("date").agg(F.sum((F.col("w") != 0).cast("int")).alias("n")).agg(F.floor(F.avg("n")).cast("bigint").alias("n_positions"))
    o = book_overlap(scores, (weeks,)).select("overlap")
    bets = F.when(F.col("overlap") < 1, (1 - F.col("overlap")) * F.col("n_positions"))
    return n.join(F.broadcast(o), F.lit(True), "left").withColumn("bets_per_year", bets)


def persistence_verdict(overlap: float | None, alpha_t: float | None) -> str:
    """Rule fixed beforehand: a book that keeps more than 70 percent of its names, and its alpha's t."""
    if overlap is None or not overlap > 0.70:
        return "not supported"
    return "supported" if alpha_t is None or abs(alpha_t) < 2 else "mixed"


def fold_signs(scores: DataFrame, grid: DataFrame, horizon: int = 5, k: int = 4, embargo: int = 21) -> DataFrame:
    """fold, signal, sign of the mean IC over the fold's training dates (0 without any or within 1e-6 of 0)."""
    folds = bt.fold_dates(scores, k, embargo)
    ic = ev.information_coefficient(scores, prices.forward_returns(grid, (horizon,)), horizons=(horizon,))
    # all folds are aggregates of one pass; signals without any IC count too
    day = F.col("date").cast("date")
    every = scores.select("signal").distinct().withColumns({"date": F.lit(None).cast(dict(ic.dtypes)["date"]), "ic": F.lit(None).cast("double")})
    means = ic.select("signal", "date", "ic").unionByName(every).groupBy("signal").agg(*[F.avg(F.when(day <= F.lit(end), F.col("ic"))).alias(f"m{f}") for f, _, end, _, _ in folds])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"m{f}").alias("m")) for f, *_ in folds]))
    x = means.select("signal", rows.alias("x")).select("x.fold", "signal", "x.m")
    return x.select("fold", "signal", F.when(F.coalesce(F.abs("m") < 1e-6, F.lit(True)), 0.0).otherwise(F.signum("m")).alias("sign"))


def sign_selection(scores: DataFrame, grid: DataFrame, horizon: int = 5, k: int = 4, embargo: int = 21, least: int = SETTINGS.min_names) -> DataFrame:
    """fold, naive and signed Sharpe and return, and positive signs: both composites on each fold's test dates, in one job.

    Scores and grid are read several times: hand over settled ones.
    """
    folds = bt.fold_dates(scores, k, embargo)
    signs = settled(fold_signs(scores, grid, horizon, k, embargo))  # a row per fold and signal
    variants = signs.select("fold", "signal", F.explode(F.array(F.struct(F.lit("signed").alias("variant"), F.col("sign").alias("w")), F.struct(F.lit("naive").alias("variant"), F.lit(1.0).alias("w")))).alias("x")).select("fold", "signal", "x.*")
    x = bt.in_folds(scores, folds).join(F.broadcast(variants), ["fold", "signal"]).withColumn("w", F.when(F.col("score").isNotNull(), F.col("w")))
    comp = x.groupBy("fold", "variant", "date", "ticker").agg(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum(F.abs("w"))).alias("score"))
    book = bt.positions(transforms.weekly(comp), least=least)
    # returns of the whole panel; weights start inside the fold's test dates
    r = bt.in_folds(prices.returns(grid).select("date", "ticker", "ret"), folds).withColumn("variant", F.explode(F.array(F.lit("naive"), F.lit("signed"))))
    held = r.join(book, ["fold", "variant", "date", "ticker"], "left")
    over = by_ticker("fold", "variant")
    held = held.withColumn("w", F.last("w", True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("h", F.coalesce(F.lag("w").over(over), F.lit(0.0)))
    held = held.withColumn("c", F.coalesce(F.abs(F.col("h") - F.lag("h").over(over)), F.lit(0.0)))
    net = held.groupBy("fold", "variant", "date").agg((F.coalesce(F.sum(F.col("h") * F.col("ret")), F.lit(0.0)) - F.sum("c") * SETTINGS.cost_bps / 1e4).alias("net"))
    s = bt.performance(net).groupBy("fold").agg(*[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{a}") for v in ("naive", "signed") for c, a in (("sharpe", "sharpe"), ("ann_return", "return"))])
    positive = signs.groupBy("fold").agg(F.sum((F.col("sign") > 0).cast("bigint")).alias("n_positive_signs"))
    bounds = s.sparkSession.createDataFrame([(f, a, b) for f, _, _, a, b in folds], "fold int, test_start date, test_end date")
    return s.join(F.broadcast(positive), "fold").join(F.broadcast(bounds), "fold")


def sentiment_variants(composite_index: DataFrame) -> DataFrame:
    """variant, date, exposure for both directions."""
    both = F.explode(F.array(*[F.struct(F.lit(d).alias("variant"), sentiment.exposure(F.col("composite"), d).alias("exposure")) for d in ("contrarian", "momentum")]))
    return composite_index.select("date", both.alias("x")).select("x.variant", "date", "x.exposure")


def ablation_neutral(scores: DataFrame, grid: DataFrame, composite_index: DataFrame) -> DataFrame:
    """variant, figures and Sharpe less the unscaled one's, of the market-neutral book with and without sentiment scaling."""
    # one book for three variants: written once, else its whole lineage runs once for each
    book = settled(bt.positions(transforms.weekly(scores)))
    scalers = settled(sentiment_variants(composite_index))
    books = book.withColumn("variant", F.lit("no sentiment"))
    for v in ("contrarian", "momentum"):
        books = books.unionByName(bt.scaled(book, scalers.where(F.col("variant") == v)).withColumn("variant", F.lit(v)))
    p = bt.performance(bt.pnl(books.select("variant", "date", "ticker", "w"), grid))
    return _against(p, "no sentiment").select("variant", "ann_return", "ann_vol", "sharpe", "max_drawdown", "delta_sharpe")


def _against(p: DataFrame, base: str) -> DataFrame:
    b = p.where(F.col("variant") == base).select(F.col("sharpe").alias("__b"))
    return p.crossJoin(F.broadcast(b)).withColumn("delta_sharpe", F.col("sharpe") - F.col("__b")).drop("__b")


def timed_variants(market: DataFrame, composite_index: DataFrame) -> DataFrame:
    """variant, date, net of holding the market outright and at both sentiment exposures."""
    scalers = sentiment_variants(composite_index)
    out = sentiment.timed_market(market, None).withColumn("variant", F.lit("buy and hold"))
    for v in ("contrarian", "momentum"):
        out = out.unionByName(sentiment.timed_market(market, scalers.where(F.col("variant") == v)).withColumn("variant", F.lit(v)))
    return out.select("variant", "date", "net")


def ablation_directional(market: DataFrame, composite_index: DataFrame) -> DataFrame:
    """variant, figures and Sharpe less buying and holding."""
    p = bt.performance(timed_variants(market, composite_index))
    return _against(p, "buy and hold").select("variant", "ann_return", "ann_vol", "sharpe", "max_drawdown", "hit_rate", "delta_sharpe")


def ablation_folds(market: DataFrame, composite_index: DataFrame, k: int = 4, embargo: int = 21) -> DataFrame:
    """variant, fold, sharpe on the fold's test dates."""
    x = timed_variants(market, composite_index)
    return bt.performance(bt.in_folds(x, bt.fold_dates(x, k, embargo)).select("fold", "variant", "date", "net")).select("variant", "fold", "sharpe")


def ablation_verdict(folds: DataFrame, needed: int = 3) -> DataFrame:
    """variant, wins over buying and holding, mean difference, adds_value."""
    base = folds.where("variant = 'buy and hold'").select("fold", F.col("sharpe").alias("b"))
    x = folds.where("variant <> 'buy and hold'").join(base, "fold")
    return x.groupBy("variant").agg(F.sum((F.col("sharpe") > F.col("b")).cast("bigint")).alias("wins"), F.avg(F.col("sharpe") - F.col("b")).alias("mean_delta")).withColumn("adds_value", F.col("wins") >= needed)


def coverage(grid: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """One row: tickers, dates, tickers without prices, and least, median and most priced names a date (members among them)."""
    t = grid.groupBy("ticker").agg(F.count("close").alias("n")).agg(F.count("*").alias("tickers"), F.sum((F.col("n") == 0).cast("bigint")).alias("empty_tickers"))
    x = grid
    if membership is not None:
        x = grid.join(membership.select("date", "ticker").distinct().withColumn("__m", F.lit(True)), ["date", "ticker"], "left").withColumn("close", F.when(F.col("__m"), F.col("close")))
    d = x.groupBy("date").agg(F.count("close").alias("n")).agg(F.count("*").alias("dates"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))
    return t.crossJoin(d)


def sector_buckets(grid: DataFrame, sectors: DataFrame) -> DataFrame:
    """sector, n: names per bucket as neutralisation sees them."""
    names = grid.select("ticker").distinct().join(sectors, "ticker", "left")
    return names.groupBy(F.coalesce("sector", F.lit("_UNMAPPED")).alias("sector")).agg(F.count("*").alias("n"))


def neutral_vs_raw(raw: DataFrame, grid: DataFrame, sectors: DataFrame, horizon: int = 5) -> DataFrame:
    """signal, ic and t with and without sector neutralisation, and the percentage of the raw IC that is lost."""
    a = ev.ic_decay(transforms.prepare(raw, sectors), grid, (horizon,)).select("signal", F.col("mean_ic").alias("ic_neutral"), F.col("t_stat").alias("t_neutral"))
    # ranks of clipped scores are those of their z-scores, but beside very large scores z-scores of different small ones round to one value
    b = ev.ic_decay(transforms.winsorize(raw), grid, (horizon,)).select("signal", F.col("mean_ic").alias("ic_raw"), F.col("t_stat").alias("t_raw"))
    return a.join(b, "signal").withColumn("ic_lost_pct", 100 * (1 - F.try_divide(F.abs("ic_neutral"), F.abs("ic_raw"))))


def cross_section_size(scores: DataFrame) -> DataFrame:
    """signal, least, median, most scored names a date, and dates under the minimum."""
    d = scores.groupBy("signal", "date").agg(F.count("score").alias("n"))
    return d.groupBy("signal").agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.sum((F.col("n") < SETTINGS.min_names).cast("bigint")).alias("thin_dates"))


def return_sanity(grid: DataFrame) -> DataFrame:
    """One row: pooled median and deviation of returns, large moves, and the equal-weight return a year."""
    r = prices.returns(grid)
    pooled = r.agg(F.percentile("ret", 0.5).alias("median_ret"), F.stddev_samp("ret").alias("std_ret"), F.sum((F.abs("ret") > 0.5).cast("bigint")).alias("over_50"), F.sum((F.abs("ret") > 1.0).cast("bigint")).alias("over_100"))
    ew = r.groupBy("date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("m")).agg((F.pow(F.product(1 + F.col("m")), F.lit(float(SETTINGS.periods_per_year)) / F.count("*")) - 1).alias("ew_ann"))
    return pooled.crossJoin(ew)


def largest_moves(grid: DataFrame, n: int = 8) -> DataFrame:
    """ticker, max_move of the n names with the largest single moves."""
    return prices.returns(grid).groupBy("ticker").agg(F.max(F.abs("ret")).alias("max_move")).where("max_move is not null").orderBy(F.desc("max_move"), "ticker").limit(n)


def lag_sandbox(raw: DataFrame, grid: DataFrame, sectors: DataFrame, horizon: int = 5) -> DataFrame:
    """signal, lag, neutral, mean_ic, t_stat for execution lags 0 and 1, with and without neutralisation: one table of scores, one of returns."""
    scores = None
    for neutral in (True, False):
        p = (transforms.prepare(raw, sectors) if neutral else transforms.winsorize(raw)).select("date", "ticker", F.concat("signal", F.lit(f"|{str(neutral).lower()}")).alias("signal"), "score")
        scores = p if scores is None else scores.unionByName(p)
    # the lags stand as horizons beside each other; both have the sandbox's one
    fwd = prices.forward_returns(grid, (horizon,), 0).withColumn("horizon", F.lit(0)).unionByName(prices.forward_returns(grid, (horizon,), 1).withColumn("horizon", F.lit(1)))
    ic = ev.information_coefficient(scores, fwd, horizons=(0, 1)).withColumns({"lag": F.col("horizon"), "horizon": F.lit(horizon)})
    parts = F.split("signal", r"\|")
    named = ic.withColumns({"signal": F.concat_ws("|", "signal", F.col("lag").cast("string"))})
    s = ev.ic_summary(named, horizon)
    return s.select(parts[0].alias("signal"), parts[2].cast("int").alias("lag"), parts[1].cast("boolean").alias("neutral"), "mean_ic", "t_stat")


def significance(table: DataFrame, t: str = "t_stat") -> DataFrame:
    """One row: how many t values pass the hurdle, of how many, and the largest."""
    a = F.abs(F.col(t))
    return table.agg(F.coalesce(F.sum((a > SETTINGS.t_hurdle).cast("bigint")), F.lit(0)).alias("passing"), F.count(t).alias("trials"), F.max(a).alias("max_abs_t"))


def latest_sentiment(index: DataFrame) -> DataFrame:
    """The last composite, its regime, and the one 22 rows from the end."""
    k = F.row_number().over(Window.orderBy(F.desc("date")))
    x = index.where("composite is not null").withColumn("k", k)
    row = x.agg(F.max(F.when(F.col("k") == 1, F.col("date"))).alias("date"), F.max(F.when(F.col("k") == 1, F.col("composite"))).alias("composite"), F.max(F.when(F.col("k") == 22, F.col("composite"))).alias("month_ago"))
    return row.withColumn("regime", sentiment.label(F.col("composite")))


def trailing_year(index: DataFrame, days: int = 365) -> DataFrame:
    last = index.agg(F.max("date").alias("__last"))
    return index.crossJoin(F.broadcast(last)).where(F.col("date") >= F.date_sub("__last", days)).drop("__last")
