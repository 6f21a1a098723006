"""Whole runs: loading a live universe, the research report, the sentiment report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.stage import settled
from ..operators import backtest as bt
from ..operators import evaluation as ev
from ..operators import inference, prices, sentiment, signals, transforms, universe
from ..sources import panels, vendor
from ..sources.store import Store
from . import studies

#: fewer names than this make cross-sections meaningless
LEAST_TICKERS = 30


def load_live(store: Store, fetch: vendor.Fetch, snapshots: DataFrame, current_sectors: DataFrame | None, start: str, end: str, min_obs: int = 252, max_move: float = 1.0, min_price: float = SETTINGS.min_price, min_dollar_volume: float = SETTINGS.min_dollar_volume, least: int = 400, **kw) -> signals.Market:
    """Universe from snapshots(snapshot_date, ticker, sector), prices from the vendor, cleaned, mapped to sectors, screened for liquidity."""
    names = [r[0] for r in snapshots.select("ticker").distinct().orderBy("ticker").collect()]  # a universe's tickers: hundreds
    bars = vendor.ingest(store, fetch, names, start, end, **kw)
    grid = prices.clean(panels.dense(bars.select("date", "ticker", "close", "volume")), max_move, min_obs)
    seen = universe.first_seen_sectors(snapshots)
    sectors = universe.sector_map(seen, current_sectors) if current_sectors is not None else seen
    members = universe.build("snapshots", panels.calendar(grid), snapshots=snapshots, least=least).withColumn("is_member", F.lit(True))
    liquid = universe.liquidity_filter(members, grid, min_dollar_volume, min_price).where("is_member").select("date", "ticker")
    return signals.Market(grid, sectors, liquid)


def research(market: signals.Market, registry: signals.Registry | None = None, primary: int = 5, cost_bps: float = SETTINGS.cost_bps, splits: int = 4, embargo: int = 21) -> dict[str, DataFrame]:
    """league, correlation, decay (of the best signal), backtest, stats (gross and net), walk_forward, haircut."""
    if market.bars.select("ticker").distinct().count() < LEAST_TICKERS:
        raise ValueError(f"fewer than {LEAST_TICKERS} tickers: too few for cross-sections; is a smaller run's cache in use?")
    registry = registry or signals.default_registry()
    scores = settled(transforms.prepare(registry.compute_all(market), market.sectors))
    league = ev.league_table(scores, market.bars, primary=primary, cost_bps=cost_bps)
    best = league.select("signal").first()[0]
    composite = settled(transforms.combine(scores))
    run = settled(bt.backtest(composite, market.bars, cost_bps=cost_bps))
    gross = bt.performance(run, "gross").withColumn("kind", F.lit("gross"))
    net = bt.performance(run, "net").withColumn("kind", F.lit("net"))
    figures = net.first()
    note = bt.deflated_sharpe(len(registry), figures.sharpe or float("nan"), figures.n_periods or 0)
    return {
        "league": league,
        "correlation": ev.signal_correlation(scores),
        "decay": ev.with_p(ev.ic_decay(scores.where(F.col("signal") == best), market.bars)),
        "backtest": run,
        "stats": gross.unionByName(net),
        "walk_forward": bt.walk_forward(composite, market.bars, splits, embargo).join(bt.walk_forward_splits(market.bars, splits, embargo), "fold"),
        "haircut": run.sparkSession.createDataFrame([(len(registry), float(note["hurdle"]), float(note["observed"]), bool(note["passes"]))], "trials int, hurdle double, observed double, passes boolean"),
    }


def verdict(max_t: float | None, calibrated: bool, trailing: float, forward: float) -> str:
    """Rule fixed beforehand: the largest slope t, whether the bootstrap confirms it, and how much more the index tells of the past."""
    if max_t is not None and abs(max_t) > SETTINGS.t_hurdle:
        return "predictive" if calibrated else "not predictive"
    return "coincident" if abs(trailing) / max(abs(forward), 1e-9) > 3 else "inconclusive"


def sign_verdict(improvements: list[float]) -> str:
    """Of sign selection: supported if it helps on average and in three folds of four."""
    known = [x for x in improvements if x is not None]
    if not known or sum(known) <= 0:
        return "not supported"
    return "supported" if sum(x > 0 for x in known) >= 0.75 * len(known) else "weak"


def sentiment_report(proxies: DataFrame, grid: DataFrame, membership: DataFrame | None = None, store: Store | None = None, n_sims: int = 300, seed: int = 1, **kw) -> dict[str, object]:
    """index, describe, correlation, regimes, predictive, coincident, calibration, scalers and the verdict; the index is stored."""
    index = settled(sentiment.index(proxies, grid, membership, **kw))
    market = sentiment.fallback_market(proxies, grid)
    predictive = settled(inference.predictive_test(index, market))
    best = predictive.agg(F.max_by(F.struct("horizon", "t_stat"), F.abs("t_stat")).alias("x")).select("x.*").first()
    calibration = settled(inference.null_calibration(index, market, (best and best.horizon) or 63, n_sims, seed=seed))
    coincident = settled(sentiment.coincident(index, market))
    confirmed, both = calibration.first(), coincident.first()
    if store is not None:
        store.write("sentiment_index", index)
    scalers = {d: index.select("date", sentiment.exposure(F.col("composite"), d).alias("exposure")) for d in ("contrarian", "momentum")}
    return {
        "index": index,
        "describe": sentiment.describe(index),
        "correlation": sentiment.correlation(index),
        "regimes": sentiment.regimes(index),
        "predictive": predictive,
        "coincident": coincident,
        "calibration": calibration,
        "scalers": scalers,
        "verdict": verdict(best and best.t_stat, bool(confirmed and confirmed.significant), both.trailing_corr or 0.0, both.forward_corr or 0.0),
    }


#: trials before the pre-registered run, as its accounting counts them (the league table at one horizon)
PRIOR_TRIALS = 7


def preregistered(market: signals.Market, target: str, registry: signals.Registry | None = None, horizons: tuple[int, ...] = (1, 5, 21, 63), primary: int = 5, lags: tuple[int, ...] = (1, 21, 63, 252), weeks: tuple[int, ...] = (1, 13, 52), splits: int = 4, embargo: int = 21, prior: int = PRIOR_TRIALS, regression_lags: int = 21, window: int = 63, least: int = 20) -> dict[str, object]:
    """The three tests written down beforehand, their verdicts, and the count of all trials so far with the Sharpe ratio that luck alone gives.

    persistence, overlap, spanning, breadth and static_bet (verdict) of the target; sweep and strongest;
    folds and signs (verdict); accounting(trials, prior, cumulative, max_abs_t, hurdle).
    """
    registry = registry or signals.default_registry()
    bars = settled(market.bars)
    scores = settled(transforms.prepare(registry.compute_all(signals.Market(bars, market.sectors, market.membership)), market.sectors))
    one = scores.where(F.col("signal") == target)
    overlap = settled(studies.book_overlap(one, weeks))
    spanning = settled(studies.spanning_regression(one, bars, regression_lags, window, least))
    year = overlap.where(F.col("weeks") == max(weeks)).select("overlap").first()
    alpha = spanning.where("term = 'const'").select("t_stat").first()
    sweep = settled(ev.with_p(ev.ic_decay(scores, bars, horizons)))
    folds = settled(studies.sign_selection(scores, bars, primary, splits, embargo))
    better = [r.signed_sharpe - r.naive_sharpe for r in folds.collect() if r.signed_sharpe is not None and r.naive_sharpe is not None]  # a row per fold
    return {
        "persistence": studies.rank_autocorrelation(one, lags),
        "overlap": overlap,
        "spanning": spanning,
        "breadth": studies.effective_breadth(one, max(weeks)),
        "static_bet": studies.persistence_verdict(year and year.overlap, alpha and alpha.t_stat),
        "sweep": sweep,
        "strongest": ev.strongest(sweep),
        "folds": folds,
        "signs": sign_verdict(better),
        "accounting": accounting(sweep, bars, prior),
    }


def accounting(sweep: DataFrame, bars: DataFrame, prior: int = PRIOR_TRIALS) -> DataFrame:
    """One row: trials of a sweep, those before, all of them, the largest |t|, and the Sharpe ratio that the best of so many worthless ones should reach."""
    x = sweep.agg(F.count(F.lit(1)).alias("trials"), F.max(F.abs("t_stat")).alias("max_abs_t"))
    n = bars.agg(F.count_distinct("date").alias("n_obs"))
    x = x.crossJoin(n).select("trials", F.lit(prior).cast("bigint").alias("prior"), (F.col("trials") + prior).alias("cumulative"), "max_abs_t", "n_obs")
    return x.withColumn("hurdle", bt.sharpe_hurdle(F.col("cumulative"), F.col("n_obs"))).drop("n_obs")


def ablation(market: signals.Market, index: DataFrame, spy: DataFrame, registry: signals.Registry | None = None, splits: int = 4, embargo: int = 21) -> dict[str, DataFrame]:
    """neutral, directional, folds and verdict: what sentiment scaling adds to the market-neutral book, and to holding the market."""
    registry = registry or signals.default_registry()
    bars, index = settled(market.bars), settled(index)
    scores = transforms.prepare(registry.compute_all(signals.Market(bars, market.sectors, market.membership)), market.sectors)
    folds = settled(studies.ablation_folds(spy, index, splits, embargo))
    return {
        "neutral": studies.ablation_neutral(transforms.combine(scores), bars, index),
        "directional": studies.ablation_directional(spy, index),
        "folds": folds,
        "verdict": studies.ablation_verdict(folds),
    }


def diagnosis(market: signals.Market, registry: signals.Registry | None = None, horizon: int = 5) -> dict[str, DataFrame]:
    """coverage, sectors, mapped, neutral_vs_raw, cross_section, sanity and moves of a market."""
    registry = registry or signals.default_registry()
    bars = settled(market.bars)
    raw = settled(registry.compute_all(signals.Market(bars, market.sectors, market.membership)))
    return {
        "coverage": studies.coverage(bars, market.membership),
        "sectors": studies.sector_buckets(bars, market.sectors),
        "mapped": universe.sector_coverage(bars, market.sectors),
        "neutral_vs_raw": studies.neutral_vs_raw(raw, bars, market.sectors, horizon),
        "cross_section": studies.cross_section_size(transforms.prepare(raw, market.sectors)),
        "sanity": studies.return_sanity(bars),
        "moves": studies.largest_moves(bars),
    }
