"""Invariants of the research engine on synthetic markets, hand-computed cases and the semantic traps."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import newey_west_lags
from tidemark.functions import stats
from tidemark.operators import backtest as bt
from tidemark.operators import evaluation as ev
from tidemark.operators import inference, prices, sentiment, signals, transforms, universe
from tidemark.plans import studies
from tidemark.sources import panels, synthetic


def days(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def panel(spark, values, **more):
    """values: ticker -> list of closes."""
    rows = [(d, t, x, *(m[t][i] for m in more.values())) for t, xs in values.items() for i, (d, x) in enumerate(zip(days(len(xs)), xs, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["date date", "ticker string", "close double", *(f"{k} double" for k in more)]))


def long(spark, matrix, signal="s", tickers=None):
    tickers = tickers or [f"T{i:03d}" for i in range(len(matrix[0]))]
    rows = [(d, t, signal, None if x is None else float(x)) for d, r in zip(days(len(matrix)), matrix, strict=True) for t, x in zip(tickers, r, strict=True)]
    return spark.createDataFrame(rows, "date date, ticker string, signal string, score double")


# --- returns ---


@pytest.mark.parametrize("lag,first", [(1, 0.10), (0, 0.10)])
def test_forward_returns_hand_computed(spark, lag, first):
    g = panel(spark, {"A": [100.0, 110.0, 121.0, 133.1, 146.41]})
    got = [r.fwd for r in prices.forward_returns(g, (1,), lag).orderBy("date").collect()]
    assert got[0] == pytest.approx(first)
    assert got[-1] is None and (got[-2] is None) == (lag == 1)


def test_forward_returns_need_a_horizon(spark):
    with pytest.raises(ValueError):
        prices.forward_returns(panel(spark, {"A": [1.0, 2.0]}), (0,))


def test_returns_do_not_fill_gaps_or_divide_by_zero(spark):
    g = panel(spark, {"A": [100.0, None, 121.0, 121.0], "Z": [0.0, 5.0, 5.0, 5.0]})
    r = {(x.ticker, x.date): x.ret for x in prices.returns(g).collect()}
    d = days(4)
    assert [r["A", x] for x in d] == [None, None, None, 0.0]
    assert r["Z", d[1]] is None and r["Z", d[2]] == 0.0


def test_clean_masks_once_and_drops_thin_names(spark):
    g = panel(spark, {"A": [10.0, 30.0, 30.0, 31.0], "B": [1.0, None, None, None], "C": [None] * 4}, volume={"A": [1.0, 2.0, 3.0, 4.0], "B": [1.0] * 4, "C": [1.0] * 4})
    got = {(x.ticker, x.date): (x.close, x.volume) for x in prices.clean(g, 1.0, 2).collect()}
    d = days(4)
    assert {t for t, _ in got} == {"A"}
    assert got["A", d[1]] == (None, 2.0) and got["A", d[2]] == (30.0, 3.0)
    report = prices.clean_report(g, 1.0, 2).first()
    assert (report["empty"], report.thin, report.kept, report.masked) == (1, 1, 1, 1)


# --- cross-section ---


def test_average_rank_and_spearman_equal_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (6, 30)).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    y = rng.normal(size=x.shape)
    y[rng.random(y.shape) < 0.1] = np.nan
    s = long(spark, [[None if np.isnan(v) else v for v in r] for r in x])
    f = long(spark, [[None if np.isnan(v) else v for v in r] for r in y]).select("date", "ticker", F.lit(1).alias("horizon"), F.col("score").alias("fwd"))
    got = [r.ic for r in ev.information_coefficient(s, f, least=5).orderBy("date").collect()]
    assert all(r.n >= 20 for r in ev.information_coefficient(s, f).collect())
    a, b = pd.DataFrame(x).rank(axis=1), pd.DataFrame(y).rank(axis=1)
    want = [a.loc[i][b.loc[i].notna()].corr(b.loc[i][a.loc[i].notna()]) for i in range(len(a))]
    assert got == pytest.approx(want, abs=1e-12)


def test_constant_cross_section_has_no_ic(spark):
    s = long(spark, [[1.0] * 25])
    f = long(spark, [list(range(25))]).select("date", "ticker", F.lit(1).alias("horizon"), F.col("score").alias("fwd"))
    assert ev.information_coefficient(s, f).count() == 0


def test_quantile_buckets_equal_qcut(spark):
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=23).tolist(), rng.integers(0, 4, 23).astype(float).tolist(), [2.0] * 23, [None] * 3 + rng.normal(size=20).tolist()]
    got = stats.with_bucket(long(spark, rows), "score", 5, ("date",), "b").orderBy("date", "ticker").collect()
    got = np.array([np.nan if r.b is None else r.b for r in got]).reshape(4, 23)
    for k, row in enumerate(rows):
        s = pd.Series(row, dtype=float)
        want = pd.qcut(s, 5, labels=False, duplicates="drop") if s.nunique() > 1 else s * np.nan
        np.testing.assert_array_equal(got[k], want.to_numpy(float))


def test_prepare_equals_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 12))
    x[2, 3:5] = np.nan
    sector = ["a"] * 5 + ["b"] * 4 + ["lonely"] + [None] * 2
    tickers = [f"T{i:03d}" for i in range(12)]
    sectors = spark.createDataFrame([(t, s) for t, s in zip(tickers, sector, strict=True) if s], "ticker string, sector string")
    got = transforms.prepare(long(spark, [[None if np.isnan(v) else v for v in r] for r in x]), sectors).orderBy("date", "ticker").collect()
    got = np.array([np.nan if r.score is None else r.score for r in got]).reshape(x.shape)
    df = pd.DataFrame(x, columns=tickers)
    df = df.clip(df.quantile(0.01, axis=1), df.quantile(0.99, axis=1), axis=0)
    bucket = pd.Series([s or "_UNMAPPED" for s in sector], index=tickers)
    for _, names in bucket.groupby(bucket).groups.items():
        if len(names) > 1:
            df[names] = df[names].sub(df[names].mean(axis=1), axis=0)
    want = df.sub(df.mean(axis=1), axis=0).div(df.std(axis=1), axis=0).to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_prepare_and_combine_refuse_bad_input(spark):
    s = long(spark, [[1.0, 2.0]])
    with pytest.raises(ValueError):
        transforms.prepare(s, method="other")
    with pytest.raises(ValueError):
        transforms.combine(s, {"other": 1.0})
    with pytest.raises(ValueError):
        transforms.combine(s, {"s": 0.0})


def test_no_sectors_means_no_neutralisation(spark):
    s = long(spark, [[1.0, 2.0]])
    assert transforms.sector_neutralize(s, None) is s
    empty = spark.createDataFrame([], "ticker string, sector string")
    assert sorted(r.score for r in transforms.sector_neutralize(s, empty).collect()) == [1.0, 2.0]


# --- synthetic markets ---


@pytest.fixture(scope="module")
def market(spark):
    m = synthetic.make_market(spark, 420, 60, signal_strength=0.05, seed=23)
    return {k: v.persist() for k, v in m.items()}


def test_planted_effect_is_found_and_noise_is_not(spark):
    for make, found in ((lambda: synthetic.make_market(spark, 600, 60, signal_strength=0.05, seed=3), True), (lambda: synthetic.make_pure_noise(spark, 600, 60, seed=5), False)):
        m = make()
        p = transforms.prepare(m["latent"].withColumn("signal", F.lit("latent")), m["sectors"], neutralize=False)
        s = ev.ic_summary(ev.information_coefficient(p, prices.forward_returns(m["bars"], (1,)))).first()
        if found:
            assert s.mean_ic > 0.02 and s.t_stat > 3
        else:
            assert abs(s.mean_ic) < 0.02 and abs(s.t_stat) < 3


def test_neutral_and_standard_scores(spark, market):
    z = transforms.zscore(market["latent"]).groupBy("date").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s")).agg(F.max(F.abs("m")), F.max(F.abs(F.col("s") - 1))).first()
    assert max(z) < 1e-9
    n = transforms.sector_neutralize(market["latent"], market["sectors"]).join(market["sectors"], "ticker")
    sizes = market["sectors"].groupBy("sector").count().where("count > 1")
    assert n.join(sizes, "sector").groupBy("date", "sector").agg(F.avg("score").alias("m")).agg(F.max(F.abs("m"))).first()[0] < 1e-9


def test_opposed_signals_cancel(spark, market):
    a = transforms.zscore(market["latent"])
    both = a.withColumn("signal", F.lit("a")).unionByName(a.withColumn("score", -F.col("score")).withColumn("signal", F.lit("b")))
    assert transforms.combine(both).agg(F.max(F.abs("score"))).first()[0] < 1e-9


def test_all_signals_and_membership(spark, market):
    r = signals.default_registry()
    assert len(r) == 7 and len({s.name for s in r.signals}) == 7
    with pytest.raises(ValueError):
        r.add(signals.LowVolatility())
    m = signals.Market(market["bars"], market["sectors"], market["membership"])
    scores = r.compute_all(m).persist()
    assert scores.select("signal").distinct().count() == 7
    last = scores.where(F.col("date") == scores.agg(F.max("date")).first()[0])
    assert last.groupBy("signal").agg((F.count("score") / F.count(F.lit(1))).alias("c")).agg(F.min("c")).first()[0] > 0.5
    outside = scores.join(market["membership"], ["date", "ticker"], "left_anti")
    assert outside.count() > 0 and outside.where("score is not null").count() == 0
    c = ev.signal_correlation(transforms.prepare(scores, market["sectors"])).collect()
    t = {(x.signal_a, x.signal_b): x.corr for x in c}
    assert all(t[a, a] == 1 for a, _ in t) and all(t[a, b] == t[b, a] and abs(t[a, b]) <= 1.0001 for a, b in t)


def test_signals_equal_pandas(spark, market):
    close = market["bars"].toPandas().pivot(index="date", columns="ticker", values="close")
    volume = market["bars"].toPandas().pivot(index="date", columns="ticker", values="volume")
    ret = close.pct_change(fill_method=None)
    cum = (1 + ret.sub(ret.mean(axis=1), axis=0).fillna(0)).cumprod()
    want = {
        "Momentum12_1": close.shift(21) / close.shift(252) - 1,
        "ShortTermReversal": -(close / close.shift(21) - 1),
        "LowVolatility": -ret.rolling(63, min_periods=31).std(),
        "TrendStrength": (close / close.rolling(200, min_periods=100).mean() - 1) / ret.rolling(63, min_periods=31).std(),
        "LiquidityTurnover": -np.log((close * volume).rolling(63, min_periods=31).mean()),
        "IdiosyncraticMomentum": cum.shift(21) / cum.shift(252) - 1,
        "VolumeShock": -np.log(volume.rolling(5, min_periods=2).mean() / volume.rolling(63, min_periods=31).mean()),
    }
    got = signals.default_registry().compute_all(signals.Market(market["bars"])).toPandas()
    for name, w in want.items():
        g = got[got.signal.str.startswith(name + "_")].pivot(index="date", columns="ticker", values="score")
        np.testing.assert_allclose(g.to_numpy(float), w.to_numpy(float), rtol=1e-8, atol=1e-10)


def test_backtest_is_neutral_and_costs_hurt(spark, market):
    s = transforms.zscore(market["latent"]).withColumn("signal", F.lit("x")).select("date", "ticker", "score")
    book = bt.positions(transforms.weekly(s))
    net = book.groupBy("date").agg(F.abs(F.sum("w")).alias("n"), F.sum(F.abs("w")).alias("g")).agg(F.max("n"), F.max("g")).first()
    assert net[0] < 1e-9 and net[1] == pytest.approx(1)
    r = bt.backtest(s, market["bars"]).agg(F.min("cost"), F.max(F.col("net") - F.col("gross"))).first()
    assert r[0] >= 0 and r[1] <= 0


def test_small_cross_section_is_flat_and_names_leave(spark):
    s = long(spark, [[float(i) for i in range(25)], [None] * 10 + [float(i) for i in range(15)]]).select("date", "ticker", "score")
    b = bt.positions(s).groupBy("date").agg(F.sum(F.abs("w")).alias("g"), F.count("*").alias("n")).orderBy("date").collect()
    assert [r.g for r in b] == [pytest.approx(1.0), 0.0] and [r.n for r in b] == [25, 25]


def test_performance_figures(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.01, 60)
    df = spark.createDataFrame(list(zip(days(60), x.tolist(), strict=True)), "date date, net double")
    p = bt.performance(df).first()
    curve = np.cumprod(1 + x)
    assert p.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(252))
    assert p.max_drawdown == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())
    assert p.skew == pytest.approx(pd.Series(x).skew())
    short = bt.performance(df.limit(10)).first()
    assert all(v is None for v in short)


def test_splits_respect_the_embargo(spark):
    dates = spark.createDataFrame([(d,) for d in days(1200, "2016-01-01")], "date date")
    folds = bt.walk_forward_splits(dates).orderBy("fold").collect()
    assert len(folds) >= 3 and all((f.test_start - f.train_end).days >= 21 for f in folds)
    with pytest.raises(ValueError):
        bt.split_bounds(100)


def test_deflated_sharpe_rises_with_trials():
    assert bt.deflated_sharpe(44, 0.0, 2952)["hurdle"] > bt.deflated_sharpe(7, 0.0, 2952)["hurdle"] > 0
    assert np.isnan(bt.deflated_sharpe(0, 0.0, 100)["hurdle"])
    assert newey_west_lags(1) == 0 and newey_west_lags(5) == 4


def test_mean_t_equals_the_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0.02, 0.1, 80).cumsum() * 0.1 + rng.normal(size=80)
    df = spark.createDataFrame([(d, "s", float(v)) for d, v in zip(days(80), x, strict=True)], "date date, signal string, ic double")
    got = stats.mean_t(df, "ic", 4, ["signal"]).first()
    _, t, _ = stats.ols_hac(x, np.zeros((80, 0)), 4)
    assert got.t_stat == pytest.approx(t[0]) and got.n == 80


def test_ols_hac_by_hand():
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=50), rng.normal(size=50)
    y = 1 + 2 * x + e
    beta, t, r2 = stats.ols_hac(y, x[:, None], 2)
    X = np.column_stack([np.ones(50), x])
    u = y - X @ beta
    S = sum(np.outer(X[i] * u[i], X[j] * u[j]) * max(0, 1 - abs(i - j) / 3) for i in range(50) for j in range(50))
    V = np.linalg.inv(X.T @ X) @ S @ np.linalg.inv(X.T @ X)
    assert t == pytest.approx(beta / np.sqrt(np.diag(V))) and r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)


# --- calendars and universes ---


def test_weeks_end_on_friday_and_empty_ones_vanish(spark):
    d = [dt.date(2024, 3, 28), dt.date(2024, 3, 30), dt.date(2024, 4, 2), dt.date(2024, 4, 10)]  # Good Friday week, a Saturday, midweek, an empty week
    s = spark.createDataFrame([(d[0], "A", 1.0), (d[1], "A", 2.0), (d[2], "A", None), (d[3], "A", None)], "date date, ticker string, score double")
    got = {r.date: r.score for r in transforms.weekly(s).collect()}
    assert got == {dt.date(2024, 3, 29): 1.0, dt.date(2024, 4, 5): 2.0}


def test_membership_asof_uses_the_first_snapshot_before_it(spark):
    snaps = spark.createDataFrame([(dt.date(2024, 2, 1), "A"), (dt.date(2024, 3, 1), "B")], "snapshot_date date, ticker string")
    cal = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 1),)], "date date")
    got = {(r.date, r.ticker) for r in universe.membership_asof(snaps, cal).collect()}
    assert got == {(dt.date(2024, 1, 5), "A"), (dt.date(2024, 2, 29), "A"), (dt.date(2024, 3, 1), "B")}
    with pytest.raises(RuntimeError):
        universe.build("snapshots", cal, snapshots=snaps, least=400)
    with pytest.raises(ValueError):
        universe.build("other", cal)


def test_changelog_undoes_all_changes_of_a_day(spark):
    current = spark.createDataFrame([("A",), ("B",)], "ticker string")
    log = spark.createDataFrame([(dt.date(2024, 2, 1), "A", "X"), (dt.date(2024, 2, 1), "B", "Y"), (None, "Z", None)], "date date, added string, removed string")
    cal = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),)], "date date")
    got = {(r.date.day, r.ticker) for r in universe.membership_changelog(current, log, cal).collect()}
    assert got == {(31, "X"), (31, "Y"), (1, "A"), (1, "B")}


def test_sector_maps_take_the_first(spark):
    a = spark.createDataFrame([("A", "x"), ("B", " ")], "ticker string, sector string")
    b = spark.createDataFrame([("A", "y"), ("B", "z")], "ticker string, sector string")
    assert {r.ticker: r.sector for r in universe.sector_map(a, b).collect()} == {"A": "x", "B": "z"}


# --- sentiment ---


def test_causal_percentile_looks_back_only(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 20, 60).astype(float)
    x[[5, 17]] = np.nan
    df = spark.createDataFrame([(d, None if np.isnan(v) else float(v)) for d, v in zip(days(60), x, strict=True)], "date date, v double")
    got = [r.p for r in df.withColumn("p", stats.causal_percentile(F.col("v"), 30, 10, sentiment.dates())).orderBy("date").collect()]
    for i in range(60):
        w = x[max(0, i - 29) : i + 1]
        w = w[~np.isnan(w)]
        want = None if np.isnan(x[i]) or len(w) < 10 else 100 * (w < x[i]).sum() / len(w)
        assert got[i] == (None if want is None else pytest.approx(want))


def test_labels_and_exposures(spark):
    df = spark.createDataFrame([(v,) for v in (None, 0.0, 25.0, 45.0, 55.0, 75.0, 120.0)], "v double")
    rows = df.select(sentiment.label(F.col("v")), sentiment.exposure(F.col("v")), sentiment.exposure(F.col("v"), "momentum")).collect()
    assert [r[0] for r in rows] == ["unavailable", "extreme fear", "fear", "neutral", "greed", "extreme greed", "extreme greed"]
    assert rows[0][1] is None and rows[1][1] == 1.5 and rows[6][1] == 0.5 and rows[6][2] == 1.5
    with pytest.raises(ValueError):
        sentiment.exposure(F.col("v"), "sideways")


def test_index_averages_what_there_is(spark):
    m = synthetic.make_market(spark, 320, 20, seed=3)
    d = [r[0] for r in m["bars"].select("date").distinct().orderBy("date").collect()]
    i = sentiment.index(synthetic.make_proxies(spark, d), m["bars"], window=100, least=50).toPandas().set_index("date")
    names = list(sentiment.COMPONENTS)
    want = i[names].astype(float).mean(axis=1)
    np.testing.assert_allclose(i["composite"].astype(float), want)
    assert (i["n_components"] == i[names].notna().sum(axis=1)).all()
    px = sentiment.fallback_market(synthetic.make_proxies(spark, d), m["bars"])
    assert px.count() == len(d)


def test_null_calibration_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n, h, sims, block, seed = 420, 5, 60, 21, 9
    days = pd.bdate_range("2020-01-01", periods=n).date
    px, x = 100 * np.cumprod(1 + rng.normal(0, 0.01, n)), rng.uniform(0, 100, n)
    sent = spark.createDataFrame(pd.DataFrame({"date": days, "composite": x}), "date date, composite double")
    market = spark.createDataFrame(pd.DataFrame({"date": days, "px": px}), "date date, px double")
    row = inference.null_calibration(sent, market, h, sims, block, seed, least=100).first()
    ret = px[1:] / px[:-1] - 1

    def slope(path):
        p = np.cumprod(1 + path)
        f = p[1 + h :] / p[1:-h] - 1
        z = np.column_stack([np.ones(len(f)), x[1:][: len(f)]])
        beta, *_ = np.linalg.lstsq(z, f, rcond=None)
        g = z * (f - z @ beta)[:, None]
        meat = g.T @ g
        for k in range(1, h):
            meat += (1 - k / h) * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:])
        inv = np.linalg.inv(z.T @ z)
        return beta[1] / np.sqrt((inv @ meat @ inv)[1, 1])

    want = []
    for k in range(sims):
        starts = np.random.default_rng([seed, k]).integers(0, len(ret) - block, size=-(-len(ret) // block))
        want.append(slope(np.concatenate([ret[i : i + block] for i in starts])[: len(ret)]))
    want = np.array(want)
    assert row.observed_t == pytest.approx(slope(ret)) and row.n_sims == sims
    assert row.null_mean_t == pytest.approx(want.mean()) and row.null_std_t == pytest.approx(want.std(ddof=1))
    assert row.null_p95 == pytest.approx(np.quantile(abs(want), 0.95)) and row.p_value == pytest.approx((abs(want) >= abs(row.observed_t)).mean())


def test_normal_quantiles_and_tails(spark):
    from statistics import NormalDist

    p = [1e-12, 1e-6, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9249, 0.9251, 0.999, 1 - 1e-6]
    z = [0.0, 0.1, -1.0, 1.96, -3.0, 5.0, 7.0, 7.2, 12.0]
    got = spark.createDataFrame([(x,) for x in [*p, None]], "p double").select(stats.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got[:-1]] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-12) and got[-1][0] is None
    got = spark.createDataFrame([(x,) for x in [*z, None]], "z double").select(stats.two_sided(F.col("z"))).collect()
    assert [r[0] for r in got[:-1]] == pytest.approx([stats.two_sided_p(x) for x in z], rel=1e-8, abs=1e-300) and got[-1][0] is None
    rows = long(spark, [[3.0, 1.0, 1.0, None, 7.0]])
    r = transforms.rank_normalize(rows).orderBy("ticker").collect()
    want = [NormalDist().inv_cdf(min(max(x, 1e-6), 1 - 1e-6)) if x else None for x in (0.75, 0.375, 0.375, None, 1.0)]
    assert [x.score for x in r] == [w if w is None else pytest.approx(w) for w in want]
    hurdle = spark.range(1, 60).select("id", bt.sharpe_hurdle(F.col("id"), F.lit(2952)).alias("h")).collect()
    assert all(x.h == pytest.approx(bt.deflated_sharpe(x.id, 0.0, 2952)["hurdle"]) for x in hurdle)


def test_spanning_regression_equals_numpy(spark, market):
    m = signals.Market(market["bars"], market["sectors"], market["membership"])
    one = transforms.prepare(signals.Registry().add(signals.ShortTermReversal(lookback=5)).compute_all(m), market["sectors"])
    got = {r.term: r for r in studies.spanning_regression(one, market["bars"], lags=3).collect()}
    book = bt.pnl(bt.positions(transforms.weekly(one)), market["bars"], cost_bps=0).select("date", "gross")
    x = book.join(studies.spanning_factors(market["bars"]), "date").dropna().orderBy("date").toPandas()
    z, y = np.column_stack([np.ones(len(x)), x["market"], x["megacap_spread"]]), x["gross"].to_numpy()
    beta = np.linalg.solve(z.T @ z, z.T @ y)
    g = z * (y - z @ beta)[:, None]
    meat = sum((1 - abs(k) / 4) * (g[max(k, 0) : len(g) + min(k, 0)].T @ g[max(-k, 0) : len(g) + min(-k, 0)]) for k in range(-3, 4))
    inv = np.linalg.inv(z.T @ z)
    t = beta / np.sqrt(np.diag(inv @ meat @ inv))
    for k, name in enumerate(("const", "market", "megacap_spread")):
        assert got[name].coef == pytest.approx(beta[k]) and got[name].t_stat == pytest.approx(t[k]) and got[name].n == len(x)


def test_studies_run_on_a_synthetic_market(spark, market):
    m = signals.Market(market["bars"], market["sectors"], market["membership"])
    r = signals.Registry().add(signals.ShortTermReversal(lookback=5)).add(signals.LowVolatility(window=21))
    p = transforms.prepare(r.compute_all(m), market["sectors"]).persist()
    one = p.where(F.col("signal").startswith("Low"))
    assert studies.rank_autocorrelation(one, (1, 21)).count() == 2
    o = {x.weeks: x.overlap for x in studies.book_overlap(one, (1, 13)).collect()}
    assert 0 <= o[13] <= o[1] <= 1
    assert studies.spanning_regression(one, market["bars"]).count() == 3
    assert studies.sign_selection(p, market["bars"], 5, 3, 21).count() >= 2
    assert studies.persistence_verdict(0.9, 1.0) == "supported" and studies.persistence_verdict(0.9, 3.0) == "mixed" and studies.persistence_verdict(None, None) == "not supported"


def test_dense_panels(spark):
    sparse = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 1.0), (dt.date(2024, 1, 2), "B", 2.0), (dt.date(2024, 1, 3), "A", 3.0)], "date date, ticker string, close double")
    g = panels.dense(sparse)
    assert g.count() == 6 and g.where("close is null").count() == 3
    filled = {(r.ticker, r.date.day): r.close for r in panels.carried_forward(g).collect()}
    assert filled["A", 2] == 1.0 and filled["B", 1] is None and filled["B", 3] == 2.0


# --- whole runs ---


def test_preregistered_ablation_and_diagnosis(spark, market):
    from tidemark.plans import research

    m = signals.Market(market["bars"], market["sectors"], market["membership"])
    r = signals.Registry().add(signals.ShortTermReversal(lookback=5)).add(signals.LowVolatility(window=21))
    got = research.preregistered(m, r.signals[1].name, r, (1, 5), 5, (1, 21), (1, 13, 52), 3, 21)
    a = got["accounting"].first()
    assert (a.trials, a.prior, a.cumulative) == (4, 7, 11) and a.hurdle == pytest.approx(bt.deflated_sharpe(11, 0.0, 420)["hurdle"])
    assert a.max_abs_t == pytest.approx(max(abs(x.t_stat) for x in got["sweep"].collect())) and got["strongest"].first().survivors >= 0
    assert got["static_bet"] in ("supported", "mixed", "not supported") and got["signs"] in ("supported", "weak", "not supported")
    folds = got["folds"].collect()
    assert len(folds) == 3 and got["signs"] == research.sign_verdict([x.signed_sharpe - x.naive_sharpe for x in folds])
    d = [x[0] for x in market["bars"].select("date").distinct().orderBy("date").collect()]
    p = synthetic.make_proxies(spark, d)
    i = sentiment.index(p, market["bars"], window=100, least=50)
    ab = research.ablation(m, i, sentiment.fallback_market(p, market["bars"]), r, 3, 21)
    assert {x.variant for x in ab["neutral"].collect()} == {"no sentiment", "contrarian", "momentum"} and ab["folds"].count() == 9
    sharpe = {(x.variant, x.fold): x.sharpe for x in ab["folds"].collect()}
    for v in ab["verdict"].collect():
        assert v.wins == sum(sharpe[v.variant, f] > sharpe["buy and hold", f] for f in (1, 2, 3)) and v.adds_value == (v.wins >= 3)
    dia = research.diagnosis(m, r)
    assert dia["coverage"].first().tickers == 60 and dia["mapped"].first().coverage == 1.0 and dia["neutral_vs_raw"].count() == 2 and dia["cross_section"].count() == 2 and dia["moves"].count() == 8


def test_synthetic_markets_are_keyed(spark):
    a = synthetic.make_market(spark, 40, 12, seed=4)
    whole = {(r.date, r.ticker): (r.close, r.volume) for r in a["bars"].collect()}
    more = {(r.date, r.ticker): (r.close, r.volume) for r in synthetic.make_market(spark, 60, 30, seed=4)["bars"].repartition(7).collect()}
    assert all(more[k] == v for k, v in whole.items()) and len(whole) == 480
    days = sorted({d for d, _ in whole})
    assert days == list(pd.bdate_range("2015-01-01", periods=40).date)
    z = spark.range(4000).select(synthetic.normal(synthetic.draw(1, "t", F.col("id"))).alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05 and abs((z.abs() < 1.96).mean() - 0.95) < 0.02


def test_research_and_sentiment_reports(spark, market, tmp_path):
    from tidemark.plans import research
    from tidemark.sources.store import Store

    r = signals.Registry().add(signals.ShortTermReversal(lookback=5)).add(signals.LowVolatility(window=21))
    got = research.research(signals.Market(market["bars"], market["sectors"], market["membership"]), r)
    assert got["league"].count() == 2 and got["stats"].count() == 2 and got["walk_forward"].count() >= 3 and got["haircut"].first().trials == 2
    small = market["bars"].where("ticker < 'SYN0010'")
    with pytest.raises(ValueError):
        research.research(signals.Market(small), r)
    d = [x[0] for x in market["bars"].select("date").distinct().orderBy("date").collect()]
    store = Store(spark, f"file://{tmp_path}/store")
    rep = research.sentiment_report(synthetic.make_proxies(spark, d), market["bars"], store=store, n_sims=50, window=100, least=50)
    assert rep["verdict"] in ("predictive", "not predictive", "coincident", "inconclusive") and store.exists("sentiment_index")
    assert research.verdict(4.0, True, 0, 0) == "predictive" and research.verdict(4.0, False, 0, 0) == "not predictive" and research.verdict(1.0, False, 0.9, 0.1) == "coincident"
    assert research.sign_verdict([1.0, 1.0, 1.0, -1.0]) == "supported" and research.sign_verdict([3.0, -1.0]) == "weak" and research.sign_verdict([]) == "not supported"


def test_live_load(spark, tmp_path):
    from tidemark.plans import research
    from tidemark.sources.store import Store

    snaps = spark.createDataFrame([(dt.date(2024, 1, 31), "A", "x"), (dt.date(2024, 1, 31), "B", None)], "snapshot_date date, ticker string, sector string")

    def fetch(tickers, start, end):
        return pd.DataFrame([(x, t, 10.0 + i, 1e6) for t in tickers for i, x in enumerate(pd.bdate_range(start, end))], columns=["date", "ticker", "close", "volume"])

    m = research.load_live(Store(spark, f"file://{tmp_path}/s"), fetch, snaps, spark.createDataFrame([("B", "y")], "ticker string, sector string"), "2024-01-01", "2024-03-01", min_obs=10, least=1, pause=0)
    assert {r.ticker: r.sector for r in m.sectors.collect()} == {"A": "x", "B": "y"}
    assert m.membership.select("ticker").distinct().count() == 2 and m.membership.agg(F.min("date")).first()[0] == dt.date(2024, 1, 12)


def test_sparse_scores_are_filled(spark):
    g = panel(spark, {f"T{i:02d}": [100.0 + i + d for d in range(15)] for i in range(20)})
    s = prices.returns(g).select("date", "ticker", F.col("close").alias("score"))
    sparse = s.where("not (ticker = 'T19' and date > '2024-01-05')")
    a = bt.backtest(sparse, g, dense=False, least=10).orderBy("date").collect()
    null = s.withColumn("score", F.when(F.expr("not (ticker = 'T19' and date > '2024-01-05')"), F.col("score")))
    b = bt.backtest(null, g, least=10).orderBy("date").collect()
    assert [r.net for r in a] == pytest.approx([r.net for r in b])
