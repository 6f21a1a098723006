"""Queries against their SQL in DuckDB on the same tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: those that show every operator family; the driver compares all of them
CHOSEN = [
    "panel_weekly", "forward_returns", "price_quality", "clean_prices", "clean_report", "liquidity_filter", "membership_asof",
    "membership_changelog", "survivorship_gap", "etf_universe", "constituent_filter", "sector_map_priority", "signals_all",
    "membership_mask", "rank_share", "prepare", "rebalance_sample", "combine_weighted", "display_rankings", "ic_spearman",
    "ic_decay", "quantile_returns", "quantile_summary", "turnover", "signal_correlation", "league_table", "positions",
    "backtest_daily", "performance_stats", "walk_forward_splits", "walk_forward_report", "sentiment_index", "predictive_stats",
    "coincident_test", "timed_market", "ablation_neutral", "rank_autocorr", "book_overlap", "spanning_factors", "fold_signs",
    "return_sanity", "store_sql_view", "store_roundtrip", "store_manifest", "cache_summary", "store_staleness", "store_load", "store_export",
    "wiki_constituents", "wiki_changes", "wiki_table_scores", "wiki_change_scores", "wiki_snapshots", "wiki_revisions", "vendor_ingest",
    "vendor_quality", "vendor_proxies", "synthetic_bars", "synthetic_latent", "synthetic_membership", "synthetic_proxies",
    "equity_drawdown", "causal_percentile", "registry_describe", "deflated_sharpe", "rank_normalize", "ic_summary_p", "lag_sandbox",
    "ablation_folds", "ablation_verdict", "predictive_test", "spanning_regression", "walkforward_signs", "preregistered_run",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return v.date() if isinstance(v, datetime.datetime) else v


def _key(row):
    return tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in row)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(_plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=_key)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_sql_is_text():
    assert all(isinstance(s, str) for s in entry.oracle_sql().values())
