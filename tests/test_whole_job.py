"""Queries over whole tables: no rows, signals, horizons or simulations left out."""

from tests.test_oracle import SF, _key, _plain, duck  # noqa: F401
from tidemark import catalog
from tidemark.operators import universe
from tidemark.plans import studies


def same(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    want = sorted((tuple(map(_plain, r)) for r in duck.sql(catalog.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()), key=_key)
    assert got == want
    return [dict(zip(columns, r, strict=True)) for r in got]


def test_change_log_has_every_line(spark, duck):  # noqa: F811
    _, log = catalog.changes(spark, SF)
    lines = "select l_shipdate::date, l_suppkey, l_orderkey % 2 from lineitem where l_shipdate is not null"
    assert log.where("date is not null").count() == duck.sql(f"select count(*) from (select distinct * from ({lines}) t(a, b, c))").fetchone()[0]
    same(spark, duck, "membership_changelog")


def test_neutral_scores_of_all_signals(spark, duck):  # noqa: F811
    assert {r["signal"] for r in same(spark, duck, "sector_neutralize")} == set(catalog.NAMES)
    assert {r["signal"] for r in same(spark, duck, "diagnostics_neutral_vs_raw")} == set(catalog.NAMES)


def test_null_has_all_simulations(spark):
    row = catalog.queries()["null_calibration"](spark, SF).first()
    assert row.n_sims == 500 and row.null_p05 < row.null_p95 < row.null_p99 and row.significant == (row.p_value < 0.05)


def test_all_horizons(spark, duck):  # noqa: F811
    assert {(r["signal"], r["horizon"]) for r in same(spark, duck, "ic_decay")} == {(s, h) for s in catalog.NAMES for h in (1, 5, 21, 63)}
    assert {"t_1", "t_5", "t_21", "t_63"} <= set(same(spark, duck, "horizon_sweep")[0])
    assert same(spark, duck, "significance")[0]["trials"] == 28
    same(spark, duck, "strongest_cell")


def test_predictive_horizons(spark):
    assert sorted(r.horizon for r in catalog.queries()["predictive_test"](spark, SF).collect()) == [5, 21, 63]


def test_whole_sector_map(spark, duck):  # noqa: F811
    assert [r["coverage"] for r in same(spark, duck, "sector_coverage")] == [1.0]
    assert "_UNMAPPED" not in {r["sector"] for r in same(spark, duck, "diagnostics_sectors")}
    assert not any(r["sector"].startswith("N") for r in same(spark, duck, "sector_map_priority"))


def test_missing_labels(spark):
    grid = spark.createDataFrame([("2024-01-05", t, 1.0) for t in "ABCD"], "date string, ticker string, close double")
    first = spark.createDataFrame([("A", "X"), ("B", " "), ("C", "Y")], "ticker string, sector string")
    second = spark.createDataFrame([("A", "Z"), ("B", "Z"), ("D", "")], "ticker string, sector string")
    whole = universe.sector_map(first, second)
    assert {r.ticker: r.sector for r in whole.collect()} == {"A": "X", "B": "Z", "C": "Y"}
    row = universe.sector_coverage(grid, whole).first()
    assert row.coverage == 0.75 and row.warn
    assert {r.sector: r.n for r in studies.sector_buckets(grid, whole).collect()} == {"X": 1, "Y": 1, "Z": 1, "_UNMAPPED": 1}
