"""The store, the vendor's and the wiki connectors, on fixtures."""

import datetime as dt

import pandas as pd
import pytest

from tidemark import catalog
from tidemark.sources import vendor, wiki
from tidemark.sources.store import Store

PAGE = """
<table><tr><th>Other</th></tr><tr><td>x</td></tr></table>
<table class="wikitable">
<tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th><th>Date added</th></tr>
<tr><td>BRK.B</td><td>Berkshire<sup>[1]</sup></td><td>Financials</td><td>Multi</td><td>2010-02-16</td></tr>
<tr><td> msft </td><td>Microsoft</td><td>Information Technology</td><td>Software</td><td></td></tr>
<tr><td>MSFT</td><td>Again</td><td>Else</td><td></td><td></td></tr>
<tr><td>123</td><td>Bad</td><td>X</td><td></td><td></td></tr>
</table>
<table>
<tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th><th rowspan="2">Reason</th></tr>
<tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>
<tr><td rowspan="2">June 24, 2024</td><td>KKR</td><td>KKR</td><td>RHI</td><td>Half</td><td>r</td></tr>
<tr><td>CRWD</td><td>Crowd</td><td>nan</td><td></td><td>r</td></tr>
<tr><td>someday</td><td>AA</td><td></td><td></td><td></td><td></td></tr>
</table>
"""


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.summary().count() == 0 and s.is_stale("a", 1) and s.load("a") == {"a": None}
    with pytest.raises(FileNotFoundError):
        s.read("a")
    s.write("a", spark.range(5), {"note": "x"})
    s.write("a", spark.range(7))
    assert s.exists("a") and s.read("a").count() == 7 and s.names() == ["a"]
    assert not s.is_stale("a", 1) and s.is_stale("a", -1)
    assert s.sql("select sum(id) as s from a").first().s == 21
    assert tuple(s.summary().first())[:2] == ("a", 7)
    assert s.export(f"file://{tmp_path}/out", ["a", "b"]) == ["b: missing"]
    (tmp_path / "store" / "._manifest.json.crc").unlink()
    (tmp_path / "store" / "_manifest.json").write_text("{broken")
    assert s.manifest() == {}


def _rows(tickers, start, end):
    return pd.DataFrame([(d, t, 1.0 + i, 10.0) for t in tickers for i, d in enumerate(pd.bdate_range(start, end))], columns=["date", "ticker", "close", "volume"])


def test_vendor_retries_and_reuses(spark, tmp_path):
    calls, waits = [], []

    def fetch(tickers, start, end):
        calls.append(tickers)
        if len(calls) == 1:
            raise OSError("down")
        return _rows(tickers, start, end)

    s = Store(spark, f"file://{tmp_path}/store")
    bars = vendor.ingest(s, fetch, ["B", "A", None, "A"], "2024-01-01", "2024-02-01", sleep=waits.append, pause=0)
    assert calls == [["A", "B"], ["A", "B"]] and waits[0] == 2.0
    assert bars.select("ticker").distinct().count() == 2 and s.exists("px_quality")
    vendor.ingest(s, fetch, ["A", "B"], "2024-01-03", "2024-02-03", sleep=waits.append)
    assert len(calls) == 2  # covered
    vendor.ingest(s, fetch, ["A", "B", "C"], "2024-01-03", "2024-02-03", sleep=waits.append)
    assert len(calls) == 3  # too few tickers
    with pytest.raises(RuntimeError):
        vendor.ingest(s, lambda *a: None, ["Q"], "2024-01-01", "2024-02-01", name="q", sleep=waits.append)
    got, missing = vendor.fetch_proxies(s, lambda t, a, b: _rows([x for x in t if x != "LQD"], a, b), "2024-01-01", "2024-02-01", sleep=waits.append)
    assert missing == ["LQD"] and got.select("name").distinct().count() == 4


def test_wiki_tables(spark):
    pages = spark.createDataFrame([(dt.date(2024, 7, 1), PAGE), (dt.date(2024, 8, 1), None), (dt.date(2024, 9, 1), "<p>none</p>")], "page date, html string")
    got = {r.ticker: (r.name, r.sector) for r in wiki.parse_constituents(pages).collect()}
    assert got == {"BRK-B": ("Berkshire", "Financials"), "MSFT": ("Microsoft", "Information Technology")}
    changes = {(r.date, r.added, r.removed) for r in wiki.parse_changes(pages).collect()}
    assert changes == {(dt.date(2024, 6, 24), "KKR", "RHI"), (dt.date(2024, 6, 24), "CRWD", None)}
    assert [t["columns"][:2] for t in wiki.describe(PAGE)][2] == ["date", "added_ticker"]


def test_wiki_revisions(spark):
    assert wiki.revision_id('{"query": {"pages": {"1": {"revisions": [{"revid": 7}]}}}}') == 7 and wiki.revision_id("{}") is None
    assert "rvlimit=1" in wiki.revision_url("T", "2024-01-01T00:00:00Z", "https://example.org/w/api.php")
    revs = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 2, 1))], "revid int, at date")
    dates = spark.createDataFrame([(dt.date(2023, 12, 1),), (dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),)], "date date")
    assert {(r.date.month, r.revid) for r in wiki.latest_revisions(revs, dates).collect()} == {(1, 1), (2, 2)}


def test_http_and_csv_fetchers(tmp_path):
    import http.server
    import threading

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.path.startswith("/A")
            self.send_response(200 if known else 404)
            self.send_header("Content-Type", "text/csv; charset=utf-8")
            self.end_headers()
            self.wfile.write("Date,Close, Volume\n2024-01-02,1.5,10\n2024-01-03,,20\n".encode() if known else b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}"
        fetch = vendor.csv_fetcher(lambda t, a, b: f"{root}/{t}?from={a}&to={b}", wiki.http_get)
        rows = vendor.fetch_batch(fetch, ["A", "AB"], "2024-01-01", "2024-01-05", sleep=lambda _: None)
        assert rows["ticker"].tolist() == ["A", "A", "AB", "AB"] and rows.columns.tolist() == ["date", "ticker", "close", "volume"]
        with pytest.raises(RuntimeError):
            vendor.fetch_batch(fetch, ["none"], "2024-01-01", "2024-01-05", sleep=lambda _: None)
    finally:
        server.shutdown()


def test_batches_are_written_as_they_come(spark, tmp_path):
    def fetch(tickers, start, end):
        rows = _rows(tickers, start, end)
        return rows.drop(columns="volume") if "C" in tickers else rows

    got = vendor.download(spark, fetch, ["A", "B", "C"], "2024-01-01", "2024-01-10", f"file://{tmp_path}/in", batch_size=2, pause=0)
    assert got.columns == ["date", "ticker", "close", "volume"] and got.where("ticker = 'C' and volume is null").count() == 8 and got.where("ticker <> 'C' and volume = 10").count() == 16


def test_a_vendor_that_is_a_table(spark, tmp_path):
    rows = spark.createDataFrame(_rows(["A", "B", "C"], "2024-01-01", "2024-01-10"))
    asked = []

    def fetch(tickers, start, end):
        asked.append(tickers)
        return rows.where(rows.ticker.isin(tickers))

    got = vendor.download(spark, fetch, ["A", "B", "C", "Z"], "2024-01-01", "2024-01-10", f"file://{tmp_path}/in", batch_size=2, pause=0, sleep=lambda _: None)
    assert asked == [["A", "B"], ["C", "Z"]] and got.dtypes == [("date", "date"), ("ticker", "string"), ("close", "double"), ("volume", "double")]
    assert got.count() == 24 and got.select("ticker").distinct().count() == 3
    with pytest.raises(RuntimeError):
        vendor.download(spark, fetch, ["Z"], "2024-01-01", "2024-01-10", f"file://{tmp_path}/none", pause=0, sleep=lambda _: None)


def test_no_panel_comes_to_the_driver(spark, monkeypatch):
    frame = type(spark.range(0))

    def no(self):
        raise AssertionError("a panel came to the driver")

    monkeypatch.setattr(frame, "toPandas", no)
    for name in ("vendor_ingest", "vendor_quality"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_long_tickers(spark):
    head = "<tr><th>Symbol</th><th>Security</th><th>GICS Sector</th></tr>"
    pages = spark.createDataFrame([(1, f"<table>{head}<tr><td>s1000.a</td><td>x</td><td>y</td></tr><tr><td>s10000.a</td><td>x</td><td>y</td></tr><tr><td>1.a</td><td>x</td><td>y</td></tr></table>")], "page int, html string")
    assert [r.ticker for r in wiki.parse_constituents(pages).collect()] == ["S1000-A"]
    assert sorted(r.ticker for r in wiki.parse_constituents(pages, longest=None).collect()) == ["S1000-A", "S10000-A"]


def test_export_query_has_no_notes_on_file_sizes(spark, monkeypatch):
    monkeypatch.setattr(Store.export, "__defaults__", (0.0, 0.0))  # as if every dataset were large
    assert catalog.queries()["store_export"](spark, "/root/testdata/sf0.001").first().notes == "none: missing"
