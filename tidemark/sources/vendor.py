"""Price ingestion from a vendor through an injected fetcher, cached in a store.

A fetcher takes (tickers, start, end) and returns long pandas rows: date, ticker and any of close,
volume, open, high, low. Batches are fetched on the driver, as vendors limit their callers' rate;
batches are written as they come. A vendor whose bars are a table already returns a Spark DataFrame of
these columns, of which nothing comes to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..operators import prices
from .panels import dense
from .store import Store

Fetch = Callable[[list[str], str, str], pd.DataFrame | DataFrame]
FIELDS = ("close", "volume", "open", "high", "low")
TRIES, BACKOFF_S, BATCH, TOLERANCE_DAYS = 3, 2.0, 50, 7


def fetch_batch(fetch: Fetch, tickers: list[str], start: str, end: str, sleep: Callable[[float], None] = time.sleep) -> pd.DataFrame | DataFrame:
    """Up to three tries with growing pauses; an empty answer or one without price fields counts as a failure."""
    problem: Exception | None = None
    for attempt in range(1, TRIES + 1):
        try:
            rows = fetch(tickers, start, end)
            if isinstance(rows, DataFrame):
                if set(FIELDS) & set(rows.columns) and not rows.isEmpty():
                    return rows.select("date", "ticker", *[f for f in FIELDS if f in rows.columns])
            elif rows is not None and len(rows) and set(FIELDS) & set(rows.columns):
                if "ticker" not in rows.columns and len(tickers) == 1:  # one ticker: flat columns
                    rows = rows.assign(ticker=tickers[0])
                return rows[["date", "ticker", *[f for f in FIELDS if f in rows.columns]]]
            problem = ValueError("no prices in the answer")
        except Exception as error:  # vendors raise anything
            problem = error
        if attempt < TRIES:
            sleep(BACKOFF_S * attempt)
    raise RuntimeError(f"no prices after {TRIES} tries: {problem}")


def csv_fetcher(url_of: Callable[[str, str, str], str], get: Callable[[str], str]) -> Fetch:
    """A fetcher of vendors that hand out one CSV a ticker with date, open, high, low, close, volume in any order and case."""
    import io

    def fetch(tickers: list[str], start: str, end: str) -> pd.DataFrame:
        parts = []
        for t in tickers:
            rows = pd.read_csv(io.StringIO(get(url_of(t, start, end))))
            rows.columns = [c.strip().lower() for c in rows.columns]
            parts.append(rows.assign(ticker=t))
        return pd.concat(parts, ignore_index=True)

    return fetch


def wanted(tickers) -> list[str]:
    return sorted({t for t in tickers if isinstance(t, str) and t})


def download(spark: SparkSession, fetch: Fetch, tickers, start: str, end: str, folder: str, batch_size: int = BATCH, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """date, ticker and the fields there are, of all batches; batches that fail are left out.

    Each batch is written to the folder as it comes, so the driver holds one of them, the plan doesn't
    grow with the tickers, and what was fetched outlives a later failure.
    """
    names, written = wanted(tickers), 0
    for i in range(0, len(names), batch_size):
        try:
            rows = fetch_batch(fetch, names[i : i + batch_size], start, end, sleep)
        except RuntimeError:
            continue
        if isinstance(rows, DataFrame):
            part = rows.select(F.col("date").cast("date"), F.col("ticker").cast("string"), *[F.col(f).cast("double") for f in rows.columns[2:]])
        else:
            shape = ", ".join(["date date", "ticker string", *(f"{f} double" for f in rows.columns[2:])])
            rows = rows.assign(date=pd.to_datetime(rows["date"]).dt.date).astype({f: "float64" for f in rows.columns[2:]})
            part = spark.createDataFrame(rows, shape)
        part.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in rows.columns[2:]}).write.mode("append" if written else "overwrite").parquet(folder)
        written += 1
        sleep(pause)
    if not written:
        raise RuntimeError("ingestion returned no prices")
    got = spark.read.option("mergeSchema", "true").parquet(folder)
    return got.select("date", "ticker", *[f for f in FIELDS if f in got.columns])


def covers(cached: DataFrame, tickers: list[str], start: str, end: str, least: float) -> bool:
    """Whether the cached bars have enough of the tickers and, within a week, the dates."""
    lo, hi = cached.agg(F.min("date"), F.max("date")).first()
    if lo is None:
        return False
    have = {r[0] for r in cached.select("ticker").distinct().join(F.broadcast(cached.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")), "ticker").collect()} if tickers else set()
    slack = pd.Timedelta(days=TOLERANCE_DAYS)
    dates = pd.Timestamp(lo) <= pd.Timestamp(start) + slack and pd.Timestamp(hi) >= pd.Timestamp(end) - slack
    return len(have) / max(len(tickers), 1) >= least and dates


def ingest(store: Store, fetch: Fetch, tickers, start: str, end: str, name: str = "px", refresh: bool = False, least: float = 0.95, **kw) -> DataFrame:
    """Bars from the store if they cover what is asked for; else fetched, checked and stored with a quality table."""
    names = wanted(tickers)
    if not refresh and store.exists(f"{name}_bars"):
        cached = store.read(f"{name}_bars")
        if covers(cached, names, start, end, least):
            return cached
    bars = download(store.spark, fetch, names, start, end, f"{store.root}/_incoming_{name}", **kw)
    if "close" not in bars.columns:
        raise RuntimeError("ingestion returned no close prices")
    store.write(f"{name}_bars", bars, {"start": start, "end": end, "n_tickers": bars.select("ticker").distinct().count()})
    bars = store.read(f"{name}_bars")
    store.write(f"{name}_quality", prices.quality(dense(bars.select("date", "ticker", "close"))))
    return bars


def fetch_proxies(store: Store, fetch: Fetch, start: str, end: str, refresh: bool = False, **kw) -> tuple[DataFrame, list[str]]:
    """name, date, px of the five proxies, and the names that are missing; stored ones are used if all five are there."""
    if not refresh and store.exists("proxies"):
        cached = store.read("proxies")
        if cached.select("name").distinct().where(F.col("name").isin(*SETTINGS.proxies)).count() == len(SETTINGS.proxies):
            return cached, []
    got = download(store.spark, fetch, SETTINGS.proxies, start, end, f"{store.root}/_incoming_proxies", **kw).select(F.col("ticker").alias("name"), "date", F.col("close").alias("px"))
    store.write("proxies", got)
    have = {r[0] for r in got.select("name").distinct().collect()}
    return store.read("proxies"), [p for p in SETTINGS.proxies if p not in have]
