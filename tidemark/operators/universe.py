"""Point-in-time universes: snapshots, change logs, sector maps, liquidity screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SECTOR_ETFS
from ..functions.stats import by_ticker, rolling


def quarter_ends(calendar: DataFrame) -> DataFrame:
    """snapshot_date: quarter ends from the calendar's first date to its last, and the last date if it is later."""
    span = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    ends = span.select(F.explode(F.sequence(F.trunc("lo", "quarter"), F.trunc("hi", "quarter"), F.expr("interval 3 months"))).alias("q"), "lo", "hi")
    ends = ends.select(F.last_day(F.add_months("q", 2)).alias("d"), "lo", "hi").where("d between lo and hi").select("d")
    return ends.union(span.select("hi")).distinct().withColumnRenamed("d", "snapshot_date")


def snapshots_kept(snapshots: DataFrame, least: int = 400) -> DataFrame:
    """Snapshots with at least `least` different tickers."""
    n = snapshots.groupBy("snapshot_date").agg(F.count_distinct("ticker").alias("n")).where(F.col("n") >= least).select("snapshot_date")
    return snapshots.join(F.broadcast(n), "snapshot_date", "left_semi")


def membership_asof(snapshots: DataFrame, calendar: DataFrame, least: int = 1) -> DataFrame:
    """date, ticker of members: each date has the last snapshot's tickers; dates before the first have the first's.

    Snapshot dates become intervals (a few dozen rows), which each date meets in a broadcast range join.
    """
    kept = snapshots_kept(snapshots, least)
    days = kept.select("snapshot_date").distinct()
    w = Window.orderBy("snapshot_date")
    spans = days.select("snapshot_date", F.lead("snapshot_date").over(w).alias("until"), F.row_number().over(w).alias("k"))
    on = ((F.col("date") >= F.col("snapshot_date")) | (F.col("k") == 1)) & (F.col("until").isNull() | (F.col("date") < F.col("until")))
    return calendar.join(F.broadcast(spans), on).select("date", "snapshot_date").join(kept, "snapshot_date").select("date", "ticker").distinct()


def membership_changelog(current: DataFrame, changes: DataFrame, calendar: DataFrame) -> DataFrame:
    """date, ticker of members, undoing changes(date, added, removed) that are later than the date.

    A ticker's state on a day is decided by its first change after that day: removed later means it was
    a member, added later that it was not; without one it is as it is now. All changes of one day count
    (an addition and a removal of one ticker on the same day: it was a member before).
    """
    events = changes.where("date is not null").select("date", F.explode(F.array(F.struct(F.col("added").alias("ticker"), F.lit(0).alias("was")), F.struct(F.col("removed").alias("ticker"), F.lit(1).alias("was")))).alias("e"))
    events = events.where("e.ticker is not null").groupBy(F.col("e.ticker").alias("ticker"), "date").agg(F.max("e.was").alias("was"))
    now = current.select("ticker").distinct().withColumn("was", F.lit(1))
    w = Window.partitionBy("ticker").orderBy("date")
    spans = events.select("ticker", F.lag("date").over(w).alias("from_date"), F.col("date").alias("until"), "was")
    last = events.groupBy("ticker").agg(F.max("date").alias("from_date")).join(now, "ticker", "full").select("ticker", "from_date", F.lit(None).cast("date").alias("until"), F.coalesce("was", F.lit(0)).alias("was"))
    spans = spans.unionByName(last).where("was = 1")
    # the calendar is one sorted array (a row per trading date): each span takes its slice of it
    days = calendar.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("days"))
    inside = F.filter("days", lambda d: (F.col("from_date").isNull() | (d >= F.col("from_date"))) & (F.col("until").isNull() | (d < F.col("until"))))
    return spans.crossJoin(F.broadcast(days)).select(F.explode(inside).alias("date"), "ticker")


def etf_universe(spark: SparkSession, calendar: DataFrame) -> DataFrame:
    """date, ticker, is_member: sector ETFs from their first day on."""
    rows = ", ".join(f"('{t}', date'{d}')" for t, _, d in SECTOR_ETFS)
    etfs = spark.sql(f"select * from values {rows} as e(ticker, first_day)")
    return calendar.crossJoin(F.broadcast(etfs)).select("date", "ticker", (F.col("date") >= F.col("first_day")).alias("is_member"))


def mask(scores: DataFrame, membership: DataFrame, value: str = "score") -> DataFrame:
    """Scores of names that are no members on the date become null; rows stay."""
    marked = membership.select("date", "ticker").distinct().withColumn("__in", F.lit(True))
    return scores.join(marked, ["date", "ticker"], "left").withColumn(value, F.when(F.col("__in"), F.col(value))).drop("__in")


def liquidity_filter(membership: DataFrame, grid: DataFrame, min_dollar_volume: float, min_price: float, window: int = 21) -> DataFrame:
    """membership(date, ticker, is_member) and liquid: rolling mean dollar volume and price at or above both bounds."""
    value = F.col("close") * F.col("volume")
    liquid = grid.withColumn("__dv", value).withColumn("__adv", rolling(F.avg, F.col("__dv"), window, max(5, window // 2), by_ticker()))
    liquid = liquid.select("date", "ticker", F.coalesce((F.col("__adv") >= min_dollar_volume) & (F.col("close") >= min_price), F.lit(False)).alias("liquid"))
    return membership.join(liquid, ["date", "ticker"], "left").select("date", "ticker", (F.coalesce("is_member", F.lit(False)) & F.coalesce("liquid", F.lit(False))).alias("is_member"))


def constituents(rows: DataFrame) -> DataFrame:
    """Rows (seq, ticker, ...) with clean tickers: dots become hyphens, upper case, well-formed, the first of each."""
    t = F.upper(F.trim(F.replace(F.col("ticker"), F.lit("."), F.lit("-"))))
    good = rows.withColumn("ticker", t).where(F.col("ticker").rlike(r"^[A-Z][A-Z0-9\-]{0,6}$"))
    return good.withColumn("__k", F.row_number().over(Window.partitionBy("ticker").orderBy("seq"))).where("__k = 1").drop("__k")


def sector_map(*sources: DataFrame) -> DataFrame:
    """ticker, sector from several maps; earlier ones win, blank labels count as missing."""
    tagged = [s.select("ticker", "sector", F.lit(k).alias("k")) for k, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.where("ticker is not null and trim(sector) <> ''").groupBy("ticker").agg(F.min_by("sector", F.struct("k", "sector")).alias("sector"))


def first_seen_sectors(snapshots: DataFrame, existing: DataFrame | None = None, keep_existing: bool = True) -> DataFrame:
    """Each ticker's first non-blank label over snapshots(snapshot_date, ticker, sector), merged with an existing map.

    The map may only grow: a merge cannot lose tickers, whichever side wins.
    """
    seen = snapshots.where("trim(sector) <> ''").groupBy("ticker").agg(F.min_by("sector", F.struct("snapshot_date", "sector")).alias("sector"))
    if existing is None:
        return seen
    return sector_map(existing, seen) if keep_existing else sector_map(seen, existing)


def sector_coverage(tickers: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row: share of tickers with a sector, and whether that is under 90 percent."""
    joined = tickers.select("ticker").distinct().join(sectors.select("ticker", "sector"), "ticker", "left")
    return joined.agg(F.avg(F.col("sector").isNotNull().cast("double")).alias("coverage")).withColumn("warn", F.col("coverage") < 0.9)


def build(method: str, calendar: DataFrame, snapshots: DataFrame | None = None, current: DataFrame | None = None, changes: DataFrame | None = None, cached: DataFrame | None = None, least: int = 400) -> DataFrame:
    """Membership by `snapshots` or `changelog`; a cached one is used only if it has every date asked for."""
    if cached is not None and calendar.join(cached.select("date").distinct(), "date", "left_anti").limit(1).count() == 0:
        return cached.join(calendar, "date", "left_semi")
    if method == "snapshots":
        if snapshots is None or snapshots_kept(snapshots, least).limit(1).count() == 0:
            raise RuntimeError("no usable snapshot")
        return membership_asof(snapshots, calendar, least)
    if method == "changelog":
        return membership_changelog(current, changes, calendar)
    raise ValueError(f"unknown method {method!r}")


def survivorship(membership: DataFrame) -> DataFrame:
    """One row: tickers ever in, median members of a date, and the gap between them."""
    ever = membership.agg(F.count_distinct("ticker").alias("ever_members"))
    per = membership.groupBy("date").agg(F.count_distinct("ticker").alias("n")).agg(F.percentile("n", 0.5).alias("median_members"))
    return ever.crossJoin(per).withColumn("gap", F.col("ever_members") - F.col("median_members"))
