"""Panels in long form (date, ticker, close, volume) from transaction tables, and their grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def friday_of(day: Column) -> Column:
    """The Friday that ends a date's Saturday-to-Friday week."""
    return F.next_day(F.date_sub(day.cast("date"), 1), "FRI")


def cents() -> Column:
    return F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double")


def bars(rows: DataFrame, ticker: Column, date: Column) -> DataFrame:
    """Volume-weighted price and volume by ticker and date; prices are summed in whole cents, so no order of rows shows."""
    price = cents() / (F.sum("l_quantity") * 100)
    return rows.select("l_extendedprice", "l_quantity", ticker.cast("string").alias("ticker"), date.alias("date")).where("date is not null").groupBy("ticker", "date").agg(price.alias("close"), F.sum("l_quantity").cast("double").alias("volume"))


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return bars(rows, F.col("l_suppkey"), friday_of(F.col("l_shipdate")))


def part_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return bars(rows, F.col("l_partkey"), F.trunc(F.col("l_shipdate"), "quarter"))


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"))


def region_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, date, px: daily regional prices standing in for the five market proxies."""
    names = F.element_at(F.create_map(*[F.lit(x) for pair in (("AFRICA", "VIX"), ("AMERICA", "SPY"), ("ASIA", "TLT"), ("EUROPE", "HYG"), ("MIDDLE EAST", "LQD")) for x in pair]), F.col("sector"))
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    joined = rows.join(supplier_regions(spark, sf_dir), F.col("l_suppkey").cast("string") == F.col("ticker"))
    return joined.where("date is not null").groupBy(names.alias("name"), "date").agg((cents() / (F.sum("l_quantity") * 100)).alias("px"))


def dense(panel: DataFrame) -> DataFrame:
    """Every ticker on every date of the panel; missing cells are null.

    The calendar is one small array (a row per trading date), so each ticker expands its own rows;
    facts then join on the grid's key.
    """
    calendar = panel.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    grid = panel.select("ticker").distinct().crossJoin(F.broadcast(calendar)).select("ticker", F.explode("dates").alias("date"))
    return grid.join(panel, ["ticker", "date"], "left")


def carried_forward(panel: DataFrame) -> DataFrame:
    """A dense panel with each ticker's last close carried over gaps (an option for sparse panels)."""
    from ..functions.stats import by_ticker

    return panel.withColumn("close", F.last("close", True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()
