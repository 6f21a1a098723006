"""Shared plumbing: tables, checkpoints in the cluster's shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))


#: cuts after which the driver's memory is collected: plans and metrics of many small steps fill its heap up to its bound else
CUTS = 4
_cuts = 0


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably and cut its lineage (survives lost executors)."""
    global _cuts
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    _cuts += 1
    if _cuts % CUTS == 0:
        release(df.sparkSession)
    return done


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of results that nothing refers to any more.

    It does so when the driver's memory is collected, which long chains of small steps alone rarely bring about.
    Freed memory of the driver's Python goes back too.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


#: rows that go to a Python worker at once; texts may be long, and Spark's default of 10,000 is meant for numbers
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has smaller ones already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Give freed memory back at the end of a task: Python workers are kept, beside a heap of Spark's that fills up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: rows of a key beyond which it is hot, keys that are broadcast at most (under 100 bytes each), and tasks that salting deals a key over
HOT, BROADCAST_KEYS, SALTS = 1000, 200_000, 32
#: edges that connected_components() closes on the driver (16 bytes each, about 100 with what is made of them: 50 MB)
FEW_EDGES = 500_000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a table of unique keys; `count` is a column of it: how many rows each key has.

    Rows of hot keys are salted, which few enough hot keys tell by a broadcast; with more, all rows are. So
    no key's rows go to one task, and rows are read once. The table is read more than once: cut it before.
    """
    hot = table.where(F.col(count) > HOT)
    n = hot.count()
    if not n:
        return rows.join(table, on, how)
    salt, every = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1))
    if n <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("__hot"))), on, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
        dealt = table.withColumn("__salt", F.explode(F.when(F.col(count) > HOT, every).otherwise(F.array(F.lit(0)))))
    else:
        rows, dealt = rows.withColumn("__salt", salt), table.withColumn("__salt", F.explode(every))
    return rows.join(dealt, [*on, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a long, b long) -> (node, comp): comp is the smallest node of the component.

    Alternating large-star / small-star rounds: every node keeps one row per neighbour, so a hub with a
    third of all nodes is one key with many *rows*, whose minimum is a map-side combined aggregate and
    meets them by join_counted(); no group is ever gathered in one task. Ends when a round changes nothing.
    Self edges are allowed (they make isolated nodes). Nulls are dropped. Up to FEW_EDGES are closed on the
    driver, as every round is a dozen jobs whose plans and metrics weigh more there than so few edges.
    """
    spark = edges.sparkSession
    e = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= FEW_EDGES:
        return spark.createDataFrame(_closed(e.toArrow()))
    before = None
    for _ in range(max_rounds):
        e = _round(e)
        release(spark)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")))
    return nodes.groupBy("node").agg(F.min("comp").alias("comp"))


def _closed(e: pa.Table) -> pa.Table:
    """node, comp of edges (u, v), by hooking the larger one of two roots to the smaller one and halving paths."""
    ends = np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]).astype(np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    u, v, root = at[: len(e)], at[len(e) :], np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root != (up := root[root])).any():
            root = up
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return pa.table({"node": nodes, "comp": nodes[root]})


def _round(e: DataFrame) -> DataFrame:
    # large star: join every larger neighbour to the smallest neighbour
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")))
    hubs = low.where(F.col("c") > HOT).limit(1).count() > 0  # without any, none comes about in the small star
    large = (join_counted(both, low, ["u"], "c") if hubs else both.join(low, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(e.where("u = v"))
    large = large.distinct()
    # small star: join every smaller neighbour (and the node) to the smallest one
    low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    pairs = join_counted(large, cut(low2), ["u"], "c") if hubs else large.join(low2, "u")
    small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u >= v")
    return cut(small.union(e.where("u = v")).distinct())
