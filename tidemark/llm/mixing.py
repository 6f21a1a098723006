"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected until the
weights' entropy meets a target, or to the flattest mixture in which no source is repeated more than
a limit (the larger alpha if both are asked for). Each source then gets a token budget; it is spent
in whole permutations of the source's documents, one an epoch, and in the first blocks of one more:
a row's keyed hash of the epoch places it in a block, blocks follow each other until the budget is
reached, and the block that it ends in is cut inside. Sums are found in two levels, of many blocks and
of one, so only such sums and the rows of the last block are ordered; no source is ever gathered,
however large its share.

Defined cases: null sources are one source of their own; null texts have no tokens; a source without
tokens is emitted once; an empty table gives no rows; copies of a row that agree in everything are
chosen or left together, and so are other rows of one hash (ties); very long texts are one row like
others, their words counted whole. Without a budget the budget is the smallest that emits every row at
least once. Extra columns stay; epoch, position and n_tokens of the input are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_REPEATS, SEED = 2.0, 17
#: expected rows of a block, and sources whose sums the driver takes; with more, sums stay distributed
BLOCK_ROWS, DRIVER_SOURCES = 1024, 100_000
#: blocks whose sums are summed up
SUM_BLOCKS = 1024
STEPS = 60


def word_count(text: Column) -> Column:
    """Words parted by white space, of a whole text."""
    t = F.trim(F.regexp_replace(text, r"^\s+", ""))
    return F.when(text.isNull() | ~text.rlike(r"\S"), 0).otherwise(F.size(F.split(t, r"\s+")) - F.when(t.rlike(r"\s$"), 1).otherwise(0)).cast("bigint")


def entropy_of(sums: Callable[[float], tuple[float, float]], alpha: float) -> float:
    """From (sum p^a, sum p^a log p) at alpha."""
    z, y = sums(alpha)
    return math.log(z) - alpha * y / z


def bisect(ok: Callable[[float], bool], low: float, high: float) -> float:
    """The smallest alpha from low to high for which ok holds from there on (high if nowhere)."""
    if ok(low):
        return low
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def choose_alpha(sums: Callable[[float], tuple[float, float]], least: float, most: float, total: float, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """least and most: the smallest and largest share. Repeats of a source of share p at alpha: budget / total * p^(alpha-1) / Z."""
    alpha = 0.0 if target_entropy is not None or max_repeats is not None else 1.0
    if target_entropy is not None:
        alpha = max(alpha, bisect(lambda a: entropy_of(sums, a) <= target_entropy, 0.0, 16.0))
    if max_repeats is not None:

        def repeats(a: float) -> float:
            rare = least ** (a - 1) if a < 1 else most ** (a - 1)
            often = most ** (a - 1) if a < 1 else least ** (a - 1)
            # without a budget the source repeated least is emitted once
            return rare / often if budget is None else budget / total * rare / sums(a)[0]

        alpha = max(alpha, bisect(lambda a: repeats(a) <= max_repeats * (1 + 1e-12), 0.0, 1.0))
    return alpha


def plan(rows: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None, driver_sources: int = DRIVER_SOURCES) -> DataFrame | None:
    """rows(source, tokens) -> source, tokens, weight, spend (its token budget), epochs (whole), rest."""
    spark = rows.sparkSession
    per = common.cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    k, total, least, most = per.where("tokens > 0").agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not k:
        return None
    total = float(total)
    if k <= driver_sources:
        p = np.array([r[0] for r in per.where("tokens > 0").select("tokens").collect()], float) / total

        def sums(a: float) -> tuple[float, float]:
            x = p**a
            return float(x.sum()), float((x * np.log(p)).sum())
    else:

        def sums(a: float) -> tuple[float, float]:
            s = F.col("tokens") / total
            return tuple(per.where("tokens > 0").agg(F.sum(F.pow(s, F.lit(a))), F.sum(F.pow(s, F.lit(a)) * F.log(s))).first())

    alpha = choose_alpha(sums, least / total, most / total, total, target_entropy, max_repeats, budget)
    z = sums(alpha)[0]
    once = max((least / total) ** (1 - alpha), (most / total) ** (1 - alpha)) * z * total  # every source at least once
    spend = F.col("weight") * float(once if budget is None else budget)
    out = per.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(alpha)) / z).otherwise(0.0)).withColumn("spend", spend)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("spend") / F.col("tokens") * (1 + 1e-12))).otherwise(1).cast("int")
    return out.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("spend") - F.col("epochs") * F.col("tokens"))).withColumn("alpha", F.lit(alpha))


def _unit(row: Column, epoch: Column, seed: int) -> Column:
    """A row's place in an epoch's permutation, in [0, 1)."""
    return F.pmod(F.xxhash64(row, epoch, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def mix(docs: DataFrame, source: str = "source", text: str = "text", tokens: Callable[[Column], Column] = word_count, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = SEED, block_rows: int = BLOCK_ROWS, sum_blocks: int = SUM_BLOCKS) -> DataFrame:
    """docs, each row once an epoch it is in, + epoch, position (its place in the mixture's order), n_tokens."""
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "position", "n_tokens")]
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if c in kept and not kind.startswith("map")])
    # the table's own columns travel as one, so no name of theirs meets one of these
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{source}`").alias("__source"), tokens(F.col(f"`{text}`")).alias("n_tokens"), row.alias("__row"))
    slim = common.cut(base.select(F.col("__source").alias("source"), F.col("n_tokens").alias("tokens"), F.col("__row").alias("row")))
    shares = plan(slim, target_entropy, max_repeats, budget)
    if shares is None:
        return base.select("own.*", F.lit(0).alias("epoch"), F.lit(0.0).alias("position"), "n_tokens")
    shares = common.cut(shares)
    small = shares.count() <= DRIVER_SOURCES
    by_source = F.broadcast(shares) if small else shares

    # tokens of each block of the last, partial epoch; blocks are cut off by the hash, so their order is one too
    placed = slim.join(by_source.select(F.col("source").alias("s"), "epochs", "rest", "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.where("rest > 0").withColumn("unit", _unit(F.col("row"), F.col("epochs"), seed))
    placed = placed.withColumn("block", F.floor(F.col("unit") * F.ceil(F.col("n") / block_rows)).cast("bigint"))
    blocks = common.cut(placed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("many", F.floor(F.col("block") / sum_blocks)))

    def ending(sums: DataFrame, by: str, start: Column) -> DataFrame:
        """The row of each source in which its rest ends, with the tokens before it."""
        earlier = F.sum("tokens").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
        at = sums.withColumn("before", start + F.coalesce(earlier, F.lit(0)))
        return at.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))

    coarse = ending(blocks.groupBy("source", "many", "rest").agg(F.sum("tokens").alias("tokens")), "many", F.lit(0))
    coarse = common.cut(coarse.select(F.col("source").alias("s"), F.col("many").alias("m"), F.col("before").alias("so_far")))
    fine = blocks.join(F.broadcast(coarse) if small else coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("many") == F.col("m")))
    last = ending(fine, "block", F.col("so_far"))
    last = common.cut(last.select(F.col("source").alias("s"), F.col("block").alias("b"), "before"))
    inside = placed.join(F.broadcast(last) if small else last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("unit"))
    cut = inside.withColumn("run", F.col("before") + run).groupBy("source").agg(F.min(F.when(F.col("run") > F.col("rest"), F.col("unit"))).alias("cut"))
    # a source whose rest ends in no block takes none of it (rest 0) or, by rounding, all
    shares = shares.alias("a").join(cut.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")), "left")
    shares = shares.select(F.col("source").alias("s"), "tokens", "spend", "epochs", F.coalesce("cut", F.when(F.col("rest") > 0, 2.0).otherwise(0.0)).alias("cut"))
    shares = common.cut(shares)
    out = base.join(F.broadcast(shares) if small else shares, F.col("__source").eqNullSafe(F.col("s")))
    more = (_unit(F.col("__row"), F.col("epochs"), seed) < F.col("cut")).cast("int")
    copies = F.col("epochs") + more
    out = out.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    turns = F.when(F.col("tokens") > 0, F.col("spend") / F.col("tokens")).otherwise(1.0)
    position = (F.col("epoch") + _unit(F.col("__row"), F.col("epoch"), seed)) / turns
    return out.withColumn("position", position).select("own.*", "epoch", "position", "n_tokens")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "epoch", "position", "n_tokens")
