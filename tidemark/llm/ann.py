"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (max_sample rows); every row is then sent down it to the leaf
of the nearest centres. A query visits leaves in the order in which a priority queue over the tree's
nodes yields them (best inner product with a node's centre plus its spread first). How many leaves
are visited is calibrated: a bounded set of the queries is answered exactly, in blocks over all rows,
and the visits widen until these queries' recall reaches the target.

Neighbouring leaves are stored together in blocks of bounded size, a hot leaf in several. A query
travels once to each block that holds leaves it visits, with the list of these leaves, and meets
their rows alone; so its vector is written once a block, not once a leaf.

Nearness is the largest inner product, in double precision on the original vectors; ties go to the
smaller id.

Defined cases: null ids, null, empty or zero vectors, and vectors with null or non-finite components
or another length than the table's most common one take no part; an empty table gives no rows;
fewer candidates than k are all returned. A vec_id counts once, as a query and as a candidate: of
several vectors under one id, the smallest in array order stands for it. Equal vectors under
different ids are all candidates. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: rows of the sample that the tree is fitted on, children of a node, and rows a leaf should hold
MAX_SAMPLE, BRANCH, LEAF_ROWS = 20_000, 8, 64
#: queries that calibrate, the recall they have to reach, and how the visits widen
CALIBRATE, TARGET, WIDEN = 256, 0.93, 1.05
#: bytes of a stored block's vectors (as doubles), queries of a travelling one, and travelling ones that one task meets
BLOCK_BYTES, QUERIES, TURNS = 8 << 20, 256, 64
SEED = 13


@dataclass
class Tree:
    """Nodes in breadth-first order; children of node i are first[i] to first[i] + count[i] - 1, leaves have none."""

    centre: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the child with the nearest centre."""
        at = np.zeros(len(x), np.int64)
        todo = np.arange(len(x)) if self.count[0] else np.zeros(0, np.int64)
        while len(todo):
            for node in np.unique(at[todo]):
                rows = todo[at[todo] == node]
                c = self.centre[self.first[node] : self.first[node] + self.count[node]]
                at[rows] = self.first[node] + (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            todo = todo[self.count[at[todo]] > 0]
        return at

    def visits(self, q: np.ndarray, most: int, sizes: dict[int, int], least_rows: int) -> list[list[int]]:
        """For each query, leaves with rows, best bin first: `most` of them, more until they hold least_rows."""
        key = -(q @ self.centre.T + np.linalg.norm(q, axis=1)[:, None] * self.spread)
        first, count = self.first.tolist(), self.count.tolist()
        out = []
        for k in key.tolist():
            heap, seen, rows = [(k[0], 0)], [], 0
            while heap and (len(seen) < most or rows < least_rows):
                _, node = heapq.heappop(heap)
                if count[node]:
                    for child in range(first[node], first[node] + count[node]):
                        heapq.heappush(heap, (k[child], child))
                elif sizes.get(node):
                    seen.append(node)
                    rows += sizes[node]
            out.append(seen)
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        n = np.bincount(at, minlength=k)
        centre = np.stack([x[at == j].mean(0) if n[j] else x[rng.integers(len(x))] for j in range(k)])
    return centre


def fit_tree(sample: np.ndarray, leaf_sample: float, branch: int = BRANCH, seed: int = SEED) -> Tree:
    """leaf_sample: sample rows that a leaf should hold."""
    rng = np.random.default_rng(seed)
    centre, spread, first, count, rows = [sample.mean(0)], [0.0], [0], [0], [sample]
    node = 0
    while node < len(rows):
        x, rows[node] = rows[node], None
        spread[node] = float(np.sqrt(((x - centre[node]) ** 2).sum(1).mean()))
        k = min(branch, int(np.ceil(len(x) / leaf_sample)))
        if k > 1 and spread[node] > 1e-9:
            c = _kmeans(x, k, rng)
            at = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            used = np.unique(at)
            if len(used) > 1:
                first[node], count[node] = len(rows), len(used)
                for j in used:
                    centre.append(c[j])
                    spread.append(0.0)
                    first.append(0)
                    count.append(0)
                    rows.append(x[at == j])
        node += 1
    return Tree(np.stack(centre), np.array(spread), np.array(first), np.array(count))


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id, v of the rows that take part, each vec_id once, and their number."""
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), v.alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not sizes:
        return rows, 0
    rows = rows.where(F.size("v") == sizes["d"])
    ids = rows.agg(F.count_distinct("vec_id")).first()[0]
    return (rows if ids == sizes["n"] else common.cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")))), ids


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def top(ids: np.ndarray, x: np.ndarray, q_id: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block for one query, its own id and rows without a rough score (-inf) left out; rough scores choose, exact ones order."""
    rough = np.where(ids == q_id, -np.inf, rough)
    rows = np.flatnonzero(rough > -np.inf)
    if len(rows) > k:
        bar = np.partition(rough[rows], len(rows) - k)[len(rows) - k]
        rows = rows[rough[rows] >= bar - 1e-9 * (1 + abs(bar))]
    score = (x[rows] * q).sum(1)  # equal vectors get equal scores, wherever they are stored
    by = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][by], score[by]


class Best:
    """The k best of each query so far."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, q_id: int, ids: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        if q_id in self.of:
            ids, score, *more = (np.concatenate(p) for p in zip(self.of[q_id], (ids, score, *more), strict=True))
            by = np.lexsort((ids, -score))[: self.k]
            ids, score, *more = ids[by], score[by], *(m[by] for m in more)
        self.of[q_id] = (ids, score, *more)

    def frame(self, names: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(q, *v) for q, v in self.of.items()], columns=["query_id", *names])


def exact(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, tree: Tree | None = None) -> pd.DataFrame:
    """A bounded set of queries against all rows in blocks: query_id, ids, score (and leaf) arrays of the k best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for b in batches:
            ids, x = b["vec_id"].to_numpy(), _matrix(b["v"])
            rough = q @ x.T
            kept = [top(ids, x, q_ids[i], q[i], rough[i], k) for i in range(len(q))]
            place = {v: n for n, v in enumerate(ids)}
            leaf = tree.assign(x) if tree else np.zeros(len(x), np.int64)
            for i, (found, score) in enumerate(kept):
                best.add(int(q_ids[i]), found, score, leaf[[place[f] for f in found]])
        yield best.frame(["ids", "score", "leaf"])

    parts = rows.mapInPandas(run, "query_id long, ids array<long>, score array<double>, leaf array<long>")
    together = parts.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("ids", "score", "leaf"))).alias("all"))
    nearest = F.slice(F.array_sort(F.transform("all", lambda x: F.struct((-x["score"]).alias("s"), x["ids"].alias("id"), x["leaf"].alias("leaf")))), 1, k)
    out = together.select("query_id", nearest.alias("n")).toPandas()
    return pd.DataFrame({"query_id": out["query_id"], "ids": [[x["id"] for x in n] for n in out["n"]], "leaf": [[x["leaf"] for x in n] for n in out["n"]]})


def layout(tree: Tree, sizes: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """leaf -> its first block and how many it is dealt over; small leaves that are neighbours share a block."""
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        stack += range(int(tree.first[node]) + int(tree.count[node]) - 1, int(tree.first[node]) - 1, -1) if tree.count[node] else []
        if sizes.get(node):
            order.append(node)
    out, block, held = {}, 0, 0
    for leaf in order:
        n = sizes[leaf]
        if held and held + n > rows:
            block, held = block + 1, 0
        parts = -(-n // rows)
        out[leaf] = (block, parts)
        block, held = (block, held + n) if parts == 1 else (block + parts, 0)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = TARGET, max_sample: int = MAX_SAMPLE, leaf_rows: int = LEAF_ROWS, calibrate: int = CALIBRATE, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict]:
    """Each query's k nearest other rows -> (query_id, rank, vec_id, score) and the index's figures.

    is_query: a condition on vec_id. Figures: rows, queries, leaves, visits, blocks, and recall of the calibration queries.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    rows, total = usable(vectors, key, vector)
    if not total:
        return spark.createDataFrame([], shape), {"rows": 0}
    bucket = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30))
    part = min(1.0, max_sample / total)
    sample = _matrix(rows.where(bucket < int(part * (1 << 30)) + 1).orderBy(bucket, "vec_id").limit(max_sample).toPandas()["v"])
    tree = fit_tree(sample, max(8.0, leaf_rows * len(sample) / total))

    # calibration: exact answers of some queries, and the leaves that hold them
    asked = rows.where(is_query)
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], shape), {"rows": total, "leaves": len(tree.leaves)}
    some = asked.where(bucket < int(min(1.0, 1.5 * calibrate / n_queries) * (1 << 30)) + 1).orderBy(bucket, "vec_id").limit(calibrate).toPandas()
    if not len(some):
        some = asked.orderBy(bucket, "vec_id").limit(calibrate).toPandas()
    q_ids, q = some["vec_id"].to_numpy(), _matrix(some["v"])
    truth = exact(rows, q_ids, q, k, tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.assign(_matrix(b["v"])))

    kind = dict(rows.dtypes)["v"]
    placed = common.cut(rows.mapInPandas(place, f"vec_id long, v {kind}, leaf long"))
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # leaves of a tree fitted on a bounded sample
    order = dict(zip(q_ids.tolist(), tree.visits(q, len(sizes), sizes, 0), strict=True))
    ranks = [order[i].index(leaf) for i, found in zip(truth["query_id"], truth["leaf"], strict=True) for leaf in found]
    most = 1
    while most < len(sizes) and ranks and np.mean(np.array(ranks) < most) < target:
        most = min(len(sizes), max(most + 1, int(most * WIDEN)))
    dims = q.shape[1]
    where = layout(tree, sizes, max(1, block_bytes // (8 * dims)))
    figures = {"rows": total, "queries": n_queries, "leaves": len(sizes), "visits": most, "blocks": max(b + n for b, n in where.values()), "recall": float(np.mean(np.array(ranks) < most)) if ranks else 1.0}

    # stored blocks, dealt over the turns of queries that meet them
    exact_type = "<f4" if kind == "array<float>" else "<f8"
    parts = -(-n_queries // QUERIES)
    turns = -(-parts // TURNS)
    blocks = spark.createDataFrame([(int(leaf), b, n) for leaf, (b, n) in where.items()], "leaf long, block int, over int")

    def store(t: pa.Table) -> pa.Table:
        t = t.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(exact_type)
        packed = [t["block"][0].as_py(), t["vec_id"].to_numpy().tobytes(), t["leaf"].to_numpy().tobytes(), x.tobytes()]
        return pa.table([pa.array([c], f) for c, f in zip(packed, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "ids", "leaves", "x"])

    dealt = placed.join(F.broadcast(blocks), "leaf").select("vec_id", "v", "leaf", (F.col("block") + F.pmod(F.xxhash64("vec_id"), F.col("over"))).cast("int").alias("block"))
    stored = dealt.groupBy("block").applyInArrow(store, "block int, ids binary, leaves binary, x binary").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    least_rows = k + 1

    def travel(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids, x = t["vec_id"].to_numpy(), np.stack(t["v"].to_numpy()).astype(exact_type)
        at: dict[int, tuple[list[int], list[int]]] = {}
        for i, leaves in enumerate(tree.visits(x.astype(np.float64), most, sizes, least_rows)):
            for leaf in leaves:
                first, over = where[leaf]
                for block in range(first, first + over):
                    who, what = at.setdefault(block, ([], []))
                    who.append(i)
                    what.append(leaf)
        turn, out = t["part"][0].as_py() // TURNS, []
        for block, (who, what) in at.items():
            some, spot = np.unique(who, return_inverse=True)
            out.append((block, turn, ids[some].tobytes(), x[some].tobytes(), spot.astype(np.int64).tobytes(), np.array(what, np.int64).tobytes()))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(list(c), f) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "turn", "q_ids", "q", "who", "what"])

    asking = placed.where(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(travel, "block int, turn int, q_ids binary, q binary, who binary, what binary")
    pairs = stored.join(asking, ["block", "turn"]).select("ids", "leaves", "x", "q_ids", "q", "who", "what")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
        for b in batches:
            for at in range(b.num_rows):
                ids, leaves, raw, q_ids, asked, who, what = (b[c][at].as_buffer() for c in ("ids", "leaves", "x", "q_ids", "q", "who", "what"))
                ids, leaves, q_ids, who, what = (np.frombuffer(c, np.int64) for c in (ids, leaves, q_ids, who, what))
                x, q = (np.frombuffer(c, exact_type).astype(np.float64).reshape(-1, dims) for c in (raw, asked))
                rough = np.full((len(q), len(x)), -np.inf)
                names, begins = np.unique(leaves, return_index=True)
                ends = np.r_[begins[1:], len(leaves)]
                by = np.argsort(what, kind="stable")
                who, what = who[by], what[by]
                for leaf, i, j in zip(names, begins, ends, strict=True):
                    some = who[np.searchsorted(what, leaf) : np.searchsorted(what, leaf, "right")]
                    if len(some):
                        rough[some, i:j] = q[some] @ x[i:j].T
                kept = [top(ids, x, one, q[i], rough[i], k) for i, one in enumerate(q_ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((q_ids, [f for f, _ in kept], [s for _, s in kept]), shape, strict=True)], schema=shape)
        common.trim()

    met = pairs.mapInArrow(meet, "query_id long, ids array<long>, score array<double>")
    together = met.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("ids", "score"))).alias("all"))
    nearest = F.slice(F.array_sort(F.transform("all", lambda x: F.struct((-x["score"]).alias("s"), x["ids"].alias("id")))), 1, k)
    out = together.select("query_id", F.posexplode(nearest).alias("pos", "n"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.s")).alias("score")), figures


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)[0]
