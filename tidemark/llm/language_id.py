"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte 3- to 5-grams inside a lower-cased word (blank-marked at its ends), hashed into
2^17 embedding rows; a document is the average of its rows. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows (max_train documents in
all, equally many a language at most), a fifth of which is kept aside to calibrate: a temperature
that minimises its log loss, and the confidence under which a prediction is rejected. Scoring reads
whole texts on the executors; as the softmax is linear, they only get the product of both matrices.

Training takes no text to the driver: executors make the sample's bags of subwords, of at most BAG
buckets each (those of the smallest mixed numbers, so of the whole text), and the most frequent
MAX_LABELS labels train.

Defined cases: null text, or one without a letter -> `und`, score 0, rejected; no labelled row at
all -> the same for every document; one label only -> that label with score 1; null labels and null
texts never train; equal texts get equal answers, so repeated rows do; very long texts are scored whole,
in one piece each; an empty table gives no rows; extra columns stay, whatever their names, but
lang_pred, score and rejected of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS, DIM, ORDERS, UNKNOWN = 17, 16, (3, 4, 5), "und"
#: documents of the training sample in all
MAX_TRAIN = 4000
#: labels that train, the most frequent ones, and different subwords of a training document
MAX_LABELS, BAG = 1000, 4096
#: share of the calibration documents that the rejection threshold gives up at most, and its ceiling
GIVE_UP, CEILING = 0.002, 0.5
EPOCHS, RATE, SEED = 5, 0.5, 7
SLICE = 512 << 10

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters stay; other ASCII bytes part words
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_FACTORS = np.random.default_rng(20).integers(1, 2**32, max(ORDERS), dtype=np.uint32) | np.uint32(1)
_SPREAD = np.uint32(2654435761)


def subwords(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: where its subwords begin in the (translated) bytes, and their buckets."""
    b = np.frombuffer(data, np.uint8)
    blank = b == 32
    h = b[: len(b)].astype(np.uint32) * _FACTORS[0]
    inner = None
    for n in range(2, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            return
        h = h[:m] + b[n - 1 :].astype(np.uint32) * _FACTORS[n - 1]
        inner = np.ones(m, bool) if n == 2 else inner[:m] & ~blank[n - 2 : n - 2 + m]
        if n in ORDERS:
            at = np.flatnonzero(inner)
            yield at, ((h[at] + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS)


def prepare(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" "


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # embedding rows times softmax weights: buckets x labels
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row a text; texts are scored together, SLICE bytes at a time."""
        out, run, size = np.zeros((len(texts), len(self.labels))), [], 0
        for k, t in enumerate(texts):
            run.append((k, prepare(t)))
            size += len(run[-1][1])
            if size >= SLICE or k + 1 == len(texts):
                begins = np.cumsum([0, *(len(d) for _, d in run)])
                sums, counts = np.zeros((len(run), len(self.labels))), np.zeros(len(run))
                for at, bucket in subwords(b"".join(d for _, d in run)):
                    edge = np.searchsorted(at, begins)
                    total = np.zeros((len(at) + 1, len(self.labels)))
                    np.cumsum(self.table[bucket], axis=0, out=total[1:], dtype=np.float64)
                    sums += total[edge[1:]] - total[edge[:-1]]
                    counts += edge[1:] - edge[:-1]
                out[[k for k, _ in run]] = sums / np.maximum(counts, 1)[:, None] + self.bias
                run, size = [], 0
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        known = [k for k, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)] if self.labels else []
        label, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if known:
            p = self.probabilities([texts.iat[k] for k in known])
            label[known] = np.array(self.labels, object)[p.argmax(1)]
            score[known] = p.max(1)
        rejected = score < self.threshold
        rejected[np.setdiff1d(np.arange(len(texts)), known)] = True
        return pd.DataFrame({"lang_pred": label, "score": score, "rejected": rejected})


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bag(text: str, most: int = BAG) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text with a letter and their shares of all its subwords; of more than `most`, a sample by hash."""
    u, c = np.unique(np.concatenate([b for _, b in subwords(prepare(text))]), return_counts=True)
    if len(u) > most:
        kept = np.sort(np.argsort(u.astype(np.uint32) * _SPREAD, kind="stable")[:most])
        u, c = u[kept], c[kept]
    return u.astype(np.int32), (c / c.sum()).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if len(labels) < 2:
        return Model(labels, np.zeros((1 << BITS, len(labels)), np.float32), np.zeros(len(labels)))
    y = np.array([labels.index(x) for x in langs])
    order = rng.permutation(len(bags))
    aside, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            lr = rate * (1 - step / steps)
            u, c = bags[i]
            h = c @ emb[u]
            g = softmax(h @ weights + bias)
            g[y[i]] -= 1
            back = weights @ g
            weights -= lr * np.outer(h, g)
            bias -= lr * 0.1 * g
            emb[u] -= (lr * c * len(u) ** 0.5)[:, None] * back  # the mean dilutes a row's share; its root restores part
            step += 1
    model = Model(labels, emb @ weights, bias.astype(np.float64))
    if len(aside):
        x = np.stack([bags[i][1] @ model.table[bags[i][0]] + model.bias for i in aside])
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(softmax(x / t)[np.arange(len(aside)), y[aside]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        top = softmax(x / model.temperature).max(1)
        model.threshold = float(min(CEILING, np.quantile(top, GIVE_UP)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, max_train: int = MAX_TRAIN, max_labels: int = MAX_LABELS) -> DataFrame:
    """text, lang, mix of at most max_train labelled rows, equally many a label at most, by a hash of the row."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    most_frequent = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(max_labels, max_train))
    counts = {r["lang"]: r["n"] for r in most_frequent.collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "text string, lang string, mix long")
    most = max(1, max_train // len(counts))
    # a share of each label's rows first, so that what is ranked is bounded too
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * most / n)))])
    mix = F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")))
    chosen = able.withColumn("mix", mix).where(F.pmod("mix", F.lit(1 << 20)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mix", "doc_id"))
    return chosen.withColumn("k", rank).where(F.col("k") <= most).select("text", "lang", "mix")


def _bags(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bag(t) for t in text], columns=["u", "c"])


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from docs(doc_id, text, lang)."""
    bags = F.pandas_udf(_bags, "u array<int>, c array<float>")("text")
    rows = training_sample(docs, max_train).select("lang", "mix", bags.alias("b")).select("lang", "mix", "b.u", "b.c").toArrow()
    if not rows.num_rows:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    order = pc.sort_indices(rows.select(["lang", "mix"]), sort_keys=[("lang", "ascending"), ("mix", "ascending")]).to_pylist()
    arrays, langs = list(zip(*([x.values.to_numpy() for x in rows[c]] for c in ("u", "c")), strict=True)), rows["lang"].to_pylist()
    model = train([arrays[i] for i in order], [langs[i] for i in order])
    del rows, arrays
    common.release(docs.sparkSession)  # tens of MB of bags
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs + lang_pred, score, rejected, from the whole text alone."""
    names = ("lang_pred", "score", "rejected")
    common.bound_batches(docs.sparkSession)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model.predict(b)
            common.trim()

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    p = F.pandas_udf(score, "lang_pred string, score double, rejected boolean")(F.col(f"`{text}`"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, p.alias("__p")).select(*kept, *(F.col(f"__p.{n}").alias(n) for n in names))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).drop("text").select("doc_id", "held_out", "lang_pred", "score", "rejected")
