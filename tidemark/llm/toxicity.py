"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other; each model reads hashed word presence and the
probabilities of all earlier categories. While training, those are out-of-fold predictions, so a
later model never sees an earlier one's answer on its own training row. Every model is a logistic
regression fitted in numpy by follow-the-regularised-leader steps, whose L1 term leaves words that
carry no evidence at exactly zero, so long texts gather no noise. Thresholds maximise F1 on the
out-of-fold predictions.

Training reads a bounded sample (max_train labelled rows in all, spread evenly over the label
combinations and weighted back to their true shares); scoring reads whole texts of all documents.

Defined cases: null or empty text scores as a text without words; very long texts are scored whole; a
null label is skipped for its category; repeated label rows of a document count as their maximum, and a
document's text trains once a row; labels without a document are ignored; no labels at all, or one
class only, -> that constant probability (0 without labels) and nothing flagged unless it is 1; an
empty table of documents gives no rows; extra columns stay, whatever their names, but those named as a
category or its probability are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS, FOLDS, EPOCHS, SEED = 20, 3, 3, 11
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 0.1
#: labelled rows of the training sample in all
MAX_TRAIN = 12000

_WORD = re.compile(r"[^\W\d_]+")


def buckets(text: str | None) -> np.ndarray:
    """Distinct hashed words of a whole text."""
    words = set(_WORD.findall(text.lower())) if isinstance(text, str) else ()
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & ((1 << BITS) - 1) for w in words), np.int32, len(words)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    """Weights of the words, of the earlier categories' log-odds, and the intercept."""

    words: np.ndarray
    chain: np.ndarray
    intercept: float

    def odds(self, bag: np.ndarray, earlier: np.ndarray) -> float:
        return float(self.words[bag].sum() + self.chain @ earlier + self.intercept)


def fit_linear(bags: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Linear:
    """earlier: log-odds of the categories before, one row a document."""
    extra = earlier.shape[1] + 1
    prior = float((y * weight).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if len(y) == 0 or y.min() == y.max():
        return Linear(np.zeros(1 << BITS, np.float32), np.zeros(extra - 1), 40.0 if prior == 1 else -40.0)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ze, ne = np.zeros(extra), np.zeros(extra)
    x = np.c_[earlier, np.ones(len(y))]
    rng = np.random.default_rng(seed)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            b = bags[i]
            zb, nb = z[b], n[b]
            w, we = weights(zb, nb, L1), weights(ze, ne, 0.0)
            g = (sigmoid(w.sum() + we @ x[i]) - y[i]) * weight[i]
            z[b] = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * w
            n[b] = nb + g * g
            ge = g * x[i]
            ze += ge - (np.sqrt(ne + ge * ge) - np.sqrt(ne)) / ALPHA * we
            ne += ge * ge
    we = weights(ze, ne, 0.0)
    return Linear(weights(z, n, L1).astype(np.float32), we[:-1], float(we[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def score(self, bag: np.ndarray) -> list[float]:
        earlier: list[float] = []
        for m in self.models:
            earlier.append(m.odds(bag, np.array(earlier)))
        return [float(sigmoid(o)) for o in earlier]


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, halfway to the next lower score; the median of the best ones."""
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (y * weight).sum())
    ends = np.r_[p[order][1:] != p[order][:-1], True]
    f1 = np.where(ends, f1, -1)
    k = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = k[len(k) // 2]
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def train(bags: list[np.ndarray], labels: dict[str, np.ndarray], weight: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: category -> 0, 1 or nan per document, in the chain's order."""
    out = Chain(list(labels))
    earlier = np.zeros((len(bags), 0))
    fold = np.random.default_rng(SEED).permutation(len(bags)) % folds
    for y in labels.values():
        known = ~np.isnan(y)

        def fitted(rows, y=y):
            return fit_linear([bags[i] for i in rows], earlier[rows], y[rows], weight[rows])

        aside = np.zeros(len(bags))
        for f in range(folds):
            m = fitted(np.flatnonzero(known & (fold != f)))
            rows = np.flatnonzero(fold == f)
            aside[rows] = [m.odds(bags[i], earlier[i]) for i in rows]
        out.models.append(fitted(np.flatnonzero(known)))
        p = sigmoid(aside[known])
        out.thresholds.append(best_threshold(p, y[known], weight[known]) if known.any() and y[known].max() == 1 else 0.999)
        earlier = np.c_[earlier, np.clip(aside, -14, 14)]
    return out


def training_sample(docs: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN) -> pd.DataFrame:
    """bag, the categories and weight of at most max_train rows of labels(doc_id, *categories)."""
    common.bound_batches(docs.sparkSession)
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in categories])
    labels = labels.withColumn("stratum", stratum).withColumn("mix", F.xxhash64("doc_id"))
    counts = {r["stratum"]: r["n"] for r in labels.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # 3 ** categories rows at most
    if not counts:
        return pd.DataFrame(columns=["bag", *categories, "weight"])
    most = max(1, max_train // len(counts))
    n = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v))])[F.col("stratum")]
    # a share of each stratum first, so that what is ranked is bounded too
    able = labels.withColumn("n", n).where(F.pmod("mix", F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(1.5 * most) / F.col("n")) * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("mix", "doc_id"))
    chosen = able.withColumn("k", rank).where(F.col("k") <= most).select("doc_id", *categories, "n")
    bag = F.pandas_udf(_bags, "array<int>")("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", bag.alias("bag"), *categories, "n").toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    size = rows.groupby(categories, dropna=False)["doc_id"].transform("size") if len(rows) else 1
    rows["weight"] = rows["n"] / size
    rows["weight"] = rows["weight"] / rows["weight"].mean() if len(rows) else rows["weight"]
    return rows


def _bags(text: pd.Series) -> pd.Series:
    return text.map(buckets)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN) -> Chain:
    rows = training_sample(docs, labels, categories, max_train)
    return train([np.asarray(b, np.int64) for b in rows["bag"]], {c: rows[c].to_numpy(np.float64) for c in categories}, rows["weight"].to_numpy(np.float64))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs + p_<category> and <category> (flagged) for each category of the chain."""
    common.bound_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    # only the words some model gives weight to travel, as sorted buckets
    used = np.flatnonzero(np.any([m.words != 0 for m in chain.models], axis=0))
    matrix = np.stack([m.words[used] for m in chain.models], 1) if chain.models else np.zeros((0, 0))
    rest = [(m.chain, m.intercept) for m in chain.models]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            out = np.zeros((len(batch), len(names)))
            for k, t in enumerate(batch):
                at = place[buckets(t)]
                odds: list[float] = []
                for s, (w, b) in zip(matrix[at[at >= 0]].sum(0, dtype=np.float64), rest, strict=True):
                    # a later model was trained on log-odds within these bounds
                    odds.append(float(s + w @ np.clip(odds, -14, 14) + b) if odds else float(s + b))
                out[k] = sigmoid(np.array(odds))
            yield pd.DataFrame(out, columns=names)
            common.trim()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    clash = {*names, *chain.categories}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash]
    p = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))(F.col(f"`{text}`"))
    scored = docs.select(*kept, p.alias("__p"))
    flags = [(F.col(f"__p.p_{c}") >= t).alias(c) for c, t in zip(chain.categories, chain.thresholds, strict=True)]
    return scored.select(*kept, *[F.col(f"__p.{n}").alias(n) for n in names], *flags)


#: the chain of the query: text quality first, then toxicity given it
CATEGORIES = ["low_quality", "toxic"]


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return score(docs, fit(docs, labels, CATEGORIES)).select("doc_id", "p_low_quality", "p_toxic", "toxic")
