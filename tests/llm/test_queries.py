"""The registered queries on the smallest tables, against brute force where their contract fixes the result."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.test_joins_repeats_ann import brute_components, brute_nearest, brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_op1(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], float)
    got = {}
    for r in run(spark, "op1_kmeans_tree").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(ids, x, 20, lambda i: i % 20 == 0)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, v): s for q, w in brute_nearest(ids, x, len(ids), lambda i: i % 20 == 0).items() for v, s in w}
    assert all(s == exact[q, v] for q, f in got.items() for v, s in f) and all(len(f) == len(want[q]) for q, f in got.items())


def test_op3(spark, rows):
    got = run(spark, "op3_ngram_jaccard").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_op4(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op4_language_id").collect()}
    known = {r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang").distinct().collect()}
    assert set(got) == {d for d, _ in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.lang_pred in known | {"und"} for r in got.values())


def test_op5(spark, rows):
    got = run(spark, "op5_mixing").collect()
    assert {r.doc_id for r in got} == {d for d, _ in rows} and len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert {r.doc_id: r.n_tokens for r in got} == {d: len((t or "").split()) for d, t in rows}


def test_op6(spark, rows):
    text = dict(rows)
    got = run(spark, "op6_pii").collect()
    assert len(got) == len(rows) and all((r.n_replaced > 0) == (r.text != text[r.doc_id]) for r in got) and any(r.n_replaced for r in got)


def test_op7(spark, rows):
    got = run(spark, "op7_toxicity").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == len(rows) and all(0 <= r.p_toxic <= 1 for r in got)
    toxic = [r for r in got if labels.get(r.doc_id) == 1]
    assert sum(r.p_toxic for r in toxic) / max(len(toxic), 1) > sum(r.p_toxic for r in got) / len(got) or not toxic


def test_op8(spark, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "op8_packing").toPandas()
    for d, text in rows[:60]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == d].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1].tolist()] and mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_op9(spark, rows):
    raw = [(t or "").encode() for _, t in rows]
    kept = brute_repeats(raw, 200)
    got = {r.doc_id: r for r in run(spark, "op9_suffix_array_dedup").collect()}
    for (d, _), b, k in zip(rows, raw, kept, strict=True):
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(b), len(b) - len(k), hashlib.sha256(k).hexdigest()) and (got[d].n_spans > 0) == (len(b) > len(k))


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6)
    blank = docs.limit(2).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(None).cast("long"))
    table = docs.unionByName(docs.limit(20)).unionByName(odd).unionByName(blank)
    for clash in ("own", "key", "found", "position", "epoch", "replaced", "score", "rejected"):
        table = table.withColumn(clash, F.lit("x"))
    table.write.parquet(f"{tmp_path}/in/documents.parquet")
    got = cp.run(spark, f"{tmp_path}/in").toPandas()
    stage = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    for _, f in cp.STAGES[:2]:
        stage = f(spark, stage, "").checkpoint()
        assert stage.columns == table.columns
    kept = {r.doc_id for r in stage.select("doc_id").collect()}
    assert set(got.doc_id) == kept and 100 < len(kept) < 200 and not kept & set(range(10**6, 10**6 + 1000))
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()
    copies = got[got.start == 0].groupby("doc_id").size()
    assert copies.min() == 1 and copies.max() == 2  # sources are repeated up to one and a half times
    left = [d for d in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if d.startswith("pipeline-")]
    assert all(os.listdir(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/{d}") == ["3-mixing"] for d in left)


def test_stages_of_nothing_and_of_nulls(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    nulls = docs.limit(4).select(*[F.lit(None).cast(k).alias(c) for c, k in docs.dtypes])
    for name, f in cp.STAGES:
        assert f(spark, none, "").count() == 0
        out = f(spark, nulls, "")
        assert out.count() == (0 if name == "language_id" else 4)
        if name != "packing":
            assert out.columns == docs.columns
