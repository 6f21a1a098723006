"""Language ID, toxicity, packing, mixing and the pipeline: held-out accuracy, round trips, brute force."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as lid
from tidemark.llm import mixing, packing, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


# --- language ---


def test_held_out_accuracy_and_rejection(spark, docs):
    model = lid.fit(docs.where(~lid.held_out(F.col("doc_id"))))
    out = lid.identify(docs.withColumn("score", F.lit("clash")), model).where(lid.held_out(F.col("doc_id"))).toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.98 and out.score.between(0, 1).all() and out.rejected.mean() < 0.02
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the " * 50_000), (5, "x"), (5, "x")], "doc_id long, text string")
    got = lid.identify(odd, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.rejected) for r in got[:3]] == [("und", True)] * 3 and got[3].lang_pred == "en" and got[4][2:] == got[5][2:] and got[4].lang_pred in model.labels


def test_predictions_by_brute_force(spark, docs):
    from collections import Counter

    model = lid.fit(docs.where(~lid.held_out(F.col("doc_id"))), max_train=400)
    rows = lid.identify(docs.select("doc_id", "text").limit(60), model).collect()
    for r in rows:
        data, counts = lid.prepare(r.text or ""), Counter()
        for n in lid.ORDERS:
            for a in range(len(data) - n + 1):
                if b" " not in data[a + 1 : a + n - 1]:
                    h = sum(data[a + k] * int(lid._FACTORS[k]) for k in range(n)) + n
                    counts[(h * int(lid._SPREAD) & 0xFFFFFFFF) >> (32 - lid.BITS)] += 1
        x = sum((c * model.table[u].astype(float) for u, c in counts.items()), np.zeros(len(model.labels))) / max(sum(counts.values()), 1) + model.bias
        p = np.exp(x / model.temperature - (x / model.temperature).max())
        p /= p.sum()
        assert r.lang_pred == model.labels[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-5) and r.rejected == (r.score < model.threshold)


def test_training_sample_is_bounded_and_spread(spark):
    rows = [(i, f"text number {i}", f"l{i % 7}" if i % 50 else f"rare{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lid.training_sample(df, 70, 7).groupBy("lang").count().collect()
    assert {r.lang for r in got} == {f"l{k}" for k in range(7)} and all(r["count"] <= 10 for r in got)
    u, c = lid.bag("abcdefg hij " * 50, most=9)
    assert len(u) == 9 and c.sum() == pytest.approx(1) and (np.diff(u) > 0).all()


def test_language_of_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", "en", "x", 5)], "doc_id long, text string, lang string, lang_pred string, own int")
    model = lid.fit(df)
    got = lid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "own", "lang_pred", "score", "rejected"] and got.first().lang_pred == "en"
    assert lid.identify(df.limit(0), model).count() == 0 and lid.fit(df.limit(0)).labels == []


def test_models_of_few_labels(spark):
    shape = "doc_id long, text string, lang string"
    none = lid.fit(spark.createDataFrame([(1, "abc", None), (2, None, "en")], shape))
    assert none.predict(pa.array(["abc"]).to_pandas()).values.tolist() == [["und", 0.0, True]]
    one = lid.fit(spark.createDataFrame([(1, "abc", "en")], shape))
    assert one.predict(pa.array(["xyz"]).to_pandas()).values.tolist() == [["en", 1.0, False]]


def test_subwords_by_brute_force():
    data = lid.prepare("Ab, cÉd")
    assert data == " ab  céd ".encode()
    got = {(n, int(a)) for n, (at, _) in zip(lid.ORDERS, lid.subwords(data), strict=True) for a in at}
    want = {(n, a) for n in lid.ORDERS for a in range(len(data) - n + 1) if b" " not in data[a + 1 : a + n - 1]}
    assert got == want


# --- toxicity ---


def test_chain_finds_planted_words(spark):
    rng = random.Random(3)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        w = rng.choices(clean, k=rng.randint(5, 200)) + (rng.sample(["vile", "foul", "nasty"], 2) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, float(toxic), None if i % 7 == 0 else float(toxic or i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(0, 0.0, 0.0), (99_999, 1.0, 1.0), (None, 1.0, 1.0)], "doc_id long, toxic double, mild double")
    chain = toxicity.fit(df, lab.where("doc_id is null or doc_id % 2 = 0 or doc_id = 99999"), ["toxic", "mild"])
    got = toxicity.score(df.withColumn("toxic", F.lit("clash")), chain).toPandas()
    held = got[got.doc_id % 2 == 1]
    assert not held.toxic.any() or held[held.toxic].text.str.contains("vile|foul|nasty").all()
    assert got[got.doc_id % 10 == 0].toxic.mean() > 0.98 and got[got.doc_id % 10 != 0].toxic.mean() < 0.01
    assert len(chain.models[1].chain) == 1 and chain.models[1].chain[0] > 0  # the later category reads the earlier one
    odd = toxicity.score(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), chain).collect()
    assert [r.toxic for r in odd] == [False, False]


def test_no_labels_flag_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    chain = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"])
    assert not toxicity.score(df, chain).first().toxic


def test_scores_by_brute_force(spark):
    import math
    import zlib as z

    rows = [(i, " ".join(["vile"] * (i % 5 == 0) + [f"w{(i * k) % 17}" for k in range(1, 9)]), 3) for i in range(400)] + [(900, None, 3), (901, "", 3), (902, "Vile " * 30_000, 3), (5, "w1", 3), (5, "w1", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int, low int")
    chain = toxicity.fit(df, labels, ["low", "toxic"])
    got = toxicity.score(df, chain).collect()
    assert len(got) == len(rows) and len(chain.models[1].chain) == 1
    for r in got:
        bag = {z.crc32(w.encode()) & ((1 << toxicity.BITS) - 1) for w in __import__("re").findall(r"[^\W\d_]+", (r.text or "").lower())}
        odds = []
        for m in chain.models:
            odds.append(float(sum(float(m.words[b]) for b in bag) + sum(c * min(14, max(-14, o)) for c, o in zip(m.chain, odds, strict=True)) + m.intercept))
        for p, flag, o, t in zip((r.p_low, r.p_toxic), (r.low, r.toxic), odds, chain.thresholds, strict=True):
            assert p == pytest.approx(1 / (1 + math.exp(-min(35, max(-35, o)))), abs=1e-5) and flag == (p >= t)
    assert toxicity.score(df.limit(0), chain).count() == 0


# --- packing ---


@pytest.mark.parametrize("text", ["", " \r\n\t ", "a's b'll x.'s Σας. ΑΣ ÀÉ é. don't\u00a0x\x1cy İ. <|endoftext|>. q\u0085 1,2. 3.", "x" * 5000 + ". " + "1" * 100, "\u0301. a.. b,, .,", "İx. ſt, ŉa. Ĳ! Ǆx. SS!! don%%% a&&& b$$$ c### D***", "A ß ẞ. ÅÅ! ﬁ. \u4e2d\u6587\u3002 \U0001f600!"])
def test_word_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer

    e = packing.WordEncoder(packing.default_tokenizer())
    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids, at = e.encode(pa.array([text, None, text]))
    want = whole.encode(text, add_special_tokens=False).ids
    assert ids[at[0] : at[1]].tolist() == want == ids[at[2] : at[3]].tolist() and at[1] == at[2]


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    for windows in (1, 2, 7, 40):
        sizes = rng.integers(1, 1000, 400)
        w = packing.difference(sizes, windows)
        sums = np.bincount(w, sizes, windows)
        assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 60
    assert packing.difference(np.array([8, 7, 6, 5, 4]), 2).tolist().count(0) in (2, 3)
    assert np.bincount(packing.fill(rng.integers(1, 2048, 300), 2048), minlength=1).size >= 1


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(10_001, None), (10_002, ""), (None, "a b"), (10_003, "word " * 30_000), (10_003, "word " * 30_000)], "doc_id long, text string")
    df = docs.select("doc_id", "text").limit(150).unionByName(extra)
    got = packing.pack_documents(df.withColumn("length", F.lit("clash")), packing.default_tokenizer(), block_docs=64).toPandas()
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()
    totals = got.groupby("sequence_id").length.sum()
    assert totals.max() <= 2048 and totals.sum() / (2048 * len(totals)) > 0.93
    t = Tokenizer.from_file(packing.default_tokenizer())
    for r in df.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == r.doc_id] if r.doc_id is not None else got[got.doc_id.isna()]
        copies = 2 if r.doc_id == 10_003 else 1
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == copies * len(ids)
        assert sorted(mine.start.drop_duplicates()) == sorted(np.cumsum([0, *mine.drop_duplicates("start").sort_values("start").length])[:-1].tolist())
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert packing.pack_documents(df.limit(0), packing.default_tokenizer()).count() == 0


def test_packing_keeps_ids_beside_nulls_and_clashes(spark):
    ids = [2**60 + 1, None, 2**60 + 3, 2**60 + 3, -5]
    df = spark.createDataFrame([(i, "a word " * 5, 9) for i in ids], "doc_id long, text string, offset long").coalesce(1)
    got = packing.pack_documents(df, packing.default_tokenizer()).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    names = spark.createDataFrame([("x", "a"), (None, "b")], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack_documents(names, packing.default_tokenizer()).collect()} == {"x", None}


def test_copies_of_a_row_are_many_blocks(spark):
    df = spark.createDataFrame([(1, "word " * 300)], "doc_id long, text string").crossJoin(spark.range(600)).select("doc_id", "text").coalesce(1)
    got = packing.pack_documents(df, packing.default_tokenizer(), block_docs=64).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert got.length.sum() == 600 * got.doc_tokens.iat[0] and used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.85
    assert (got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.cumsum() <= 2048).all()


# --- mixing ---


def test_word_counts(spark):
    rows = ["a b  c", "", None, " \n x\ty \n", "  ", "one"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len((t or "").split()) for t in rows]


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 40), "hot" if i % 3 else rng.choice(["a", "b", None]), i) for i in range(3000)]
    clash = {c: F.lit("x") for c in ("tokens", "cut", "s", "spend", "epochs", "unit", "rest")}
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch long").withColumns(clash).persist()


def tokens(df):
    return {r.source: r.n for r in df.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}


@pytest.mark.parametrize("block", [8, 1024])
def test_limits_and_budgets_are_met(sources, block):
    once = tokens(mixing.mix(sources, max_repeats=1.0))
    assert mixing.mix(sources, max_repeats=1.0).select("doc_id").distinct().count() == 3000
    got = mixing.mix(sources, max_repeats=2.0, block_rows=block).persist()
    n = tokens(got)
    assert got.select("doc_id").distinct().count() == 3000 and got.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    assert all(n[s] / once[s] <= 2.001 for s in n) and max(n[s] / once[s] for s in n) > 1.9 and n["hot"] == once["hot"]
    total = sum(once.values())
    cut = tokens(mixing.mix(sources, max_repeats=1.2, budget=total / 2, block_rows=block))
    assert sum(cut.values()) == pytest.approx(total / 2, rel=0.02)


@pytest.mark.parametrize("block,many", [(8, 2), (64, 1024)])
def test_choice_of_rows_by_brute_force(sources, block, many):
    budget, repeats = 40_000, 1.7
    got = mixing.mix(sources, max_repeats=repeats, budget=budget, block_rows=block, sum_blocks=many)
    kept = [c for c in sources.columns if c != "epoch"]
    row = F.xxhash64(*[F.col(c) for c in kept])
    units = sources.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"), *[mixing._unit(row, F.lit(e), mixing.SEED).alias(f"u{e}") for e in range(4)]).collect()
    total = {}
    for r in units:
        total[r.source] = total.get(r.source, 0) + r.n
    everything = sum(total.values())
    p = {s: n / everything for s, n in total.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    a = 0.0  # the flattest mixture within the limit, by small steps
    while max(weights(a)[s] * budget / total[s] for s in p) > repeats * (1 + 1e-9) and a < 1:
        a += 1e-5
    want = set()
    for s, w in weights(a).items():
        spend, rows = w * budget, [r for r in units if r.source == s]
        whole, left = int(spend // total[s]), spend % total[s]
        want |= {(r.doc_id, e) for r in rows for e in range(whole)}
        for r in sorted(rows, key=lambda r: r[f"u{whole}"]):
            left -= r.n
            if left < 0:
                break
            want.add((r.doc_id, whole))
    have = {(r.doc_id, r.epoch) for r in got.collect()}
    # the steps of alpha move a budget by a few tokens, so a row a source may differ
    assert len(have ^ want) <= len(p) and len(have) > 1500


def test_entropy_target(sources):
    n = tokens(mixing.mix(sources, target_entropy=1.2, max_repeats=None, budget=60_000))
    p = np.array(list(n.values())) / sum(n.values())
    assert -(p * np.log(p)).sum() == pytest.approx(1.2, abs=0.02)


def test_alpha_by_brute_force():
    p = np.array([0.6, 0.3, 0.1])

    def sums(a):
        x = p**a
        return float(x.sum()), float((x * np.log(p)).sum())

    a = mixing.choose_alpha(sums, 0.1, 0.6, 1.0, 1.0, None, None)
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-9)
    a = mixing.choose_alpha(sums, 0.1, 0.6, 1.0, None, 2.0, None)
    w = p**a / (p**a).sum()
    assert (w / p).max() / (w / p).min() == pytest.approx(2.0, abs=1e-9)
    assert mixing.choose_alpha(sums, 0.1, 0.6, 1.0, None, None, None) == 1.0


def test_mixture_of_odd_rows(spark):
    shape = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], shape)).count() == 0
    rows = [(1, None, None), (2, "a b", None), (2, "a b", None), (3, "", "x"), (None, "c", "y")]
    assert mixing.mix(spark.createDataFrame(rows, shape)).count() >= 5
    few = spark.createDataFrame([(i, "t", f"s{i % 5}") for i in range(50)], shape)
    a = sorted(map(tuple, mixing.mix(few).collect()), key=str)
    assert a == sorted(map(tuple, mixing.mix(few.repartition(7)).collect()), key=str)


# --- pipeline ---


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as cp
    from test_joins_repeats_ann import brute_components

    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard", "pii", "mixing", "packing"] and cp.ORACLE_SQL is None
    rows = docs.limit(200).persist()
    kept = cp.language(spark, rows, SF).persist()
    assert kept.columns == docs.columns and kept.count() >= 190
    single = cp.near_duplicates(spark, kept, SF).persist()
    pairs = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute_components(pairs, 5, 80)})
    safe = cp.personal_data(spark, single, SF).persist()
    assert safe.columns == docs.columns and safe.count() == single.count() and safe.where("n_chars <> length(text)").count() == single.where("n_chars <> length(text)").count()
    mixed = cp.mixture(spark, safe, SF).persist()
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == safe.count()
    assert cp.packed(spark, mixed, SF).count() > 0


def test_near_duplicates_by_id_and_text(spark):
    import corpus_pipeline as cp

    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(7, x, "a"), (7, y, "b"), (1, x + " tail", "a"), (9, z, "a"), (9, z, "a"), (None, z + " end", "b"), (None, "alone without an id here", "a"), (None, "alone without an id here", "b"), (4, "one", "a"), (4, "two", "b"), (None, "", "a"), (None, None, "b"), (None, " ", "c")]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    want = [(1, x + " tail"), (7, y), (9, z), (None, "alone without an id here"), (4, "one"), (4, "two"), (None, ""), (None, None), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


sys.path.insert(0, __file__.rsplit("/", 1)[0])
