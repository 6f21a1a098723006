"""Jaccard join, repeats, suffix arrays and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import ann, common, jaccard_join as jj, repeats
from tidemark.llm.gsaca import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_arrays(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    t = (s[:7] * 9)[:60]
    assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


# --- repeats ---


def brute_repeats(docs, length):
    seen = {}
    for k, b in enumerate(docs):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    masks = [np.zeros(len(b), bool) for b in docs]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                masks[k][i : i + length] = True
    return [np.frombuffer(b, np.uint8)[~m].tobytes() for b, m in zip(docs, masks, strict=True)]


def texts(seed, words=True):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "stone", "river", "light", "é", "mountain", "xyzzyx" * 3]
    line = lambda n: (" " if words else "").join(rng.choice(vocabulary) for _ in range(n))
    base = [line(rng.randint(5, 120)) for _ in range(6)]
    out = list(base)
    for b in base * 3:
        w = list(b)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abc \n")
        out.append(line(rng.randint(0, 20)) + "".join(w) + line(rng.randint(0, 20)))
    return [*out, base[0], base[0], "", None, "short", "Thedly " * 80, "a" * 700, "ab" * 300, base[1][:60]]


@pytest.mark.parametrize("seed,words,most", [(1, True, 4096), (2, False, 4096), (3, True, 2), (4, False, 1)])
def test_repeats_equal_brute_force(spark, seed, words, most):
    t = texts(seed, words)
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(t)] + [(0, t[0], "clash")], "doc_id long, text string, kept string")
    got = repeats.remove_repeats(df, length=60, gram=16, most=most, bin_bytes=4000).collect()
    raw = [(x or "").encode() for x in [*t, t[0]]]
    want = brute_repeats(raw, 60)
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted(zip([*range(len(t)), 0], want, strict=True))
    for r in got:
        b = raw[r.doc_id]
        cut = b"".join(b[i:j] for i, j in zip([0, *(x.end for x in r.removed)], [*(x.start for x in r.removed), len(b)], strict=True))
        assert cut == bytes(r.kept) and all(x.start < x.end for x in r.removed)


def test_repeats_keep_ids_beside_nulls(spark):
    ids, t = [2**60 + 1, None, 2**60 + 3, 2**60 + 3], "a b c d " * 3 + "q" * 300
    df = spark.createDataFrame([(i, f"{t} {k} {t}" if k % 2 else f"alone {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    got = repeats.remove_repeats(df).collect()
    assert sorted((r.doc_id, len(r.removed) > 0) for r in got if r.doc_id) == [(2**60 + 1, False), (2**60 + 3, False), (2**60 + 3, True)]
    assert [len(r.removed) > 0 for r in got if r.doc_id is None] == [True]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- Jaccard join ---


def sets_of(text, n):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(low))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    """Smallest id reachable over links, by row position."""
    s = [sets_of(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            o = len(s[i] & s[j])
            if s[i] and s[j] and 100 * o >= percent * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    shared = rng.choices(vocabulary, k=30)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w + (shared if rng.random() < 0.3 else [])))
    rows += [rows[0], rows[0].upper(), "", None, "  \t\n", "one two", "ONE  two", "three", rows[1] + " tail", " ".join(shared)]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,n,percent,group", [(2, 5, 80, 512), (3, 4, 85, 3), (4, 2, 60, 2)])
def test_components_equal_brute_force(spark, seed, n, percent, group):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = jj.jaccard_components(df, n, percent, group).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)


@pytest.mark.parametrize("seed,n,percent,group", [(3, 4, 85, 3), (5, 3, 100, 512)])
def test_all_links_equal_brute_force(spark, seed, n, percent, group):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_links string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.n_links) for r in jj.jaccard_join(df, n, percent, group).collect()}
    s = {d: sets_of(t, n) for d, t in rows}
    near = lambda a, b: s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])
    assert got == {d: (len(s[d]), sum(bool(near(d, e)) for e in s if e != d)) for d in s}


def test_links_by_phase(spark):
    rows = near_copies(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = jj.Corpus(df, 4, 85, 512)
    alone = c.classes.select("cls", F.col("cls").alias("comp"), F.lit(1).cast("bigint").alias("c"))
    whole = {tuple(sorted(r)) for r in c.later_links(c.shared(), None).collect()}
    inside = {tuple(sorted(r)) for r in c.first_links().where("a <> b").collect()}
    s = {r.cls: sets_of(r.text, 4) for r in c.classes.join(c.texts, "row").collect()}
    brute = {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])}
    # the matrix alone finds every link; what the groups' own members give are links too, and fewer
    assert whole == brute and inside <= {(a, b) for a, b in whole} | {(a, b) for a in s for b in s} and 0 < len(inside) <= len(brute)
    assert {tuple(sorted(r)) for r in c.later_links(c.shared(), alone).collect()} == brute


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = near_copies(2) + [(1000 + i, "the same text for all of them here") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (200_000, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", most)
        got = jj.jaccard_components(df, 4, 85, 4).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_classes_that_share_half_an_identity(spark, monkeypatch):
    real = jj._identity
    monkeypatch.setattr(jj, "_row", lambda t, c, p, row=jj._row: (lambda r: (r[0], 7, *r[2:]) if r[0] else r)(row(t, c, p)))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l")], "doc_id long, text string")
    c = jj.Corpus(df, 4, 85, 512)
    assert c.classes.select("cls").distinct().count() == c.classes.count() == 2 and c.sig.select("cls").distinct().count() == 2 and real is jj._identity


def test_components_of_odd_rows(spark):
    long_text = " ".join(f"v{i}" for i in range(30_000))
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (7, long_text), (8, long_text + " x"), (9, "solo words only here now"), (9, "solo words only here now")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jj.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (7, 7), (8, 7), (9, 9), (9, 9)], key=str)
    # a row without an id links others, and a component of such rows alone has none
    x = [f"w{i}" for i in range(60)]
    near = [(4, " ".join(x)), (None, " ".join(["v", *x[1:-1], "v2"])), (6, " ".join(["v", "v1", *x[2:-2], "v3", "v2"])), (None, "only one"), (None, "only one")]
    got = jj.jaccard_components(spark.createDataFrame(near, "doc_id long, text string"), 1, 90).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(4, 4), (None, 4), (6, 4), (None, None), (None, None)], key=str)
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_equal_ids_with_different_texts(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(7, x), (7, y), (1, x + " tail"), (2, y + " tail"), (7, "some other text of its own")]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (7, 200), (300, 301), (301, 302), (None, 1)]
    got = {r.node: r.comp for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 200: 1, 100: 100, 300: 300, 301: 300, 302: 300}


# --- nearest neighbours ---


def brute_nearest(ids, x, k, chosen):
    out = {}
    for i in np.flatnonzero(chosen(ids)):
        s = (x * x[i]).sum(1)
        by = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in by]
    return out


def test_few_vectors_are_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[30:50] = x[3]  # equal vectors: ties go to smaller ids
    good = [(int(i), v.tolist()) for i, v in enumerate(x)]
    bad = [(100, None), (120, [0.0] * 8), (140, [float("nan")] + [1.0] * 7), (160, [float("inf")] + [1.0] * 7), (180, [None] + [1.0] * 7), (200, [1.0, 2.0]), (None, x[0].tolist()), (220, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(3)
    got, _ = ann.search(df, F.col("vec_id") % 20 == 0, k=25)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert rows == brute_nearest(np.arange(60), x.astype(float), 25, lambda i: i % 20 == 0)


def test_recall_of_the_tree(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 2
    x = (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    x[: 6000 // 3] = (x[0] + 0.001 * rng.normal(size=(2000, 16))).astype(np.float32)  # a hot spot
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(4)
    got, figures = ann.search(df, F.col("vec_id") % 40 == 0, k=10, leaf_rows=100)
    want = brute_nearest(np.arange(6000), x.astype(float), 10, lambda i: i % 40 == 0)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(rows) == set(want) and all(sorted(r)[k][0] == k + 1 for r in rows.values() for k in range(10))
    hits = sum(len({v for _, v, _ in rows[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits / (10 * len(want)) >= 0.9 and figures["leaves"] > 8 and figures["recall"] >= ann.TARGET


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    # copies of whole rows, and other vectors under ids that are there: the smallest array stands for its id
    more = [(i, x[i].tolist(), "clash") for i in range(0, 90, 3)] + [(i, (x[i] + 1).tolist(), "clash") for i in range(0, 90, 5)] + [(2**60 + 1, x[7].tolist(), "clash")] * 3
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>, score string").repartition(3)
    got, figures = ann.search(df, F.col("vec_id") % 20 == 0, k=80, block_bytes=6 * 8 * 10)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.r_[np.arange(90), 2**60 + 1]
    assert found == brute_nearest(ids, np.r_[x, x[7:8]].astype(float), 80, lambda i: i % 20 == 0) and figures["rows"] == 91 and figures["blocks"] > 5


def test_far_clusters_are_pruned(spark):
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(40, 12)) * 6, 100, 0) + rng.normal(size=(4000, 12))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(4000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(4)
    _, figures = ann.search(df, F.col("vec_id") % 20 == 0, k=10, leaf_rows=50)
    assert figures["visits"] <= figures["leaves"] / 8 and figures["recall"] >= ann.TARGET


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got, _ = ann.search(df, F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 0.5)]
    assert ann.search(df.limit(0), F.lit(True))[0].count() == 0


def test_sets_are_made_in_slices(spark, monkeypatch):
    rows = near_copies(2)
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    monkeypatch.setattr(jj, "BROADCAST_IDS", 30)
    made, sets = [], jj.Corpus.sets
    monkeypatch.setattr(jj.Corpus, "sets", lambda self, wanted, carried: made.append(wanted.count()) or sets(self, wanted, carried))
    got = jj.jaccard_components(df, 4, 85, 3).collect()
    assert len(made) > 2 and max(made) <= 60  # slices are as even as hashes deal
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got}) == brute_components(rows, 4, 85) and len(got) == len(rows) + 1


@pytest.mark.parametrize("few", [0, 1000])
def test_few_and_many_edges_close_alike(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    test_connected_components(spark)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
