"""Exact removal of repeated byte strings by suffix arrays built through grouping.

Every byte is removed that a string of `length` bytes covers which also starts anywhere else in the
corpus. Strings are the windows of `length` bytes of the texts' UTF-8 bytes.

1. Windows are dealt out by their minimiser: the window's smallest hash of GRAM bytes (the leftmost
   of several). Runs of windows that share it form a segment, so equal windows meet under one key.
   Keys are counted first, combined before they are shuffled; segments travel only under keys that
   several have, and the rows of hot keys are salted. Equal segments are one string with a count.
2. Keys under which different segments meet are candidates; one copy of each such segment is fetched.
   (A segment that recurs as a whole is repeated from end to end; its count says so.)
3. Keys are put into bins of bounded size. A bin's segments, cut after each blank into words, become
   one string of word ranks, whose suffix array is built by grouping (gsaca.py). As words end with
   their blank, it is the byte order of all suffixes that start at words; longest common prefixes of
   neighbours, in bytes, give every repeated window that starts at a word. Windows that start inside
   a word are repeated if and only if, in some run of the suffix array whose common prefixes reach
   the window's end, the bytes before the next word agree too.
4. Keys with more than MOST different segments (a passage in very many contexts) would overfill a bin.
   Their windows are dealt out one by one, by a 128-bit hash of all their bytes; where that recurs, two
   of its windows go to a bin, and its suffix array decides.

Defined cases: null text counts as empty; texts below `length` bytes lose nothing; very long texts are
taken whole; overlapping repeats inside a text count; rows that are copies in every column are each
other's repeats; doc_ids of any type are passed on as they are, null or not; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .gsaca import suffix_array
from .hashing import BASES, Hasher

LENGTH, GRAM = 200, 32
#: bytes of segments in a bin, and different segments of a key that a bin takes
BIN_BYTES, MOST = 1 << 20, 4096
#: bytes of spans, and row keys, that are broadcast to the texts at most
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1_000_000

_BREAKS = np.zeros(256, bool)
_BREAKS[[9, 10, 13, 32]] = True
_SPLIT = re.compile(rb"[\t\n\r ]")


def segments(b: np.ndarray, h: Hasher, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, hash, start and length of the segments of a text of at least `length` bytes."""
    h.load(b)
    at = np.arange(len(b) - gram + 1)
    value = h.of(at, at + gram)
    width, size, where = length - gram + 1, 1, at
    while size * 2 <= width:
        value, where = _least(value, where, size)
        size *= 2
    if size < width:
        value, where = _least(value, where, width - size)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    last = np.r_[first[1:], len(where)] - 1
    n = last - first + length
    return value[first].view(np.int64), h.of(first, first + n).view(np.int64), first, n


def _least(value: np.ndarray, where: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of each value and the one `by` places on; the left one of equals."""
    later = value[by:] < value[:-by]
    return np.where(later, value[by:], value[:-by]), np.where(later, where[by:], where[:-by])


def raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _common_prefix(starts: np.ndarray, order: np.ndarray, b: np.ndarray, segment_end: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, inside both segments."""
    h = Hasher()
    h.load(b)
    i, j = starts[order[1:]], starts[order[:-1]]
    most = np.minimum(segment_end[order[1:]] - i, segment_end[order[:-1]] - j)
    low, high = np.zeros(len(i), np.int64), most.copy()
    while (low < high).any():  # the longest equal prefix, bisected through hashes
        mid = (low + high + 1) // 2
        same = h.of(i, i + mid) == h.of(j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return np.r_[0, low]


def repeated_windows(parts: list[bytes], length: int, gram: int = GRAM) -> list[np.ndarray]:
    """For each segment, a mask of its windows that occur again, in it or in another segment."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array([len(p) for p in parts])
    edge = np.r_[0, np.cumsum(n)]
    out = np.zeros(len(b), bool)
    # only where a window's first and last bytes both occur again in some window can it be repeated
    h = Hasher(1)
    h.load(b)
    count = n - length + 1
    at = np.repeat(edge[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    ends = h.of(at, at + gram) * BASES[0] ^ h.of(at + length - gram, at + length)
    by = np.argsort(ends, kind="stable")
    same = ends[by][1:] == ends[by][:-1]
    able = np.zeros(len(b) + 1, bool)
    able[at[by[np.r_[False, same] | np.r_[same, False]]]] = True
    first, last = runs(able[:-1])
    # a segment's windows end before the next segment's begin, so a run stays inside its segment
    if len(first):
        pieces = _pieces(b, first, last + length - 1)
        for i, mask in zip(first, _search(pieces, length), strict=True):
            out[i : i + len(mask)] = mask
    return [out[edge[k] : edge[k] + count[k]] for k in range(len(parts))]


def _search(parts: list[bytes], length: int) -> list[np.ndarray]:
    """repeated_windows() by the suffix array of the parts; with a word of more than half a
    window among them (some windows might hold no word's start) all are taken byte by byte."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array([len(p) for p in parts])
    edge = np.r_[0, np.cumsum(n)]
    # words: from a part's start or behind a blank
    begin = np.zeros(len(b) + 1, bool)
    begin[1:] = _BREAKS[b]
    begin[edge[:-1]] = True
    starts = np.flatnonzero(begin[:-1])
    ends = np.r_[starts[1:], len(b)]
    if (ends - starts).max() > length // 2:
        starts = np.arange(len(b))
        ends = starts + 1
    of = np.searchsorted(edge, starts, "right") - 1
    names = _pieces(b, starts, ends)
    rank_of = {w: k + 1 for k, w in enumerate(sorted(set(names)))}
    rank = np.fromiter(map(rank_of.__getitem__, names), np.int64, len(names))
    # a separator, smaller than any word, behind every part
    spaced = np.zeros(len(rank) + len(parts), np.int64)
    spot = np.arange(len(rank)) + of
    spaced[spot] = rank
    back = np.full(len(spaced), -1)
    back[spot] = np.arange(len(rank))
    order = back[np.array(suffix_array(spaced.tolist()))]
    order = order[order >= 0]
    lcp = _common_prefix(starts, order, b, edge[of + 1])
    longest = np.empty(len(order), np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    # windows from a word on: as many as the longest match has
    delta = np.zeros(len(b) + 1, np.int64)
    long = longest >= length
    np.add.at(delta, starts[long], 1)
    np.add.at(delta, starts[long] + longest[long] - length + 1, -1)
    marked = np.cumsum(delta[:-1]) > 0
    # windows from e bytes before a word on: the next word's run must reach their end, the e bytes must agree
    before = np.r_[0, (ends - starts)[:-1]]
    before[starts == edge[of]] = 0
    if len(starts) == len(b):
        before[:] = 0  # every window starts a suffix already
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    h = Hasher(1)
    h.load(b)
    for e in range(1, min(length - 1, int(before.max(initial=0))) + 1):  # up to the word's start, where another window may be inside its word
        w = np.flatnonzero((before >= e) & (longest >= length - e))
        if not len(w):
            continue
        run = np.cumsum(lcp < length - e)[position[w]]
        head = h.of(starts[w] - e, starts[w])
        by = np.lexsort((head, run))
        same = (run[by][1:] == run[by][:-1]) & (head[by][1:] == head[by][:-1])
        again = by[np.r_[False, same] | np.r_[same, False]]
        marked[starts[w[again]] - e] = True
    return [marked[edge[k] : edge[k] + n[k] - length + 1] for k in range(len(parts))]


def _pieces(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = b.tobytes()
    return [data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def occurrences(texts: DataFrame, length: int, gram: int, merged: bool) -> DataFrame:
    """texts(row, text) -> key, c, lo, hi (segments in the batch, the least and the greatest) if merged, else key, seg, row, at, n for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for batch in batches:
            got, rows = [], batch["row"].to_numpy()
            for i, t in enumerate(batch["text"]):
                data = raw(t.as_py())
                if len(data) >= length:
                    got.append((i, *segments(np.frombuffer(data, np.uint8), h, length, gram)))
            if not got:
                continue
            key, seg, at, n = (np.concatenate([g[k] for g in got]) for k in range(1, 5))
            if merged:
                by = np.argsort(key, kind="stable")
                key, seg = key[by], seg[by]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[first], np.diff(np.r_[first, len(key)]), np.minimum.reduceat(seg, first), np.maximum.reduceat(seg, first))], ["key", "c", "lo", "hi"])
            else:
                row = rows[np.repeat([g[0] for g in got], [len(g[1]) for g in got])]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.array(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "seg", "row", "at", "n"])
        common.trim()

    return texts.mapInArrow(run, "key long, c long, lo long, hi long" if merged else "key long, seg long, row long, at int, n int")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """texts(row, text), row a long that only equal texts share -> row, spans (array of at, end): repeated bytes."""
    keys = occurrences(texts, length, gram, True).groupBy("key").agg(F.sum("c").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    keys = common.cut(keys.where(F.col("all") > 1).select("key", "all", (F.col("lo") != F.col("hi")).alias("differ")))
    met = common.cut(common.join_counted(occurrences(texts, length, gram, False), keys, ["key"], "all").drop("all"))
    # equal segments: a count each, and one copy; map-side combined, so a copied segment is no hot key
    each = common.cut(met.groupBy("key", "seg", "differ").agg(F.count("*").alias("c"), F.min(F.struct("row", "at", "n")).alias("one")))
    # copies of whole segments
    copied = each.where("c > 1").select("key", "seg", "c")
    whole = common.join_counted(met.select("key", "seg", "row", "at", "n"), copied, ["key", "seg"], "c").select("row", F.struct("at", (F.col("at") + F.col("n")).alias("end")).alias("span"))
    # different segments under one key
    variants = common.cut(each.where("differ").groupBy("key").agg(F.count("*").alias("variants")))
    largest, total = variants.agg(F.max("variants"), F.sum("variants")).first()
    differ = common.join_counted(each.where("differ").select("key", "seg", "c", "one"), variants, ["key"], "variants")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["asked"]
            flat = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            row = np.repeat(batch["row"].to_numpy(), counts)
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
            parts, k = [], 0
            for t, c in zip(batch["text"], counts.tolist(), strict=True):
                data = raw(t.as_py())
                parts += [data[i : i + m] for i, m in zip(at[k : k + c].tolist(), n[k : k + c].tolist(), strict=True)]
                k += c
            columns = [flat.field("key"), flat.field("seg"), pa.array(row), flat.field("at"), flat.field("open"), flat.field("variants"), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seg", "row", "at", "open", "variants", "bytes"])
        common.trim()

    def fetched(some: DataFrame) -> DataFrame:
        asked = common.cut(some.groupBy("one.row").agg(F.collect_list(F.struct("key", "seg", "one.at", "one.n", (F.col("c") == 1).alias("open"), "variants")).alias("asked")))
        needed = texts.join(F.broadcast(asked.select("row")), "row", "left_semi") if asked.count() <= BROADCAST_ROWS else texts
        return needed.join(asked, "row").select("row", "text", "asked").mapInArrow(fetch, "key long, seg long, row long, at int, open boolean, variants long, bytes binary")

    bins = max(1, -(-(total or 0) * 3 * length // 2 // bin_bytes))  # a segment has about 1.4 times the window's bytes

    def search(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["key", "seg"], ignore_index=True)
        # keys with an overlong word apart from the others
        odd = np.array([max(map(len, _SPLIT.split(x))) > length // 2 for x in p["bytes"]])
        odd = pd.Series(odd).groupby(p["key"]).transform("any").to_numpy()
        out = []
        for kind in (False, True):
            q = p[odd == kind]
            if len(q) > 1:
                for mask, row, at, is_open in zip(repeated_windows(list(q["bytes"]), length, gram), q["row"], q["at"], q["open"], strict=True):
                    if is_open and mask.any():
                        out += [(row, at + i, at + j - 1 + length) for i, j in zip(*runs(mask), strict=True)]
        return pd.DataFrame(out, columns=["row", "at", "end"])

    found = fetched(differ.where(F.col("variants") <= most)).withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).groupBy("bin").applyInPandas(search, "row long, at int, end int")
    spans = found
    if (largest or 0) > most:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = Hasher(0), Hasher(1)
            for batch in batches:
                for data, row, at, is_open in zip(*(batch[c].to_pylist() for c in ("bytes", "row", "at", "open")), strict=True):
                    b = np.frombuffer(data, np.uint8)
                    i = np.arange(len(b) - length + 1)
                    one.load(b)
                    two.load(b)
                    columns = [one.of(i, i + length).view(np.int64), two.of(i, i + length).view(np.int64), np.full(len(i), row), (at + i).astype(np.int32), np.full(len(i), is_open)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "row", "at", "open"])

        every = common.cut(fetched(differ.where(F.col("variants") > most)).mapInArrow(windows, "h1 long, h2 long, row long, at int, open boolean"))
        place = F.struct("row", "at", F.lit(length).alias("n"))
        twice = common.cut(every.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.array(F.min(place), F.max(place)).alias("two")).where("m > 1"))
        twins = twice.select(F.col("h1").alias("key"), F.col("h2").alias("seg"), F.lit(1).cast("bigint").alias("c"), F.lit(2).cast("bigint").alias("variants"), F.explode("two").alias("one"))

        def confirm(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values(["key", "seg"], ignore_index=True)
            kept = [k for k, mask in enumerate(repeated_windows(list(p["bytes"]), length, gram)) if mask[0]] if len(p) > 1 else []
            return p.loc[kept, ["key", "seg"]].drop_duplicates().rename(columns={"key": "h1", "seg": "h2"})

        pair_bins = max(1, -(-twice.count() * 2 * length // bin_bytes))
        sure = fetched(twins).withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(pair_bins))).groupBy("bin").applyInPandas(confirm, "h1 long, h2 long")
        sure = common.cut(twice.select("h1", "h2", "m").join(sure, ["h1", "h2"]))
        rest = common.join_counted(every.where("open"), sure, ["h1", "h2"], "m").select("row", "at", (F.col("at") + length).alias("end"))
        spans = spans.unionByName(rest)
    spans = whole.unionByName(spans.select("row", F.struct("at", "end").alias("span")))
    return spans.groupBy("row").agg(merged_spans(F.collect_set("span")).alias("spans"))


def merged_spans(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap put together."""
    kind = "array<struct<at: int, end: int>>"

    def add(done: Column, s: Column) -> Column:
        tail = F.try_element_at(done, F.lit(-1))
        longer = F.array(F.struct(tail["at"].alias("at"), F.greatest(tail["end"], s["end"]).alias("end")))
        # order by start, so only the last span can meet the next one
        return F.when((F.size(done) > 0) & (tail["end"] >= s["at"]), F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def merge(spans, size: int) -> np.ndarray:
    """Covered bytes of a text."""
    delta = np.zeros(size + 1, np.int64)
    for s in spans if spans is not None else ():
        delta[s["at"]] += 1
        delta[s["end"]] -= 1
    return np.cumsum(delta[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, removed (array of start, end in bytes), kept (the other bytes)."""
    common.bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    # rows that agree in id and text share their spans, so they may share the key
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    spans = common.cut(repeated_ranges(texts.select("row", "text"), length, gram, most, bin_bytes))
    size = spans.agg(F.sum(8 * F.size("spans") + 32)).first()[0] or 0
    joined = texts.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "row", "left")

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, kept = [], [], []
            for t, s in zip(batch["text"], batch["spans"], strict=True):
                data, s = raw(t.as_py()), s.as_py()
                n_bytes.append(len(data))
                if not s:
                    removed.append([])
                    kept.append(data)
                    continue
                mask = merge(s, len(data))
                removed.append([{"start": int(i), "end": int(j)} for i, j in zip(*runs(mask), strict=True)])
                kept.append(np.frombuffer(data, np.uint8)[~mask].tobytes())
            # ids stay Arrow's, as nulls beside large ones would not survive as numbers of pandas
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])
        common.trim()

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, removed array<struct<start: int, end: int>>, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
