"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Each document is tokenised and closed with one separator id. Whole windows are cut off its front and
stand alone; the rest is halved again and again into parts that a block's differencing run spreads over its windows:
partial partitions with opposing imbalances are merged (largest against smallest sums) until one
near-equal partition is left, and the window count rises while any window exceeds the capacity.
A block is a run of documents as they lie in a task's input, so each task packs what it reads: nothing
is shuffled, copies of a row are spread like other rows, and the input's order is kept but inside blocks.
A task that is run again packs its rows anew as a whole, so lost executors leave no piece out or double.

Defined cases: null text counts as empty (its document is the separator alone); very long texts are
many whole windows; an empty table gives no rows; null or repeated doc_ids are packed like any other
rows, and ids of any type are passed on as they are; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .hashing import Hasher

CAPACITY, SEPARATOR = 2048, 1
#: halving ends at parts of about so many tokens
LEAST = 32
#: documents of a block
BLOCK_DOCS = 512
#: distinct words whose ids a Python worker remembers before it starts afresh, and bytes of text it takes at once
WORDS, SLICE = 1_000_000, 1 << 20
#: words looked up last that are searched apart, until they are merged with the others
RECENT = 100_000


#: words of these letters are one pre-token each
_LATIN = re.compile("[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
#: marks behind a letter that end a word are a pre-token of their own
_MARKS = "([a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])([.,;:!?%&$#*]+)([ \\n]|$)"


class WordEncoder:
    """ids of whole texts by a tokenizer whose pre-tokenizer drops white space.

    No token of such a tokenizer spans white space, so a text's ids are its words' ids one after the
    other. Texts are split at ASCII white space (longer words are only more work), the distinct words
    of a slice are looked up, and each new one is given to the tokenizer once. The tokenizer must mark
    word ends with `</w>`. Known words are kept as sorted 64-bit hashes and places in a pool of ids,
    about 40 bytes each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.hasher = Hasher()
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known, self.recent = none, none  # sorted hashes and their words' places; recent ones apart
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words, and how many each has."""
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters alone are one pre-token each, so many go in one call, parted at word ends."""
        out = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for k in range(0, len(words), 5000):
            run = words[k : k + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(run), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            out.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(run) and ends[-1] == len(ids) else self._single(run))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the pool has each of the (distinct) words."""
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        self.hasher.load(np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        offsets = offsets - offsets[0]
        hashes = self.hasher.of(offsets[:-1], offsets[1:])
        if len(self.starts) > WORDS:
            self._forget()
        out = np.full(len(words), -1)
        for keys, places in (self.known, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, places[at], out)
        new = np.flatnonzero(out < 0)
        if len(new):
            names = words.take(pa.array(new)).to_pylist()
            plain = np.array([w.isalpha() and _LATIN.fullmatch(w) is not None for w in names])
            order = np.r_[new[plain], new[~plain]]
            a, b = self._plain([w for w, p in zip(names, plain, strict=True) if p]), self._single([w for w, p in zip(names, plain, strict=True) if not p])
            out[order] = len(self.starts) - 1 + np.arange(len(order))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([a[1], b[1]]))])
            self.ids = np.concatenate([self.ids, a[0], b[0]])
            self.recent = _sorted(np.concatenate([self.recent[0], hashes[order]]), np.concatenate([self.recent[1], out[order]]))
            if len(self.recent[0]) > RECENT:
                self.known = _sorted(*(np.concatenate(x) for x in zip(self.known, self.recent, strict=True)))
                self.recent = self.recent[0][:0], self.recent[1][:0]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) and where each text's ids begin, with the end."""
        # taken anew: some string kernels misread slices
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        # case and these blanks make no difference to the tokenizer, but fewer distinct words
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, r"\1 \2\3"))
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        place = self._places(flat.dictionary.cast(pa.large_string()))[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        lengths = (self.starts[1:] - self.starts[:-1])[place]
        after = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[place] - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.r_[0, after][ends - ends[0]]


def _sorted(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    return keys[by], places[by]


_HELD: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python process: the words that earlier tasks looked up are still known."""
    from tidemark.llm import packing  # the module that the process imported, whatever copy of this function came with the task

    if path not in packing._HELD:
        packing._HELD[path] = WordEncoder(path)
    return packing._HELD[path]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text; a longer text is a run of its own."""
    nbytes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(nbytes) - nbytes) // size
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True]) if len(run) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def _cut(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of a document's pieces: whole windows, then halves of what is left, halved again.

    The geometric parts give differencing both large pieces and the small ones that even them out.
    """
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    while rest > 2 * least:
        out.append(rest - rest // 2)
        rest //= 2
    return [*out, rest] if rest else out


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Karmarkar-Karp: the window of each size, sums as equal as differencing makes them."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []  # of node n + i: both parts, and the first part's slot at each slot
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        s = np.zeros(windows, np.int64)
        s[0] = sizes[i]
        sums[int(i)] = s  # descending
        heap.append((-int(sizes[i]), len(heap), int(i)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        s = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-s, kind="stable")
        node = n + len(made)
        made.append((a, b, order.astype(np.int32)))
        sums[node] = s = s[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), node, node))
    # top down: window of each slot of each node
    slot: dict[int, np.ndarray] = {heap[0][2]: np.arange(windows)}
    out = np.empty(n, np.int64)
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[node - n]
        at = np.empty(windows, np.int64)
        at[order] = slot.pop(node)  # window of each of a's slots
        slot[a], slot[b] = at, at[::-1]
        made[node - n] = None
    for i in range(n):
        out[i] = slot[i][0]
    return out


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; no window's sum exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if not len(sizes) or np.bincount(window, sizes, windows).max() <= capacity:
            return window
        windows += 1


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece of a block: whole windows alone, the others by differencing, larger pieces first."""
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    whole = int((size == capacity).sum())
    window = np.concatenate([np.arange(whole), whole + fill(size[whole:], capacity)])
    by = np.argsort(window, kind="stable")
    before = np.cumsum(size[by]) - size[by]
    first = np.r_[True, window[by][1:] != window[by][:-1]]
    windows, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    windows[order] = window
    offsets[order[by]] = before - np.maximum.accumulate(np.where(first, before, 0))
    return windows, offsets


NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of every row."""
    common.bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer), np.array([SEPARATOR], "<u4")
        held: list[tuple[pa.Array, np.ndarray]] = []  # of the open block: ids of documents and their pieces
        docs_held, sequence = 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            numbers = np.concatenate([n for _, n in held], 1)
            window, offset = place(numbers[1], capacity)
            columns = [*numbers, sequence + window, offset]
            sequence += int(window.max()) + 1
            return pa.RecordBatch.from_arrays([pa.concat_arrays([i for i, _ in held]), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *NUMBERS])

        for whole in batches:
            for b in (x for s in slices(whole, "text") for x in parted(s, block_docs)):
                if docs_held + b.num_rows > block_docs:
                    yield packed()
                    held, docs_held = [], 0
                ids, begins = encoder.encode(b["text"])
                row, numbers = [], []
                for k in range(b.num_rows):
                    own, at = np.concatenate([ids[begins[k] : begins[k + 1]], end]).astype("<u4"), 0
                    for n in _cut(len(own), capacity, least):
                        row.append(k)
                        numbers.append((at, n, zlib.crc32(own[at : at + n]), len(own)))
                        at += n
                held.append((b["doc_id"].take(pa.array(row, pa.int64())), np.array(numbers, np.int64).T))
                docs_held += b.num_rows
        if held:
            yield packed()
        common.trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NUMBERS))


def parted(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
