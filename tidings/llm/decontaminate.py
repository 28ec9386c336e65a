"""Benchmark passages in documents, found by an FM-index per shard of documents.

A shard is one batch of documents. Its words are coded by the vocabulary of the benchmark; runs of
known words that are too short for any window are left out, since none can match there, and the
rest is indexed: suffix order, Burrows-Wheeler transform, wavelet matrix for ranks, every eighth
text position sampled. All windows are searched backward at once, occurrences are located by walking
to a sampled position, and the words they cover merge into spans.

The benchmark is held by every task. It comes in blocks of at most ``BLOCK_BYTES`` of text; a larger
benchmark means more passes over the documents, not more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import LOWER, as_bytes, map_batches, materialize, prepare

WINDOW = 10  # consecutive words of a window
SAMPLE = 8  # every so many text positions keep their place in the index
BLOCK_BYTES = 16_000_000  # benchmark text searched in one pass
# what is no word byte becomes a blank: words are digits, a-z and all bytes beyond ASCII
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling."""
    n, size = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new) - 1
        size *= 2
        if new.all() or size >= n:
            return order


class FMIndex:
    """Counts and places of patterns in a sequence of codes from 1 to ``top`` that ends with a single 0."""

    def __init__(self, codes: np.ndarray, top: int):
        order = suffix_order(codes)
        self.n = len(codes)
        self.last = codes[order - 1]  # the transform; before the whole text comes the 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=top + 1))))
        self.marked = order % SAMPLE == 0
        self.places = order[self.marked]
        self.place_rank = np.cumsum(self.marked) - 1
        self.zeros, self.ranks, level = [], [], self.last
        self.bits = range(max(1, int(top).bit_length()) - 1, -1, -1)
        for bit in self.bits:
            ones = (level >> bit) & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.int32))
            self.zeros.append(int(len(ones) - ones.sum()))
            level = np.concatenate((level[ones == 0], level[ones == 1]))

    def rank(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of ``code`` before ``row`` of the transform."""
        start = np.zeros_like(row)
        for bit, ones, zeros in zip(self.bits, self.ranks, self.zeros):
            one = (code >> bit) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            row = np.where(one, zeros + ones[row], row - ones[row])
        return row - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of patterns (one per line, codes at the right end, 0 before the first)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for at in range(patterns.shape[1] - 1, -1, -1):
            code = patterns[:, at]
            go = np.flatnonzero((code > 0) & (low < high))
            if len(go):
                c = code[go]
                low[go], high[go] = self.first[c] + self.rank(c, low[go]), self.first[c] + self.rank(c, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        place, steps, open_, row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        while len(open_):
            hit = self.marked[row[open_]]
            done = open_[hit]
            place[done] = self.places[self.place_rank[row[done]]] + steps[done]
            open_ = open_[~hit]
            code = self.last[row[open_]]
            row[open_] = self.first[code] + self.rank(code, row[open_])
            steps[open_] += 1
        return place


class Windows:
    """The distinct windows of a block of benchmark items, and which items have each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = tuple(self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text))
            for at in range(max(1, len(codes) - window + 1)) if codes else ():
                owners.setdefault(codes[at : at + window], set()).add(item)
        self.sizes = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), window), np.int64)
        for line, codes in zip(self.patterns, owners):
            line[window - len(codes) :] = codes
        self.owners = [sorted(x) for x in owners.values()]

    def find(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[set[str]]]:
        """Per text: which words are inside a window that occurs, and the items whose windows occur."""
        known, counts = [], []
        for text in texts:
            words = words_of(text)
            known.append(np.fromiter((self.codes.get(w, 0) for w in words), np.int64, len(words)))
            counts.append(len(words))
        hits, items = [np.zeros(n, bool) for n in counts], [set() for _ in counts]
        if not len(self.sizes):
            return hits, items
        codes = np.concatenate([x for k in known for x in (k, [0])]).astype(np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], codes > 0, [0])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long = end - start >= self.sizes.min()
        start, end = start[long], end[long]
        if not len(start):
            return hits, items
        # the runs that can match, each with a separator behind it
        size = end - start + 1
        there = np.arange(size.sum()) + np.repeat(start - np.cumsum(np.append(0, size[:-1])), size)
        held = codes[there]
        held[held == 0] = len(self.codes) + 1
        index = FMIndex(np.append(held, 0), len(self.codes) + 1)
        low, high = index.search(self.patterns)
        which = np.flatnonzero(high > low)
        n = high[which] - low[which]
        rows = np.arange(n.sum()) + np.repeat(low[which] - np.cumsum(np.append(0, n[:-1])), n)
        found = np.repeat(which, n)
        place = there[index.locate(rows)]
        depth = np.bincount(place, minlength=len(codes) + 1) - np.bincount(place + self.sizes[found], minlength=len(codes) + 1)
        covered = np.cumsum(depth) > 0
        begin = np.cumsum([0] + [c + 1 for c in counts])
        hits = [covered[b : b + c] for b, c in zip(begin, counts)]
        text_of = np.searchsorted(begin, place, side="right") - 1
        for t, w in np.unique(np.stack([text_of, found], 1), axis=0) if len(place) else ():
            items[t].update(self.owners[w])
        return hits, items


def byte_spans(text: bytes, hit: np.ndarray) -> list[int]:
    """Flat start and end bytes of the runs of words that are hit."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
    blank = np.frombuffer(text.translate(WORD_BYTES), np.uint8) == 0x20
    change = np.flatnonzero(np.diff(np.concatenate(([1], blank, [1])).astype(np.int8)))
    start, end = change[::2], change[1::2]
    return np.stack([start[edge[::2]], end[edge[1::2] - 1]], 1).ravel().tolist()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside a window that occurs), ``items`` and ``spans``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. ``items`` lists
    the ids of items with windows that occur, sorted as strings; ``spans`` has the start and end byte
    of each run of hit words, flat. Null and blank texts have no words and match nothing, on either
    side; items of one id count as one; repeated rows get equal results; an empty benchmark hits
    nothing. Columns of ``docs`` with the names of results are replaced.
    """
    prepare(docs.sparkSession)
    names = ["n_words", "n_hit", "items", "spans"]
    old = docs.drop(*names)
    at, width = old.columns.index(text_column), len(old.columns)
    items = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in old.schema)
    schema = f"{kind}, n_words bigint, n_hit bigint, items array<string>, spans array<bigint>, _hit binary"
    done = old
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        windows = Windows([(r["item"], (r["text"] or "").encode()) for r in part.toLocalIterator()], window)

        def run(*columns, windows=windows, block=block):
            texts = as_bytes(columns[at])
            hits, found = windows.find(texts)
            if block:  # words and items of the passes before
                hits = [h | np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)).astype(bool) for h, b in zip(hits, columns[-1].to_pylist())]
                found = [f | set(x) for f, x in zip(found, columns[-3].to_pylist())]
            return [
                *columns[:width], [len(h) for h in hits], [int(h.sum()) for h in hits], [sorted(f) for f in found],
                [byte_spans(t, h) if h.any() else [] for t, h in zip(texts, hits)], [np.packbits(h).tobytes() for h in hits],
            ]

        done = map_batches(done, [F.col(f"`{c}`") for c in done.columns], run, schema)
        if block < blocks - 1:
            done = materialize(done, "decontamination")
    return done.drop("_hit")
