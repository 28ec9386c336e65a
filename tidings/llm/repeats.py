"""Removal of long byte strings that repeat within or across documents.

A string of ``MIN`` bytes that starts at two places is found in three steps.

1. Dealing. Of the 64-byte grams in a window of ``MIN`` bytes the one with the smallest hash names the
   window, so equal windows have equal names wherever they stand. Consecutive windows of one name
   form a run. Names that occur once hold no repeat; they go before any text moves. Equal runs
   (923 copies of a page, say) are one run with a weight.
2. Interval expansion. The runs of a share of the names form one collection. Its text is read as
   strings of 40-byte blocks, one per phase, and a Burrows-Wheeler transform of these is extended
   backward breadth first: sorting the rows by the preceding block keeps the order of what follows,
   which is the LF mapping for every interval at once, and intervals of common prefixes of 40, 80,
   ... bytes appear by increasing length. Intervals with one occurrence are dropped as they appear, and
   the expansion stops at 200 bytes: what is left are the repeated windows.
3. Cutting. The windows found go back to every place where their run stands.

A name with very many runs, such as a gram of a passage that stands in a third of all documents, would be
too much for one collection. Its windows are first cut down by Spark: only those whose first and last
blocks occur together more than once go on, each under a name of its own made of the two, equal
windows as one. What surrounds the passage in one document only is gone by then.

Blocks are compared by 64-bit hashes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import as_bytes, lists_of, map_batches, materialize, mixed, odd_numbers, prepare, row_key

MIN = 200  # bytes of a string whose repeats are removed
GRAM = 64  # bytes of a gram that names windows
BLOCK = 40  # bytes by which common prefixes grow; MIN is a multiple
SHARD_BYTES = 6_000_000  # text that one Burrows-Wheeler collection holds
HOT_RUNS = 50_000  # runs of one name that may meet in one collection
BYTE_CODES = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)
STEPS = odd_numbers(8, 3)


def rolling(text: bytes, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of each of the (power of two) ``sizes``, by doubling."""
    h, size, made = BYTE_CODES[np.frombuffer(text, np.uint8)], 1, {}
    for step in STEPS:
        if size in sizes:
            made[size] = h
        if size >= max(sizes):
            return made
        h = h[:-size] * STEPS[size.bit_length() - 1] + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return made


def window_runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one name: name, first window, number of windows, whether the name occurs twice in it."""
    if len(text) < MIN:
        return (np.zeros(0, np.int64),) * 4
    h = rolling(text, (GRAM,))[GRAM] * STEPS[7]
    h ^= h >> np.uint64(29)
    # 52 bits of hash, then the place: equal grams in one window count as several
    best = (h & np.uint64(0xFFFFFFFFFFFFF000)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFF))
    width, reach = MIN - GRAM + 1, 1
    while 2 * reach <= width:
        best, reach = np.minimum(best[:-reach], best[reach:]), 2 * reach
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    name = (best >> np.uint64(12)).view(np.int64)
    start = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1))
    moved = np.concatenate(([0], np.cumsum(best[1:] != best[:-1])))
    end = np.append(start[1:], len(name))
    return name[start], start, end - start, moved[end - 1] > moved[start]


def name_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """Names that more than one window run could share."""

    def run(texts):
        found = [window_runs(x or b"") for x in as_bytes(texts)]
        names, at = np.unique(np.concatenate([r[0] for r in found]), return_inverse=True)
        twice = np.concatenate([r[3] for r in found]).astype(np.int64) + 1
        return [names, np.bincount(at, twice, len(names)).astype(np.int64)]

    counted = map_batches(docs, [F.col(text_column)], run, "m bigint, c bigint")
    return counted.groupBy("m").agg(F.sum("c").alias("c")).where("c > 1").select("m")


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every run of windows: row key, name ``m``, digest of its bytes ``d``, first window ``at``, ``windows``."""

    def run(k1, k2, texts):
        parts, lengths = [], []
        for text in as_bytes(texts):
            text = text or b""
            m, at, windows, _ = window_runs(text)
            d = [xxhash.xxh3_64_intdigest(text[a : a + n + MIN - 1]) for a, n in zip(at.tolist(), windows.tolist())]
            parts.append((m, np.array(d, np.uint64).view(np.int64), at, windows))
            lengths.append(len(m))
        rows = pa.array(np.repeat(np.arange(len(lengths)), lengths))
        m, d, at, windows = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(4))
        return [k1.take(rows), k2.take(rows), m, d, at, windows]

    return map_batches(
        docs, [*row_key(id_column, text_column), F.col(text_column)], run, "_k1 string, _k2 bigint, m bigint, d bigint, at bigint, windows bigint"
    )


def segments(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Bytes of the wanted runs (``m``, ``d``, ``at``, ``windows``, ``weight`` with the row key that has them)."""
    packed = wanted.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("m", "d", "at", "windows", "weight")).alias("runs"))
    texts = docs.select(*row_key(id_column, text_column), F.col(text_column).alias("text"))

    def run(texts, runs):
        out = [[], [], [], []]
        for text, these in zip(as_bytes(texts), runs.to_pylist()):
            for r in these:
                for column, x in zip(out, (r["m"], r["d"], r["weight"], text[r["at"] : r["at"] + r["windows"] + MIN - 1])):
                    column.append(x)
        return out

    return map_batches(texts.join(packed, ["_k1", "_k2"]), ["text", "runs"], run, "m bigint, d bigint, weight bigint, bytes binary")


def block_hashes(text: bytes) -> np.ndarray:
    """Hashes of all blocks of a text."""
    hashes = rolling(text, (8, 32))
    n = len(hashes[32]) - 8
    return mixed(hashes[32][:n] * STEPS[6] + hashes[8][32 : 32 + n])


def repeated_windows(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For all windows of all texts in a row: does the window occur more than once, weights counted?

    The rows of the transform are the suffixes that start at the windows; level by level the block
    before is put in front.
    """
    sizes = np.array([len(t) - MIN + 1 for t in texts])
    first = np.cumsum([0] + [len(t) for t in texts[:-1]])
    window = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(np.append(0, sizes[:-1])), sizes)
    block = block_hashes(b"".join(texts))
    weight = np.repeat(weights, sizes)
    rows, interval = np.arange(len(window)), np.zeros(len(window), np.int64)
    for back in range(MIN - BLOCK, -1, -BLOCK):
        before = block[window[rows] + back]
        order = np.argsort(before, kind="stable")
        rows, before, interval = rows[order], before[order], interval[order]
        new = np.ones(len(rows), bool)
        new[1:] = (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])
        start = np.flatnonzero(new)
        if not len(start):
            break
        keep = np.add.reduceat(weight[rows], start) > 1
        interval = np.cumsum(new) - 1
        keep = keep[interval]
        rows, interval = rows[keep], interval[keep]
    found = np.zeros(len(window), bool)
    found[rows] = True
    return found


def repeated_in(parts: DataFrame, key: str) -> DataFrame:
    """Per segment (``m``, ``d``): ``spans``, flat list of start and end of what repeats, from the segment's start."""

    def run(table):
        texts = as_bytes(table["bytes"].combine_chunks())
        weights = table["weight"].to_numpy()
        found = repeated_windows(texts, weights)
        sizes = np.array([len(t) - MIN + 1 for t in texts])
        end = np.cumsum(sizes)
        # a window that does not repeat between segments keeps runs apart
        padded = np.zeros(len(found) + len(sizes) + 1, np.int8)
        shift = np.repeat(np.arange(len(sizes)), sizes) + 1
        padded[np.arange(len(found)) + shift] = found
        edge = np.flatnonzero(np.diff(padded))
        starts, ends = edge[::2], edge[1::2]
        owner = np.searchsorted(end + np.arange(len(sizes)), starts, side="right")
        begin = (end - sizes + np.arange(len(sizes)))[owner]
        spans = np.stack([starts - begin, ends - begin + MIN - 1], 1).ravel().astype(np.int64)
        return pa.table({"m": table["m"], "d": table["d"], "spans": lists_of(spans, 2 * np.bincount(owner, minlength=len(sizes)))})

    return parts.groupBy(key).applyInArrow(run, "m bigint, d bigint, spans array<bigint>")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (n, 2) in order, overlapping and touching ones joined."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1)


def in_shards(parts: DataFrame, size: int) -> DataFrame:
    """``repeated_in`` over as many shards of the names as ``size`` bytes call for."""
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
    return repeated_in(dealt, "shard").where(F.size("spans") > 0)


def repeated_in_hot(parts: DataFrame) -> DataFrame:
    """What ``repeated_in`` finds, for segments of names with very many runs: window by window."""

    def run(m, d, weight, texts):
        names, digests, at, data = [], [], [], []
        rows = []
        for text in as_bytes(texts):
            n = len(text) - MIN + 1
            block = block_hashes(text)
            names.append(mixed(block[:n] * STEPS[5] + block[MIN - BLOCK : MIN - BLOCK + n]).view(np.int64))
            at.append(np.arange(n))
            windows = [text[i : i + MIN] for i in range(n)]
            data += windows
            digests += [xxhash.xxh3_64_intdigest(w) for w in windows]
            rows.append(n)
        owner = pa.array(np.repeat(np.arange(len(rows)), rows))
        return [m.take(owner), d.take(owner), weight.take(owner), np.concatenate(names), np.array(digests, np.uint64).view(np.int64), np.concatenate(at), data]

    schema = "own_m bigint, own_d bigint, weight bigint, m bigint, d bigint, at bigint, bytes binary"
    windows = map_batches(parts, ["m", "d", "weight", "bytes"], run, schema)
    shared = windows.groupBy("m").agg(F.sum("weight").alias("n")).where("n > 1").select("m")
    windows = materialize(windows.join(shared, "m", "left_semi"), "hot-windows")
    one = windows.groupBy("m", "d").agg(F.sum("weight").alias("weight"), F.min("bytes").alias("bytes"))
    found = in_shards(one, windows.count() * MIN)
    return windows.join(found.select("m", "d"), ["m", "d"]).groupBy(F.col("own_m").alias("m"), F.col("own_d").alias("d")).agg(
        F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + MIN))).alias("spans")
    )


def repeat_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """Rows of ``docs`` that hold repeats, by row key, with ``spans`` (lists of start and end, not merged yet)."""
    prepare(docs.sparkSession)
    names = name_counts(docs, text_column)
    places = materialize(occurrences(docs, id_column, text_column).join(names, "m"), "places")
    one = places.groupBy("m", "d").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("_k1", "_k2", "at", "windows")).alias("r"))
    wanted = one.select("m", "d", "weight", "r.*")
    size = places.agg(F.sum(F.col("windows") + MIN - 1)).first()[0] or 0  # copies included, so shards are no larger than asked for
    parts = segments(docs, wanted, id_column, text_column).dropDuplicates(["m", "d"])
    hot = places.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_runs).select("m")
    if hot.isEmpty():
        found = in_shards(parts, size)
    else:
        parts, hot = materialize(parts, "segments"), materialize(hot, "hot-names")
        found = in_shards(parts.join(hot, "m", "left_anti"), size).unionByName(repeated_in_hot(parts.join(hot, "m", "left_semi")))
    there = places.join(materialize(found, "repeats"), ["m", "d"]).select("_k1", "_k2", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    return there.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (removed, flat) and ``kept_bytes``.

    Every byte that a string of ``MIN`` bytes covers goes if that string also starts anywhere else in
    the table, the same text included. Texts are UTF-8 bytes; what is kept may not be valid UTF-8 and
    is binary. Null texts are empty; repeated rows are each other's copies; an empty table stays
    empty. Columns of ``docs`` with the names of results are replaced.
    """
    new = "n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept_bytes binary"
    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"]
    old = docs.drop(*names)
    keyed = old.select("*", *row_key(id_column, text_column))
    spans = repeat_spans(docs, id_column, text_column, hot_runs).withColumnRenamed("spans", "_spans")
    both = keyed.join(spans, ["_k1", "_k2"], "left")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in old.schema)
    at = old.columns.index(text_column)

    def run(found, *columns):
        sizes, removed, counts, flat, kept = [], [], [], [], []
        for text, these in zip(as_bytes(columns[at]), found.to_pylist()):
            text = text or b""
            cut = merged(np.array(these or [], np.int64).reshape(-1, 2))
            edges = [0, *cut.ravel().tolist(), len(text)]
            sizes.append(len(text))
            removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
            counts.append(len(cut))
            flat.append(cut.ravel())
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return [*columns, sizes, removed, counts, lists_of(np.concatenate(flat), [len(x) for x in flat]), kept]

    return map_batches(both, ["_spans", *[F.col(f"`{c}`") for c in old.columns]], run, f"{kind}, {new}")
