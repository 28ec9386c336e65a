"""Removal of long word passages that repeat, by a compacted de Bruijn graph of word k-mers.

A window of ``WINDOW`` words is an edge of the graph, from the node of its first words to the node of its last
(``NODE`` words each). Edges whose sequence starts at two places or more stay. Where a node has one of them coming in and
one going out nothing branches, and the two belong to one path: a passage that all its sources share.

1. Dealing. Of the ``GRAM``-word grams in a node the one with the smallest hash names it, so a node has one name
   wherever it stands. Consecutive nodes of one name form a run. Names that occur once hold no repeated edge; they go
   before any text moves. Equal runs are one run with a weight.
2. Compaction inside a name. The runs of a share of the names form one collection. A run brings one word more on either side, so
   every edge into or out of its nodes is there with its full count, and whether a node branches is known. Edges are
   equal if two unrelated 64-bit hashes of their words are. Chains of edges become pieces, each named by one of its edges.
3. Compaction between names, by Spark joins. An edge between nodes of two shares ends a piece of one
   and begins a piece of the other; that links the two, and doubling pointers along the links finds each chain's first piece.
4. Verification by source coordinates. Pieces go back to every place where their run stands. A path's pieces that follow each
   other in a text become one span. A span has at least ``WINDOW`` words and each of its windows has at least two
   sources, itself included.

A name with very many different runs (a gram of a line that a third of all documents have, each with other words around it)
is too much for one collection. Its edges become rows, are counted and lose what occurs once before anything meets; nodes and
degrees are groups by node then, and every edge is a piece of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.plans.skew import salted_join
from tidings.llm.common import WordHashes, as_bytes, lists_of, map_batches, materialize, mixed, odd_numbers, prepare, row_key

WINDOW = 35  # words of a window whose repeats are removed
NODE = WINDOW - 1
GRAM = 10  # words of a gram that names nodes
SHARD_BYTES = 3_000_000  # text that one collection holds
HOT_RUNS = 50_000  # different runs of one name that may meet in one collection
STEPS = odd_numbers(12, 11)
BASE = odd_numbers(1, 17)[0]
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PIECES = "m bigint, d bigint, spans array<bigint>, edges array<bigint>, labels array<bigint>, ends array<boolean>"


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all sequences of ``size`` words, put together from sequences of powers of two."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, have, part, span, k = None, 0, h, 1, 0
    while True:
        if size & span:
            n = len(h) - have - span + 1
            out = part[:n] if out is None else mixed(out[:n] * STEPS[k] + part[have : have + n])
            have += span
        if 2 * span > size:
            return out
        part = part[:-span] * STEPS[k + 1] + part[span:]
        part = part ^ (part >> np.uint64(31))
        span, k = 2 * span, k + 1


def stretches(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``start`` to ``end``, wherever they stand: differences of running sums of a polynomial."""
    n = len(h)
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, BASE_INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(h) * up[:n], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * STEPS[-1])


def node_runs(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of nodes of one name in texts that stand one after another.

    Number of the text, name, first node, number of nodes, whether an edge may occur twice in it.
    """
    if len(h) < WINDOW:
        return (np.zeros(0, np.int64),) * 5
    g = mixed(grams(h, GRAM))
    # 52 bits of hash, then the place: equal grams in one node count as several
    best = (g & np.uint64(0xFFFFFFFFFFFFF000)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(0xFFF))
    wide, reach = NODE - GRAM + 1, 1
    while 2 * reach <= wide:
        best, reach = np.minimum(best[:-reach], best[reach:]), 2 * reach
    if reach < wide:
        best = np.minimum(best[: len(best) - (wide - reach)], best[wide - reach :])
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(best)]
    at = np.arange(len(best)) - first[text]
    inside = (at + NODE <= sizes[text]) & (sizes[text] >= WINDOW)
    name = (best >> np.uint64(12)).view(np.int64)
    new = inside.copy()
    new[1:] &= (name[1:] != name[:-1]) | ~inside[:-1] | (at[1:] == 0)
    start = np.flatnonzero(new)
    kept = np.flatnonzero(inside)
    nodes = np.diff(np.append(np.searchsorted(kept, start), len(kept)))
    moved = np.concatenate(([0], np.cumsum(best[1:] != best[:-1])))
    return text[start], name[start], at[start], nodes, moved[start + nodes - 1] > moved[start]


def hashed(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each."""
    found = [hashes.of((t or b"").split()) for t in texts]
    return np.concatenate(found), np.array([len(h) for h in found])


def name_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """Names that more than one place has."""
    hashes = WordHashes()

    def run(texts):
        _, m, _, _, twice = node_runs(*hashed(as_bytes(texts), hashes))
        names, at = np.unique(m, return_inverse=True)
        return [names, np.bincount(at, twice.astype(np.int64) + 1, len(names)).astype(np.int64)]

    counted = map_batches(docs, [F.col(text_column)], run, "m bigint, c bigint")
    return counted.groupBy("m").agg(F.sum("c").alias("c")).where("c > 1").select("m")


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every run: row key, name ``m``, digest ``d`` of its words and those beside it, first node ``at``, number of ``nodes``."""
    hashes = WordHashes()

    def run(k1, k2, texts):
        h, sizes = hashed(as_bytes(texts), hashes)
        text, m, at, nodes, _ = node_runs(h, sizes)
        first = (np.cumsum(sizes) - sizes)[text]
        left = (at > 0).astype(np.int64)
        d = stretches(h, first + at - left, first + np.minimum(at + nodes + NODE, sizes[text]))
        rows = pa.array(text)
        return [k1.take(rows), k2.take(rows), m, (d ^ left.view(np.uint64)).view(np.int64), at.astype(np.int32), nodes.astype(np.int32)]

    return map_batches(docs, [*row_key(id_column, text_column), F.col(text_column)], run, "_k1 string, _k2 bigint, m bigint, d bigint, at int, nodes int")


def segments(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Words of the wanted runs, the ones beside them included; ``left`` says that there is one before."""
    packed = wanted.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("m", "d", "at", "nodes", "weight")).alias("runs"))
    texts = docs.select(*row_key(id_column, text_column), F.col(text_column).alias("text")).dropDuplicates(["_k1", "_k2"])

    def run(texts, runs):
        out = [[], [], [], [], [], []]
        for text, these in zip(as_bytes(texts), runs.to_pylist()):
            words = text.split()
            for r in these:
                a = r["at"]
                made = (r["m"], r["d"], r["weight"], a > 0, r["nodes"], b" ".join(words[max(a - 1, 0) : a + r["nodes"] + NODE]))
                for column, x in zip(out, made):
                    column.append(x)
        return out

    schema = "m bigint, d bigint, weight bigint, left boolean, nodes int, words binary"
    return map_batches(texts.join(packed, ["_k1", "_k2"]), ["text", "runs"], run, schema)


class Edges:
    """All edges of a collection of runs, in text order: two hashes, end nodes, place in the words, run, weight, whose they are."""

    def __init__(self, texts: list[bytes], weights: np.ndarray, left: np.ndarray, nodes: np.ndarray):
        words, sizes = hashed(texts, WordHashes())
        first = np.cumsum(sizes) - sizes
        counts = sizes - WINDOW + 1
        self.run = np.repeat(np.arange(len(sizes)), counts)
        self.step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(first, counts) + self.step
        self.hash = grams(words, WINDOW)[self.place]
        self.second = stretches(words, self.place, self.place + WINDOW)
        node = grams(words, NODE)
        self.source, self.target = node[self.place], node[self.place + 1]
        self.weight = weights[self.run]
        self.left = left.astype(np.int64)
        self.own = self.step >= self.left[self.run]  # the edge before the run counts only where its own first node is at home
        self.own_nodes = np.unique(np.concatenate([self.source[self.own], self.target[self.step - self.left[self.run] + 1 < nodes[self.run]]]))


def repeated_edges(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each edge the number of its kind among the repeated ones, or -1; the first edge of each kind; whether it is at home here."""
    order = np.lexsort((e.second, e.hash))
    h, second = e.hash[order], e.second[order]
    same = (h[1:] == h[:-1]) & (second[1:] == second[:-1])
    start = np.concatenate(([0], np.flatnonzero(~same) + 1))
    own = np.add.reduceat(e.weight[order] * e.own[order], start)
    count = np.where(own > 0, own, np.add.reduceat(e.weight[order] * ~e.own[order], start))
    kinds = np.flatnonzero(count > 1)
    number = np.full(len(start), -1)
    number[kinds] = np.arange(len(kinds))
    kind = np.empty(len(order), np.int64)
    kind[order] = number[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))]
    return kind, order[start[kinds]], own[kinds] > 0


def chain_labels(h: np.ndarray, source: np.ndarray, target: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Hash of one edge of the unbranched chain that each edge is in; chains pass through nodes of ``inner`` only."""
    n = len(h)
    nodes, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
    a, b = ends[:n], ends[n:]
    single = (np.bincount(a, minlength=len(nodes)) == 1) & (np.bincount(b, minlength=len(nodes)) == 1) & np.isin(nodes, inner)
    arrives = np.full(len(nodes), -1)
    arrives[b] = np.arange(n)
    before = np.where(single[a], arrives[a], np.arange(n))
    first = before == np.arange(n)
    label = h.copy()
    for _ in range(max(1, int(n).bit_length()) + 1):  # doubling; a ring ends up with its smallest hash
        label, before = np.minimum(label, label[before]), before[before]
    return np.where(first[before], h[before], label)


def compacted(parts: DataFrame, key: str) -> DataFrame:
    """``PIECES`` of the runs of each group: spans (first window, windows, piece) by run; edges on the border with their piece.

    ``ends`` tells that the piece ends with the edge; else it begins with it.
    """

    def run(table):
        e = Edges(as_bytes(table["words"].combine_chunks()), table["weight"].to_numpy(), table["left"].to_numpy(), table["nodes"].to_numpy())
        kind, first, home = repeated_edges(e)
        h, source, target = e.hash[first], e.source[first], e.target[first]
        label = chain_labels(h, source, target, e.own_nodes)
        border = ~home | ~np.isin(target, e.own_nodes)
        on = np.flatnonzero((kind >= 0) & e.own)
        piece = label[kind[on]]
        new = np.ones(len(on), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (e.run[on][1:] != e.run[on][:-1]) | (e.step[on][1:] != e.step[on][:-1] + 1)
        start = np.flatnonzero(new)
        owner = e.run[on][start]
        flat = np.stack([
            e.step[on][start] - e.left[owner], np.diff(np.append(start, len(on))), piece[start].view(np.int64)
        ], 1).ravel().astype(np.int64)
        spans = lists_of(flat, 3 * np.bincount(owner, minlength=table.num_rows))
        none = pa.nulls(table.num_rows, pa.list_(pa.int64()))
        made = pa.table({
            "m": table["m"], "d": table["d"], "spans": spans, "edges": none, "labels": none, "ends": pa.nulls(table.num_rows, pa.list_(pa.bool_()))
        })
        some = int(border.sum())
        rest = pa.table({
            "m": pa.nulls(1, pa.int64()), "d": pa.nulls(1, pa.int64()), "spans": pa.nulls(1, pa.list_(pa.int64())),
            "edges": lists_of(h[border].view(np.int64), [some]), "labels": lists_of(label[border].view(np.int64), [some]), "ends": lists_of(home[border], [some]),
        })
        return pa.concat_tables([made.filter(pa.array(np.bincount(owner, minlength=table.num_rows) > 0)), rest])

    return parts.groupBy(key).applyInArrow(run, PIECES)


def in_shards(parts: DataFrame, size: int) -> DataFrame:
    """``compacted`` over as many shards of the names as ``size`` bytes call for."""
    shards = max(1, -(-size // SHARD_BYTES))
    return compacted(parts.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))), "shard")


def edge_rows(parts: DataFrame) -> DataFrame:
    """The edges of runs as rows; ``step`` counts from the run's first node, ``words`` is the second hash."""

    def run(m, d, weight, left, nodes, words):
        e = Edges(as_bytes(words), weight.to_numpy(), left.to_numpy(zero_copy_only=False), nodes.to_numpy())
        at = pa.array(e.run)
        signed = [x.view(np.int64) for x in (e.hash, e.second, e.source, e.target)]
        inner = e.step - e.left[e.run] + 1 < nodes.to_numpy()[e.run]
        return [m.take(at), d.take(at), e.weight, (e.step - e.left[e.run]).astype(np.int32), *signed, e.own, inner]

    schema = "m bigint, d bigint, weight bigint, step int, edge bigint, words bigint, source bigint, target bigint, own boolean, inner boolean"
    return map_batches(parts, ["m", "d", "weight", "left", "nodes", "words"], run, schema)


def compacted_hot(parts: DataFrame) -> DataFrame:
    """What ``compacted`` gives, for runs of names with very many of them: edge by edge, in joins."""
    rows = edge_rows(parts)
    total = lambda own: F.sum(F.when(F.col("own") == own, F.col("weight")).otherwise(0))
    counted = rows.groupBy("edge", "words").agg(
        total(True).alias("at_home"), total(False).alias("beside"), F.first("source").alias("source"), F.first("target").alias("target"),
        F.max("inner").alias("inner"),
    ).where(F.when(F.col("at_home") > 0, F.col("at_home")).otherwise(F.col("beside")) > 1)
    kinds = materialize(counted, "hot-edges")
    # nodes at home: sources of edges at home, targets inside a run
    inner = kinds.where("at_home > 0").select(F.col("source").alias("node")).union(kinds.where("inner").select("target")).distinct()
    arriving = kinds.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("edge").alias("a"))
    leaving = kinds.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("edge").alias("b"))
    links = arriving.where("n_in = 1").join(leaving.where("n_out = 1"), "node").join(inner, "node", "left_semi").where("a <> b")
    spans = rows.where("own").join(kinds.select("edge", "words"), ["edge", "words"], "left_semi").groupBy("m", "d").agg(
        F.flatten(F.collect_list(F.array(F.col("step").cast("long"), F.lit(1).cast("long"), "edge"))).alias("spans")
    )
    # an edge names its own piece; a link is told as a border of its own between two pieces
    outside = kinds.join(inner.withColumnRenamed("node", "target"), "target", "left_anti").where("at_home > 0")
    told = outside.select("edge", F.col("edge").alias("label"), F.lit(True).alias("ends")).union(kinds.where("at_home = 0").select("edge", "edge", F.lit(False)))
    link = F.xxhash64("a", "b")
    told = told.union(links.select(link, "a", F.lit(True))).union(links.select(link, "b", F.lit(False)))
    none = lambda kind: F.lit(None).cast(kind)
    borders = told.select(none("bigint"), none("bigint"), none("array<bigint>"), F.array("edge"), F.array("label"), F.array("ends"))
    blank = [none("array<bigint>").alias("edges"), none("array<bigint>").alias("labels"), none("array<boolean>").alias("ends")]
    return spans.select("m", "d", "spans", *blank).union(borders)


def pieces(docs: DataFrame, places: DataFrame, id_column: str, text_column: str, hot_runs: int) -> DataFrame:
    """``PIECES`` of all different runs of ``places``, stored."""
    one = places.groupBy("m", "d").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("_k1", "_k2", "at", "nodes")).alias("r"))
    one = materialize(one.select("m", "d", "weight", "r.*"), "runs")
    parts = segments(docs, one, id_column, text_column)
    size = 7 * (one.agg(F.sum(F.col("nodes") + WINDOW)).first()[0] or 0)  # bytes of a word and its space, roughly
    hot = one.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_runs).select("m")
    if hot.isEmpty():
        return materialize(in_shards(parts, size), "pieces")
    parts, hot = materialize(parts, "segments"), materialize(hot, "hot-names")
    cold = in_shards(parts.join(hot, "m", "left_anti"), size)
    return materialize(cold.unionByName(compacted_hot(parts.join(hot, "m", "left_semi"))), "pieces")


def chain_heads(links: DataFrame) -> DataFrame:
    """``path`` of each ``piece`` that has one ``before`` it: the first piece of its chain, or the smallest of a ring.

    Pointers double: each round a piece takes over where the piece it points to has got, so the rounds are the logarithm of
    the longest chain. Pieces that begin a chain are not in the result; they are their own path.
    """
    state = materialize(links.select("piece", F.col("before").alias("path"), F.least("piece", "before").alias("low"), F.lit(True).alias("moved")), "chains")
    for _ in range(int(state.count()).bit_length() + 1):
        ahead = state.select(F.col("piece").alias("path"), F.col("path").alias("far"), F.col("low").alias("far_low"))
        state = materialize(
            state.join(ahead, "path", "left").select(
                "piece", F.coalesce("far", "path").alias("path"), F.least("low", "far_low").alias("low"), F.col("far").isNotNull().alias("moved")
            ),
            "chains",
        )
        if state.where("moved").isEmpty():
            break
    # what moves after as many rounds as there could be pieces is a ring
    return state.select("piece", F.when(F.col("moved"), F.col("low")).otherwise(F.col("path")).alias("path"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """Rows of ``docs`` that hold repeats, by row key, with ``spans``: flat list of first word, words and path, in any order."""
    prepare(docs.sparkSession)
    names = name_counts(docs, text_column)
    places = materialize(occurrences(docs, id_column, text_column).join(names, "m"), "places")
    made = pieces(docs, places, id_column, text_column, hot_runs)
    border = made.where("edges IS NOT NULL").select(F.explode(F.arrays_zip("edges", "labels", "ends")).alias("x")).select("x.*")
    side = lambda ends: F.max(F.when(F.col("ends") == ends, F.col("labels")))
    links = border.groupBy("edges").agg(side(False).alias("piece"), side(True).alias("before")).where("piece <> before").select("piece", "before")
    paths = chain_heads(links)
    span = F.explode(F.expr("transform(sequence(0, size(spans) div 3 - 1), i -> struct(spans[3 * i] AS first, spans[3 * i + 1] AS windows, spans[3 * i + 2] AS piece))"))
    found = made.where("spans IS NOT NULL").select("m", "d", span.alias("s")).select("m", "d", "s.*")
    found = salted_join(found, paths, ["piece"], "left")
    flat = F.flatten(F.collect_list(F.array("first", "windows", F.coalesce("path", "piece"))))
    found = materialize(found.groupBy("m", "d").agg(flat.alias("spans")), "paths")
    moved = F.transform("spans", lambda x, i: F.when(i % 3 == 0, x + F.col("at")).otherwise(x))
    return places.join(found, ["m", "d"]).select("_k1", "_k2", moved.alias("spans")).groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def joined_spans(flat: np.ndarray) -> np.ndarray:
    """Spans of words (start, end, path): pieces of one path that follow each other are one."""
    s = flat.reshape(-1, 3)
    if not len(s):
        return s
    s = s[np.lexsort((s[:, 0], s[:, 2]))]
    reach = s[:, 0] + s[:, 1]
    new = np.append(True, (s[1:, 2] != s[:-1, 2]) | (s[1:, 0] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    out = np.stack([s[new, 0], reach[last] + WINDOW - 1, s[new, 2]], 1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def remove_repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``passages`` (structs of ``start``, ``end``, ``path``) and ``kept_text``.

    Every word that a window of ``WINDOW`` words covers goes if the window's words also start anywhere else in the table, the
    same text included. Words are what white space separates, unchanged; ``kept_text`` has the others with one space
    between. Passages are in words, end exclusive, in order; those of one ``path`` are stretches of one unbranched
    chain, and they overlap where another chain goes on. Null texts have no words; repeated rows
    are each other's copies; an empty table stays empty. Columns of ``docs`` with the names of results are replaced.
    """
    names = ["n_words", "n_removed", "passages", "kept_text"]
    new = "n_words bigint, n_removed bigint, passages array<struct<start: bigint, end: bigint, path: bigint>>, kept_text string"
    old = docs.drop(*names)
    keyed = old.select("*", *row_key(id_column, text_column))
    spans = repeated_spans(docs, id_column, text_column, hot_runs).withColumnRenamed("spans", "_spans")
    both = keyed.join(spans, ["_k1", "_k2"], "left")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in old.schema)
    at = old.columns.index(text_column)

    def run(found, *columns):
        sizes, removed, flat, counts, kept = [], [], [], [], []
        for text, these in zip(as_bytes(columns[at]), found.to_pylist()):
            words, gone = (text or b"").split(), 0
            cut = joined_spans(np.array(these or [], np.int64))
            sizes.append(len(words))
            flat.append(cut)
            counts.append(len(cut))
            if len(cut):
                # passages are in order; what lies between is kept
                reach = np.concatenate(([0], np.maximum.accumulate(cut[:, 1]))).tolist()
                between = list(zip(reach, [*cut[:, 0].tolist(), len(words)]))
                left = [w for a, b in between for w in words[a : max(a, b)]]
                words, gone = left, len(words) - len(left)
            removed.append(gone)
            kept.append(b" ".join(words))
        rows = np.concatenate(flat).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "end", "path"])
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        return [*columns, sizes, removed, pa.ListArray.from_arrays(offsets, items), texts]

    return map_batches(both, ["_spans", *[F.col(f"`{c}`") for c in old.columns]], run, f"{kind}, {new}")
