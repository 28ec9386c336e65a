"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function orders the shingles of every document; the ``k`` smallest values are its sketch.
Inverted lists of the retained values generate the overlaps, the sketch of the union estimates the
similarity of what they bring together, and the full shingle sets decide.

Lists are kept short by a prefix rule: two sets with a Jaccard similarity of 0.75 share at least
``SHARED`` of 64 retained values (the chance of fewer is below one in a million), so one of the values
they share is among the ``k - SHARED + 1`` least frequent of either. A line that a third of all
documents carries is in nobody's prefix.

Large groups never become all pairs: documents with the same shingle set are one class, the members
of a list first meet one hub of it only, and after that only members that are still in different
components are compared, list by list inside tasks, which hand on the links that join components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.plans.skew import top_rows
from tidings.llm.common import (
    LOWER, WordHashes, as_bytes, components, lists_of, map_batches, materialize, mixed, odd_numbers, prepare, row_key,
)

WIDTH = 5  # words in a shingle
K = 64  # values that a sketch retains
SHARED = 30  # retained values that similar documents share at least
PERCENT = 75  # 100 * intersection >= PERCENT * union
SLACK = 0.32  # estimates this much below the threshold still go on to the exact test: six standard errors
HUBS = (1,)  # members of each list that the others meet, round by round, before all that is left
SHORT = 2  # longest list whose members meet as rows
PACK_ROWS = 2_000  # members of short lists that one task takes on together
FACTORS = odd_numbers(WIDTH, 2)


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; a text of fewer words than a shingle counts whole."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    h = hashes.of(words)
    if len(h) < WIDTH:
        return mixed(np.array([sum(int(x) * int(f) for x, f in zip(h, FACTORS)) + len(h) & (1 << 64) - 1], np.uint64)).view(np.int64)
    n = len(h) - WIDTH + 1
    total = h[:n] * FACTORS[0]
    for i in range(1, WIDTH):
        total = total + h[i : i + n] * FACTORS[i]
    return np.unique(mixed(total).view(np.int64))


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: ``id``, row key, ``n`` shingles, ``cls`` (digest of the shingle set) and ``sketch``."""

    hashes = WordHashes()  # of the task, from batch to batch

    def run(ids, k1, k2, texts):
        sets = []
        for text in as_bytes(texts):
            sets.append(shingle_set(text, hashes))
        short = [s[:K] for s in sets]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        values = np.concatenate(short) if short else np.zeros(0, np.int64)
        return [ids, k1, k2, [len(s) for s in sets], digests, lists_of(values, [len(s) for s in short])]

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, k1 string, k2 bigint, n bigint, cls binary, sketch array<bigint>"
    return map_batches(docs, [F.col(id_column).alias("id"), *row_key(id_column, text_column), F.col(text_column)], run, schema)


def prefix_lists(classes: DataFrame) -> DataFrame:
    """Inverted lists (``value``, ``cls``, ``n``) of the values in each class's prefix that others have too."""
    index = classes.select("cls", "n", F.explode("sketch").alias("value"))
    shared = index.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("cls").orderBy("df", "value")
    size = F.least(F.col("n"), F.lit(K))
    needed = F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100))
    placed = index.join(shared, "value").select(
        "value", "cls", "n",
        # values that only one class has come first in the order and are not in the join
        (size - F.count(F.lit(1)).over(Window.partitionBy("cls")) + F.row_number().over(order)).alias("at"),
        (size - needed + 1).alias("prefix"),
    )
    return placed.where("at <= prefix").select("value", "cls", "n")


def size_fits(a: str, b: str):
    """Sets of these sizes can be similar at all."""
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose union sketch does not rule out the threshold."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.where(common >= F.size(union) * (PERCENT / 100 - SLACK)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""

    hashes, sets = WordHashes(), {}  # of the task, from batch to batch

    def set_of(text):
        if text not in sets:
            if len(sets) >= 256:
                sets.clear()
            sets[text] = shingle_set(text, hashes)
        return sets[text]

    def run(a, b, texts_a, texts_b):
        keep = []
        for x, y in zip(as_bytes(texts_a), as_bytes(texts_b)):
            one, two = set_of(x), set_of(y)
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(one) + len(two) - common))
        return [a, b, keep]

    with_b = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    return map_batches(with_both, ["a", "b", "ta", "tb"], run, "a binary, b binary, similar boolean").where("similar").select("a", "b")


def apart(lists: DataFrame, known: DataFrame | None) -> DataFrame:
    """The lists that hold members of several components, with each member's ``label``."""
    if known is None:
        return lists.withColumn("label", F.col("cls"))
    placed = lists.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    still = placed.groupBy("value").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("value")
    return materialize(placed.join(still, "value", "left_semi"), "open-lists")


def meeting(some: DataFrame, placed: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Pairs (``a``, ``b``) of ``some`` with the other members of their lists, if still apart and not compared yet."""
    side = lambda df, x: df.select("value", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "label")])
    met = side(some, "x").join(side(placed, "y"), "value").where((F.col("label_x") != F.col("label_y")) & size_fits("n_x", "n_y"))
    pairs = met.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct()
    for done in tried:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    return pairs


def long_list_links(long: DataFrame, texts: DataFrame, block_rows: int = 1_000) -> DataFrame:
    """Links between members of lists, compared exactly inside tasks; no pair becomes a row.

    ``long`` has ``value``, ``cls``, ``n``, ``label``, ``size`` and ``prefix``. Lists of up to ``block_rows`` members are packed
    together. A longer list of ``m`` members is cut into ``m / block_rows`` blocks, and a task holds two of them. A pair is compared in
    the list of the smallest value that both prefixes share. Of the links found, those that join two labels are handed on.
    """
    packs = max(1, long.count() // PACK_ROWS)
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    dealt = long.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        F.when(blocks > 1, F.col("value")).otherwise(F.pmod(F.xxhash64("value"), F.lit(packs))).alias("pack"), "value",
        F.when(blocks > 1, F.least("block", "other")).otherwise(-1).alias("i"), F.when(blocks > 1, F.greatest("block", "other")).otherwise(-1).alias("j"),
        "block", "cls", "label", "prefix",
    ).join(texts, "cls")

    def overlaps(sets: list[np.ndarray]) -> np.ndarray:
        sizes = [len(s) for s in sets]
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        total, order = np.zeros((len(sets), len(sets)), np.float32), np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int((count > 1).sum()), 2_048):
            lo, hi = np.searchsorted(column, [start, start + 2_048])
            part = np.zeros((len(sets), 2_048), np.float32)
            part[row[lo:hi], column[lo:hi] - start] = 1
            total += part @ part.T
        return total

    def run(table):
        i, j = (table[c][0].as_py() for c in ("i", "j"))
        value, cls, label, block = (table[c].to_pylist() for c in ("value", "cls", "label", "block"))
        prefix = [np.array(p, np.int64) for p in table["prefix"].to_pylist()]
        text, hashes, sets = as_bytes(table["text"].combine_chunks()), WordHashes(), {}
        value, block = np.array(value), np.array(block)
        code = np.unique(np.array(label, object), return_inverse=True)[1]
        root = {int(c): int(c) for c in code}
        a, b = [], []

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def set_of(row):
            if cls[row] not in sets:
                sets[cls[row]] = shingle_set(text[row], hashes)
            return sets[cls[row]]

        for this in np.unique(value):
            members = np.flatnonzero(value == this)
            joined = np.array([top(int(c)) for c in code[members]])  # what the lists before have linked
            todo = (joined[:, None] != joined[None, :]) & np.triu(np.ones((len(members), len(members)), bool), 1)
            if i != j:
                todo &= block[members][:, None] != block[members][None, :]
            if not todo.any():
                continue
            todo &= overlaps([prefix[r][prefix[r] < this] for r in members]) == 0
            rows = np.flatnonzero(todo.any(0) | todo.any(1))
            if not len(rows):
                continue
            full = [set_of(members[r]) for r in rows]
            common, n = overlaps(full), np.array([len(s) for s in full])
            similar = todo[np.ix_(rows, rows)] & (100 * common >= PERCENT * (n[:, None] + n[None, :] - common))
            for x, y in zip(*np.nonzero(similar)):
                x, y = members[rows[x]], members[rows[y]]
                if (p := top(int(code[x]))) != (q := top(int(code[y]))):
                    root[p] = q
                    a.append(min(cls[x], cls[y]))
                    b.append(max(cls[x], cls[y]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("pack", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``text_hash``.

    ``component_id`` is the smallest id reachable over links, the row's own included; ``kept`` says
    that the row has that id. Null and blank texts have no shingles and no links. Null ids never
    become a component id unless nothing else is in the component; repeated rows are one class.
    An empty table gives an empty result, other columns are not looked at.
    """
    return grouped(docs, id_column, text_column).drop("group")


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``near_duplicates`` with ``group``, which tells groups apart whatever their ids are; null for texts without shingles."""
    prepare(docs.sparkSession)
    rows = materialize(sketches(docs, id_column, text_column), "sketches")
    classes = materialize(
        rows.where("n > 0").groupBy("cls").agg(
            F.min("id").alias("root"), F.min(F.struct("k1", "k2")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    lists = materialize(prefix_lists(classes), "lists")
    there = classes.join(lists.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("row.k1").alias("_k1"), F.col("row.k2").alias("_k2"))
    texts = materialize(
        docs.select(*row_key(id_column, text_column), F.col(text_column).alias("text")).join(there, ["_k1", "_k2"])
        .select("cls", "text").dropDuplicates(["cls"]),
        "texts",
    )

    links, known, tried = None, None, []
    for at, hubs in enumerate(HUBS):
        placed = apart(lists, known)
        found = materialize(estimated(meeting(top_rows(placed, ["value"], [F.xxhash64("cls", F.lit(at)), "cls"], hubs), placed, tried), classes), "pairs")
        more = materialize(verified(found, texts), "links")
        links = more if links is None else links.unionByName(more)
        tried.append(found)
        known = components(links)

    # whoever is still apart: lists of two as rows, the others inside tasks
    placed = apart(lists, known)
    sized = materialize(placed.join(placed.groupBy("value").agg(F.count(F.lit(1)).alias("size")), "value"), "sized-lists")
    short, long = sized.where(F.col("size") <= SHORT), sized.where(F.col("size") > SHORT)
    prefixes = lists.join(long.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.collect_list("value").alias("prefix"))
    links = (
        links.unionByName(verified(materialize(estimated(meeting(short, short, tried), classes), "pairs"), texts))
        .unionByName(long_list_links(long.join(prefixes, "cls"), texts))
    )
    known = components(links)

    label = F.coalesce("label", "cls")
    labelled = classes.select("cls", "root").join(known.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "root", label.alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("root").alias("component_id"))
    found = labelled.join(smallest, "label").select("cls", "component_id", "label")
    out = rows.select("id", "k2", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(found, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
        F.col("k2").alias("text_hash"), F.col("label").alias("group"),
    )


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row that stays of each group, as ``_id``, ``_hash`` (of the text) and ``count`` (rows equal to it).

    It has the smallest id, null after all others, and of these the smallest hash. Texts without shingles all stay.
    """
    alone = lambda c: F.when(F.col("group").isNull(), F.col(c))
    rows = grouped(docs, id_column, text_column).groupBy("group", F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).count()
    first = F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_hash", "count")).alias("first")
    return rows.groupBy("group", alone("_id").alias("a"), alone("_hash").alias("b")).agg(first).select("first._id", "first._hash", "first.count")
