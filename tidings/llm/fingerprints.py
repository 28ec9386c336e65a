"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A fingerprint holds, in three small tables, per cell the number of paragraphs that hash there and the XOR
of their digests. Two fingerprints subtract cell by cell, which cancels all common paragraphs; peeling
cells with a single digest left recovers what differs, in both directions. If too much differs for
the size, both tables are built again with twice the cells.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings.llm.common import prepare

CELLS = 24  # of a fingerprint; a multiple of three
ROWS_PER_BUCKET = 2_000  # documents in id order that are handled together
MAX_BUCKETS = 20_000  # bound on the split points that every task knows
GROWTH = 4  # times as many cells for another try
SENTENCE_ENDS = (b". ", b"! ", b"? ")  # a paragraph ends with its line, or with a sentence if the line goes on


def paragraph_digests(text: bytes) -> list[int]:
    """Distinct 64-bit digests of the paragraphs of a text; the second of two equal ones differs from the first."""
    seen: dict[bytes, int] = {}
    digests = set()  # a key that came twice could not be peeled
    for end in SENTENCE_ENDS:
        text = text.replace(end, end[:1] + b"\n")
    for part in text.split(b"\n"):
        if part:
            n = seen[part] = seen.get(part, 0) + 1
            digest = xxhash.xxh3_64_intdigest(part)
            digests.add(digest if n == 1 else xxhash.xxh3_64_intdigest(b"%d %d" % (n, digest)))
    return list(digests)


def hashed(key: int) -> tuple[int, int, int, int]:
    """Check of a key, and three numbers that say where it goes."""
    h = xxhash.xxh3_128_intdigest(key.to_bytes(8, "little"))
    return h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF, h >> 96


class Fingerprint:
    """The paragraphs of a text as tables of any size: per cell a count, the XOR of keys and the XOR of checks."""

    def __init__(self, text: bytes):
        self.keys = [(key, *hashed(key)) for key in paragraph_digests(text)]
        self.tables: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def table(self, cells: int) -> tuple[list[int], list[int], list[int]]:
        if cells not in self.tables:
            third = cells // 3
            count, keys, checks = [0] * cells, [0] * cells, [0] * cells
            for key, check, x, y, z in self.keys:
                for at in (x % third, third + y % third, 2 * third + z % third):
                    count[at] += 1
                    keys[at] ^= key
                    checks[at] ^= check
            self.tables[cells] = count, keys, checks
        return self.tables[cells]

    def __str__(self) -> str:
        """The number of paragraphs, then the cells of the smallest table."""
        count, keys, checks = self.table(CELLS)
        return f"{len(self.keys)}:{base64.b64encode(struct.pack(f'<{CELLS}i{CELLS}Q{CELLS}I', *count, *keys, *checks)).decode()}"


def peeled(count: list[int], keys: list[int], checks: list[int]) -> tuple[list[int], list[int]] | None:
    """Keys with a positive and with a negative count in a difference of tables; None if some cells cannot be resolved."""
    left, right, third = [], [], len(count) // 3
    todo = list(range(len(count)))
    while todo:
        n, key = count[at := todo.pop()], keys[at]
        if n in (1, -1):
            check, x, y, z = hashed(key)
            if check == checks[at]:
                (left if n > 0 else right).append(key)
                for at in (x % third, third + y % third, 2 * third + z % third):
                    count[at] -= n
                    keys[at] ^= key
                    checks[at] ^= check
                    todo.append(at)
                if len(left) + len(right) > 2 * len(count):  # a false key goes round in circles
                    return None
    return None if any(count) or any(keys) or any(checks) else (left, right)


def difference(a: Fingerprint, b: Fingerprint, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """Digests only in ``a`` and only in ``b``, by subtracting and peeling tables that grow until it succeeds."""
    while True:
        (n, k, c), (m, l, d) = a.table(cells), b.table(cells)
        found = peeled([x - y for x, y in zip(n, m)], [x ^ y for x, y in zip(k, l)], [x ^ y for x, y in zip(c, d)])
        if found is not None:
            return found
        cells *= GROWTH


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Common paragraphs over all paragraphs; 1 for two texts without any."""
    common = len(a.keys) - len(difference(a, b)[0])
    total = len(a.keys) + len(b.keys) - common
    return common / total if total else 1.0


def in_id_order(docs: DataFrame, id_column: str, text_column: str, rows_per_bucket: int) -> DataFrame:
    """Rows (``bucket``, ``tail``, ``id``, ``text``) sorted within ranges of ids, each range in one task.

    The first row of a range also goes to the range before it, as its ``tail``, so texts move once.
    """
    spark, n = docs.sparkSession, docs.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // rows_per_bucket)))
    splits = sorted(set(docs.approxQuantile(id_column, [i / buckets for i in range(1, buckets)], 0.3 / buckets))) if buckets > 1 else []
    bounds = np.array(splits, np.float64)

    @F.udf("int", useArrow=True)
    def bucket(key):
        return 0 if key is None else int(np.searchsorted(bounds, key, side="right"))

    placed = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), bucket(F.col(id_column).cast("double")).alias("bucket"))
    # no more rows than buckets
    heads = placed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("h")).select("bucket", "h.id").orderBy("bucket").collect()
    before = {h["bucket"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}
    firsts = spark.createDataFrame([(h["bucket"], h["id"], before[h["bucket"]]) for h in heads], f"bucket int, first {docs.schema[id_column].dataType.simpleString()}, before int")
    marked = placed.join(F.broadcast(firsts), "bucket")
    both = F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")))
    own = F.slice(both, 1, F.when(F.col("id").eqNullSafe(F.col("first")), 2).otherwise(1))
    dealt = marked.select("id", "text", F.explode(own).alias("b")).select("b.bucket", "b.tail", "id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "id", "text")


def with_following(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (id, text, following text) from the batches of ``in_id_order``."""
    held = None  # the row before, still without what follows
    for batch in batches:
        rows = []
        for bucket, tail, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held[0] == bucket:
                rows.append((held[1], held[2], text))
            held = None if tail else (bucket, key, text)
        yield rows


def edited_text(text: str, following: str) -> str:
    """The last fourth of the code points (rounded down) replaced by as many of the following text's first ones."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fingerprints of every text and of an edited version of it, and how alike they and the next document are.

    The next document is the one that follows in the order of ids (numbers; null ids first, rows of one id in the order of
    their texts), after the last the first. Per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts are empty. Equal texts have equal
    fingerprints. A single document is its own next; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    out = T.StructType.fromDDL(
        f"`{id_column}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = None, None
        for rows in with_following(batches):
            made = []
            for key, text, following in rows:
                if before != text:  # else it is the document that followed the last
                    own = Fingerprint(text.encode())
                edit = edited_text(text, following).encode()
                new, after = Fingerprint(edit), Fingerprint(following.encode())
                made.append((key, len(text), hashlib.sha256(edit).hexdigest(), str(own), str(new), likeness(own, new), likeness(own, after)))
                before, own = following, after
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return in_id_order(docs, id_column, text_column, rows_per_bucket).mapInArrow(run, out)
