"""What the operators share: words and hashes of raw bytes, batch plumbing, keys for rows, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings.plans.storage import materialize, new_path
from tidings.session import tune

PLAN_CHARS = 50_000  # of a plan's text that the driver keeps
FEW_LABELS = 50_000  # labels of nodes that are sent to every task; more are joined by a shuffle
BATCH_ROWS = 1_000  # rows that travel to Python at once; long texts are what memory has to hold

# A-Z in lower case, every other byte as it is
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # the driver keeps the plan of each of the last thousand jobs as text
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    return spark


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(
    df: DataFrame, columns: Sequence[str | Column], fn: Callable[..., list], schema: T.StructType | str
) -> DataFrame:
    """Run ``fn`` over Arrow batches of ``columns``; it returns one array (or list) per field of ``schema``."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(*batch.columns)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def lists_of(values: np.ndarray, lengths: Sequence[int]) -> pa.Array:
    """A list column from all values in a row and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (any fixed bijection with good diffusion will do)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> list[np.uint64]:
    """Multipliers for hashing."""
    return [np.uint64(int(x) | 1) for x in np.random.default_rng(seed).integers(1, 2**63, n)]


class WordHashes(dict):
    """64-bit hash of each word met so far; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def row_key(id_column: str, text_column: str) -> list[Column]:
    """Two columns that tell rows apart, for joins back to them; equal rows share a key.

    Neither is ever null, and both depend on the row alone, so a recomputed task agrees.
    """
    return [
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("_k1"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit("")), F.lit(7)).alias("_k2"),
    ]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in names])


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links`` (``a``, ``b``): columns ``node``, ``label``.

    Each round takes the smallest label among the neighbours, then follows labels once more
    (pointer jumping), so the number of rounds follows the logarithm of the longest path. Labels
    are stored each round in the shared folder. Up to ``FEW_LABELS`` nodes, a round shuffles once: each join by a
    shuffle costs the driver the bookkeeping of its tasks, however few the rows.
    """
    # one pass over the links, whose plan may hold much work; every node is its own neighbour
    sides = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"])).alias("side")
    both = materialize(links.where("a <> b").select(sides).select("side.*").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"), "labels")
    to_all = F.broadcast if labels.count() <= FEW_LABELS else (lambda table: table)
    while True:
        near = both.join(to_all(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node"))
        lowered = near.agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(
            lowered.join(to_all(jump), "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")),
            "labels",
        )
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


__all__ = [
    "BATCH_ROWS", "LOWER", "WordHashes", "as_bytes", "components", "lists_of", "map_batches", "materialize",
    "mixed", "new_path", "odd_numbers", "prepare", "row_key", "without",
]
