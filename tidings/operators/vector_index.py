"""Nearest vectors through an index of cells: only the cells near a query are scored.

Cells are the Voronoi cells of k-means centres under cosine. The centres are fitted on a sample of bounded size; every
vector of the table is put into its cell. A search ranks the centres for each query, sends the query to the first
``probes`` cells and scores what they hold exactly. How many cells a recall takes is measured, not guessed:
``probes_for`` looks up where the true neighbours of a few queries are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.functions.draws import DRAWS, draw
from tidings.operators.retrieval import QUERIES_PER_BLOCK, VECTORS_PER_BLOCK, best_of_block, dense_top_k, unit_rows
from tidings.plans.skew import top_rows
from tidings.plans.storage import materialize

MAX_CELLS = 4_096  # the table of centres travels to every task: this many rows at most
SAMPLE_PER_CELL = 64  # vectors that the centres are fitted on, per cell
ROUNDS = 8  # of k-means
PRUNED_READS = 200  # up to so many probed cells are named in the scan, so Parquet skips the others


@dataclass
class VectorIndex:
    """``cells``: every vector (``doc``, ``vector``) with its ``cell`` and the ``block`` of it, stored in order of cells; ``centres``: a row per cell."""

    cells: DataFrame
    centres: np.ndarray

    def sizes(self) -> DataFrame:
        """Vectors per cell."""
        return self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"))


def _sample(vectors: DataFrame, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows that come first by a seeded hash, with that hash as ``draw``; a threshold leaves few more than that to sort."""
    share = 1.2 * rows / max(1, vectors.count()) + 1e-9
    drawn = vectors.withColumn("draw", draw(seed, "doc"))
    kept = drawn if share >= 0.5 else drawn.where(F.col("draw") < int(share * DRAWS))
    return materialize(kept.orderBy("draw", "doc").limit(rows), "sample")


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T, axis=1)


def _mapped(df: DataFrame, centres: np.ndarray, fn, schema: str) -> DataFrame:
    """``fn`` over batches, with the centres broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch, sent.value)

    return df.mapInPandas(run, schema)


def fit_centres(vectors: DataFrame, n_cells: int, sample_rows: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres of ``vectors`` (``doc``, ``vector``), fitted on the ``sample_rows`` rows that come first by a seeded hash.

    Each round sums up the sample cell by cell in Spark; only the centres come back. A cell that loses all its vectors
    keeps its centre.
    """
    sample = _sample(vectors, sample_rows, seed)
    first = sample.orderBy("draw", "doc").limit(n_cells).select("vector").toPandas()
    centres = unit_rows(first["vector"])

    def sums(batch: pd.DataFrame, centres: np.ndarray) -> pd.DataFrame:
        rows = unit_rows(batch["vector"], centres.shape[1])
        cell = _nearest(rows, centres)
        present = np.unique(cell)
        total = [rows[cell == c].sum(axis=0) for c in present]
        return pd.DataFrame({"cell": present, "total": total})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": group["cell"].iloc[:1], "total": [np.sum(np.stack(group["total"].to_list()), axis=0)]})

    schema = "cell long, total array<double>"
    for _ in range(rounds if len(first) else 0):
        found = _mapped(sample.select("vector"), centres, sums, schema).groupBy("cell").applyInPandas(add, schema).toPandas()
        new = centres.copy()
        new[found["cell"].to_numpy(np.int64)] = unit_rows(found["total"])
        if np.allclose(new, centres, atol=1e-4):
            break
        centres = new
    return centres


def build_vector_index(
    vectors: DataFrame, vector_id: str, vector: str, n_cells: int | None = None, sample_per_cell: int = SAMPLE_PER_CELL,
    vectors_per_block: int = VECTORS_PER_BLOCK, seed: int = 0,
) -> VectorIndex:
    """Index over every row of ``vectors``.

    By default there are as many cells as the square root of the rows, ``MAX_CELLS`` at most; the centres are fitted on
    ``sample_per_cell`` vectors per cell. Large cells are cut into blocks of about ``vectors_per_block``. A null or zero vector is in
    some cell and scores zero.
    """
    rows = vectors.select(F.col(vector_id).alias("doc"), F.col(vector).alias("vector"))
    n_cells = n_cells or max(1, min(MAX_CELLS, round(rows.count() ** 0.5)))
    centres = fit_centres(rows, n_cells, n_cells * sample_per_cell, seed=seed)
    if not len(centres):
        empty = rows.select("doc", "vector", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("block")).limit(0)
        return VectorIndex(materialize(empty, "cells"), centres)

    def place(batch: pd.DataFrame, centres: np.ndarray) -> pd.DataFrame:
        return batch.assign(cell=_nearest(unit_rows(batch["vector"], centres.shape[1]), centres))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialize(_mapped(rows, centres, place, f"{kinds}, cell long"), "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / vectors_per_block).alias("_blocks"))  # MAX_CELLS rows at most
    cut = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("_blocks")).cast("int")).drop("_blocks")
    ordered = cut.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")
    return VectorIndex(materialize(ordered.select("doc", "vector", "cell", "block"), "cells"), centres)


def _probes(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """``queries`` (``query``, ``vector``) with the ``probes`` cells nearest to each."""

    def rank(batch: pd.DataFrame, centres: np.ndarray) -> pd.DataFrame:
        near = np.argsort(-(unit_rows(batch["vector"], centres.shape[1]) @ centres.T), axis=1, kind="stable")[:, :probes]
        return batch.assign(cell=list(near.astype(np.int64))).explode("cell").astype({"cell": np.int64})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return _mapped(queries, index.centres, rank, f"{kinds}, cell long")


def search_vectors(
    index: VectorIndex, queries: DataFrame, query_id: str, vector: str, k: int = 20, probes: int = 8, digits: int = 6,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """The ``k`` nearest vectors of each query among those in its ``probes`` nearest cells: ``query``, ``doc``, ``score``, ``rank``.

    With as many probes as cells the result is that of ``dense_top_k``. The queries of a cell meet each block of it in groups of
    about ``queries_per_block``, so neither a large cell nor one that many queries probe is one task.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("vector"))
    out = T.StructType([
        T.StructField("query", asked.schema["query"].dataType), T.StructField("doc", index.cells.schema["doc"].dataType), T.StructField("score", T.DoubleType()),
    ])
    if not len(index.centres):
        return asked.sparkSession.createDataFrame([], out.add("rank", T.IntegerType()))
    probed = materialize(_probes(index, asked, probes), "probes")
    # one row per cell, so MAX_CELLS at most
    groups = F.broadcast(probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / queries_per_block).cast("int").alias("_groups")))
    blocks = F.broadcast(index.cells.groupBy("cell").agg((F.max("block") + 1).alias("_blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probed.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64("query"), "_groups").cast("int"))
    left = left.join(blocks, "cell").withColumn("block", every("_blocks"))
    named = [r["cell"] for r in probed.select("cell").distinct().limit(PRUNED_READS + 1).collect()]
    cells = index.cells if len(named) > PRUNED_READS else index.cells.where(F.col("cell").isin(named))
    right = cells.join(groups, "cell").withColumn("group", every("_groups"))

    width = index.centres.shape[1]

    def score(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(docs):
            return pd.DataFrame({"query": [], "doc": [], "score": []})
        rows = [unit_rows(df["vector"], width) for df in (queries, docs)]
        return best_of_block(queries["query"].to_numpy(), rows[0], docs["doc"].to_numpy(), rows[1], k, digits)

    keys = ["cell", "block", "group"]
    left, right = left.select("query", "vector", *keys), right.select("doc", "vector", *keys)
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, out)
    return top_rows(best, ["query"], [F.desc("score"), "doc"], k, "rank")


def scored_vectors(index: VectorIndex, queries: DataFrame, query_id: str, vector: str, probes: int) -> DataFrame:
    """How many vectors each query is scored against: ``query``, ``vectors``."""
    asked = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("vector"))
    return _probes(index, asked, probes).join(F.broadcast(index.sizes()), "cell").groupBy("query").agg(F.sum("vectors").alias("vectors"))


def probes_for(index: VectorIndex, k: int = 20, recall: float = 0.95, n_queries: int = 200, seed: int = 1) -> int:
    """The fewest probes with which ``n_queries`` vectors of the index, chosen by a seeded hash, find this share of their ``k`` nearest.

    Their true neighbours come from one exact pass over all vectors.
    """
    if not len(index.centres):
        return 1
    asked = _sample(index.cells.select("doc", "vector"), n_queries, seed)
    true = dense_top_k(asked, index.cells, "doc", "doc", "vector", k)
    homes = true.join(index.cells.select("doc", F.col("cell").alias("home")), "doc").select("query", "home")
    both = homes.join(asked.select(F.col("doc").alias("query"), "vector"), "query")

    def position(batch: pd.DataFrame, centres: np.ndarray) -> pd.DataFrame:
        order = np.argsort(-(unit_rows(batch["vector"], centres.shape[1]) @ centres.T), axis=1, kind="stable")
        return pd.DataFrame({"probes": np.argmax(order == batch["home"].to_numpy()[:, None], axis=1) + 1})

    places = _mapped(both, index.centres, position, "probes long").groupBy("probes").count().toPandas().sort_values("probes")  # a row per cell at most
    reached = places["count"].cumsum() >= recall * places["count"].sum()
    return int(places["probes"][reached].iloc[0])


def recall_of(found: DataFrame, true: DataFrame) -> float:
    """Share of the (query, doc) pairs of ``true`` that ``found`` has."""
    hits = true.select("query", "doc").join(found.select("query", "doc").distinct(), ["query", "doc"], "left_semi").count()
    return hits / max(1, true.count())
