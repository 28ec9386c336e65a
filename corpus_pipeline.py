"""Raw documents to training shards, as stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import materialize, new_path, row_key
from tidings.llm.decontaminate import benchmark_hits
from tidings.llm.language import identified
from tidings.llm.mixing import mix
from tidings.llm.near_dedup import survivors
from tidings.llm.sharding import assign_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the model knows go."""
    return identified(docs).where("accepted").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, null after all others.

    Of several texts under that id the one with the smallest hash stays. Rows that repeat an id with the same text
    are one group as well and leave one row.
    """
    rows = materialize(survivors(docs), "kept")
    key = row_key("doc_id", "text")[1]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k2") == F.col("_hash"))
    stay = docs.withColumn("_k2", key).join(rows.drop("count"), same, "left_semi").drop("_k2")
    # only a table that repeats rows is dealt anew
    return stay if rows.where("count > 1").isEmpty() else stay.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with target shares of sources, languages and topics."""
    return mix(docs).where("kept").select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its training shard and its place in it."""
    return assign_shards(docs, 16)


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding),
]
ORACLE_SQL = None  # no SQL for a trained model; tests/llm compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{at}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
