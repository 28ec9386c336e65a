"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidings.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# words of a text, as the Spark side finds them
WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
# sentences of a text, as the Spark side cuts them
SENTENCES_SQL = (
    r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'),"
    r" chr(1)), lambda s: trim(s)), lambda s: s <> '')"
)


def words_sql(column: str) -> str:
    return WORDS_SQL.format(column)


def sentences_sql(column: str) -> str:
    return SENTENCES_SQL.format(column)


class Tables:
    """The Parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A text table for heavy work per row: handed out to all cores if it came as fewer splits.

        A table of many files has splits enough and stays as it is.
        """
        df = getattr(self, name)
        cores = self._spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the tables as a query named after it."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        run.__name__ = key
        if key in QUERIES:
            raise ValueError(f"query {key} exists")
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register
