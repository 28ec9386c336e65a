"""Landing files to tables, each new file once.

State lives in the stream's checkpoint, so a run may stop at any time and pick up where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidings.operators.joins import new_on_either_side


def stream_files(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "json", files_per_trigger: int = 1_000
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def new_articles(
    stream: DataFrame, key: str = "article_url", time: str | None = None, delay: str = "7 days"
) -> DataFrame:
    """Rows whose key was not seen before.

    With an event time the memory of keys is bounded by the delay; without one every key is
    remembered, which suits a bounded crawl.
    """
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def incremental_ingest(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append what is new to a table, then stop; run again for later files."""
    writer = stream.writeStream.outputMode("append").format(fmt).option("path", out)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_two_way(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    subset: Callable[[DataFrame], DataFrame],
    all_path: str,
    subset_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Per micro-batch: parse, write everything to one table and a subset to another.

    Each batch overwrites its own folder in both tables, so a batch that is run again after a
    failure leaves no doubles. The subset reads what was just written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id}"
        parsed = transform(batch)
        parsed.write.mode("overwrite").parquet(f"{all_path}/{part}")
        stored = batch.sparkSession.read.schema(parsed.schema).parquet(f"{all_path}/{part}")
        subset(stored).write.mode("overwrite").parquet(f"{subset_path}/{part}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_new_pairs(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], scored_path: str, checkpoint: str
) -> StreamingQuery:
    """Score only pairs of which a side was not scored in an earlier batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = "article_url string, press_release_url string, batch long"
        seen = _read_or_empty(spark, scored_path, keys).where(F.col("batch") < batch_id)
        fresh = new_on_either_side(batch.distinct(), seen)
        score(fresh).write.mode("overwrite").parquet(f"{scored_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
