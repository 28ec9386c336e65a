"""Shards by jump consistent hashing, in column expressions only.

The jump sequence of a key depends on the key alone; the shard is the last jump below the number of
shards. One more shard can therefore only take rows into itself, and there is no ring table. A
row's place in its shard comes from counts per bucket of key hashes plus a rank inside the bucket,
so no task orders a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import prepare
from tidings.plans.skew import row_numbers

# fixed values of the generator that jump consistent hashing is defined with
MULTIPLIER = 2862933555777941757
MODULUS = 2**64
BUCKET_ROWS = 50_000  # rows that one bucket of a shard has on average


def key_hash(column: str) -> Column:
    """Sixteen hexadecimal digits that depend on the key alone; null keys share one value."""
    return F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 16)


def jumps(key: Column, shards: int) -> Column:
    """Struct of ``shard`` (of ``shards``) and ``grown`` (of one more) for a key of 16 hexadecimal digits."""
    wide = "decimal(38,0)"
    start = F.struct(
        F.conv(key, 16, 10).cast("decimal(20,0)").cast(wide).alias("key"), F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"),
    )

    def step(at: Column, _: Column) -> Column:
        key = ((at["key"].cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast(wide)
        unit = F.lit(2**33).cast("decimal(10,0)")
        high = ((key - key % unit) / unit).cast("double")
        jumped = F.struct(
            key.alias("key"), F.when(at["next"] < shards, at["next"]).otherwise(at["shard"]).alias("shard"), at["next"].alias("grown"),
            F.floor((at["next"] + 1) * (F.lit(float(2**31)) / (high + 1))).cast("long").alias("next"),
        )
        return F.when(at["next"] <= shards, jumped).otherwise(at)

    # every jump goes forward, so shards + 1 steps pass them all
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown")))


def assign_shards(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``key``: the id and the number of shards decide. ``slot`` counts from 0 without gaps in each
    shard, in the order of key hashes, ids, and texts (by checksum and size). ``grown_shard`` is the shard
    with one more. Rows of one id share a shard; null ids count as an empty key, null texts as no
    bytes (size 1, checksum 0). Repeated rows get slots of their own. Columns of ``docs`` with the
    names of results are replaced.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    old = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    buckets = max(1, -(-docs.count() // (shards * bucket_rows)))
    first = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    placed = (
        old.withColumn("size", F.octet_length(text).cast("long") + 1)
        .withColumn("text_crc32", F.crc32(text.cast("binary")))
        .withColumn("_h", key_hash(id_column))
        .withColumn("_jumps", jumps(F.col("_h"), shards))
        .withColumn("_bucket", F.shiftright(first * buckets, 32))
        .withColumn("shard", F.col("_jumps.shard"))
        .withColumn("grown_shard", F.col("_jumps.grown"))
        .drop("_jumps")
    )
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = row_numbers(placed, ["_h", id_column, "text_crc32", "size"], ["shard", "_bucket"], "_rank")
    return ranked.join(offsets, ["shard", "_bucket"]).select(
        *[F.col(f"`{c}`") for c in old.columns], "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard",
    )
