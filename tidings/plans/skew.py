"""Joins and running totals that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.plans.storage import materialize

HOT_ROWS = 2_000_000  # a key with more rows than this is spread over several tasks
NULL_SHARES = 10_000  # shares of the rows without a key where keys are spread


def _as_column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, with the number of shares to cut them into.

    At most ``rows / hot_rows`` keys qualify, so the result is safe to broadcast: a trillion
    rows leave at most half a million small rows.
    """
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_shares"))
    )


def _row_hash(df: DataFrame) -> Column:
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashable])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which the left rows of each hot key are cut into shares.

    Hot keys are counted first, in a job of its own over the key columns of the left side, unless
    the caller knows them already (``hot``: ``_shares`` and some or all of the keys). Mostly there
    is none and the join is an ordinary one. A left row takes its share from a hash of the whole row, so a
    recomputed task assigns the same share; the right rows of a hot key are repeated once per
    share. ``right`` and ``full`` joins would repeat unmatched right rows and are refused.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot run a {how!r} join")
    on = list(on)
    shares = hot if hot is not None else hot_keys(left, on, hot_rows)
    if shares.isEmpty():
        return left.join(right, on, how)
    shares = materialize(shares, "hot-keys")
    known = [c for c in shares.columns if c != "_shares"]
    shares = F.broadcast(shares)
    n = F.coalesce(F.col("_shares"), F.lit(1))
    # a null key meets nothing, so its rows may stand anywhere
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salted_left = (
        left.withColumn("_h", _row_hash(left))
        .join(shares, known, "left")
        .withColumn("_salt", F.pmod(F.col("_h"), F.when(no_key, NULL_SHARES).otherwise(n)).cast("int"))
        .drop("_h", "_shares")
    )
    salted_right = (
        right.join(shares, known, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
        .drop("_shares")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def _split_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum by sorting everything once and adding up whole sorted chunks.

    The sort is by key *and* order, so a hot key is cut across as many tasks as its share of
    the data calls for. The chunk number is stored with the rows: both branches below must
    agree on it.
    """
    placed = materialize(
        df.withColumn("_v", value)
        .orderBy(*[F.col(k) for k in keys], *order)
        .withColumn("_chunk", F.spark_partition_id()),
        "running",
    )
    own = Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_sums = placed.groupBy("_chunk", *keys).agg(F.sum("_v").alias("_chunk_sum"))
    offsets = chunk_sums.withColumn(
        "_before", F.coalesce(F.sum("_chunk_sum").over(before), F.lit(0))
    ).drop("_chunk_sum")
    match = F.col("p._chunk") == F.col("o._chunk")
    for k in keys:
        match = match & F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}"))
    local = placed.withColumn("_own", F.sum("_v").over(own)).alias("p")
    return local.join(offsets.alias("o"), match, "inner").select(
        *[F.col(f"p.{c}") for c in df.columns], (F.col("p._own") + F.col("o._before")).alias(name)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to this row.

    ``order`` must be total within a key. Keys of ordinary size use one window; hot keys, and
    a running sum over the whole table (no keys), go through a sort that splits them.
    """
    keys, order = list(keys), [_as_column(o) for o in order]
    if not keys:
        return _split_running_sum(df, keys, order, value, name)
    hot = hot_keys(df, keys, hot_rows).drop("_shares")
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if hot.isEmpty():
        return df.withColumn(name, F.sum(value).over(frame))
    hot = materialize(hot, "hot-keys")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cold_rows = df.alias("l").join(F.broadcast(hot.alias("r")), same, "left_anti")
    hot_rows_df = df.alias("l").join(F.broadcast(hot.alias("r")), same, "left_semi")
    cold_part = cold_rows.withColumn(name, F.sum(value).over(frame))
    return cold_part.unionByName(_split_running_sum(hot_rows_df, keys, order, value, name))


def row_numbers(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    name: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based position of every row within its key (or within the table)."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, hot_rows)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each key.

    The bound on ``row_number`` lets Spark keep only ``k`` rows per key and map task before the
    shuffle, so a hot key never travels whole.
    """
    window = Window.partitionBy(*keys).orderBy(*[_as_column(o) for o in order])
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


LIST_BYTES = 1 << 30  # what the values of one list may add up to; Spark cannot hold twice that in one row


def whole_list(item: Column, size: Column, list_bytes: int = LIST_BYTES) -> Column:
    """Aggregate: all of a key's items, sorted.

    For keys whose lists are bounded by what they stand for, a document say. A list of more than
    ``list_bytes`` (``size``: bytes of an item) is an error, never a part of the list.
    """
    total = F.sum(size)
    message = F.concat(F.lit("a list of "), total.cast("string"), F.lit(f" bytes; at most {list_bytes} fit: keep these rows in long form"))
    return F.when(total > list_bytes, F.raise_error(message)).otherwise(F.sort_array(F.collect_list(item)))


def bytes_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """Bytes that the values of a row take, roughly."""
    sizes = []
    for c in columns:
        kind = df.schema[c].dataType
        plain = F.octet_length(c) if isinstance(kind, (T.StringType, T.BinaryType)) else F.length(F.to_json(F.struct(c))) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.lit(8)
        sizes.append(F.coalesce(plain, F.lit(0)))
    return sum(sizes, F.lit(16)).cast("long")
