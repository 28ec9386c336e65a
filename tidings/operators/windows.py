"""Row choice, ranks, positions, sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.draws import draw
from tidings.functions import arrays
from tidings.plans.shape import unpack
from tidings.plans.skew import HOT_ROWS, row_numbers, running_sum, top_rows
from tidings.plans.storage import materialize


# ---- one or a few rows per key ---------------------------------------------------------------
def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, by a total order."""
    return top_rows(df, keys, order, 1, "_rn").drop("_rn")


def keep_first_duplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Drop duplicates by key, keeping the row that comes first."""
    return first_per_key(df, keys, order)


def argmax_per_group(df: DataFrame, keys: Sequence[str], score: str, position: Sequence[str]) -> DataFrame:
    """Row with the highest score per group, the first position on a tie."""
    return first_per_key(df, keys, [F.desc(score), *position])


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str = "rank"):
    return top_rows(df, keys, order, k, name)


# ---- versions -----------------------------------------------------------------------------------
def version_numbers(
    df: DataFrame, release: str, time: str, story: str, name: str = "version_number", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number the stories of a release by arrival, then id."""
    return row_numbers(df, [time, story], keys=[release], name=name, hot_rows=hot_rows)


def first_versions(df: DataFrame, release: str, time: str, story: str) -> DataFrame:
    return first_per_key(df, [release], [time, story])


def last_versions(df: DataFrame, release: str, time: str, story: str) -> DataFrame:
    """Last version of each release that has more than one."""
    last = first_per_key(df, [release], [F.desc(time), F.desc(story)])
    several = df.groupBy(release).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(release)
    return last.join(several, release, "left_semi")


# ---- positions --------------------------------------------------------------------------------------
def with_position(df: DataFrame, items: str, index: str, value: str, keep_empty: bool = False) -> DataFrame:
    """One row per list element with its position from 0."""
    keys = [c for c in df.columns if c != items]
    if keep_empty:
        return df.select(*keys, F.posexplode_outer(items).alias(index, value))
    return unpack(df, keys, F.col(items), value, index)


def zip_explode(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Parallel list columns of one row as rows."""
    return df.select(*keys, F.inline(F.arrays_zip(*columns)))


def within_token_budget(
    df: DataFrame,
    doc: str,
    order: str,
    n_tokens: Column,
    budget: int = 8192,
    max_sentences: int = 110,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sentences of a document before its running token count passes the budget, and at most 110."""
    summed = running_sum(df, [doc], [order], n_tokens.cast("long"), "_tokens", hot_rows)
    kept = summed.where(F.col("_tokens") <= budget)
    # counts cannot be negative, so what is kept is a run from the start of the document
    return top_rows(kept, [doc], [order], max_sentences, "_rn").drop("_rn", "_tokens")


def round_robin(df: DataFrame, order: Sequence[str], workers: int, name: str = "worker") -> DataFrame:
    """Deal the rows out to workers in turn."""
    return row_numbers(df, order, name="_rn").withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(workers)).cast("int")).drop("_rn")


def random_worker(df: DataFrame, key: str, workers: int, seed: int = 0, name: str = "worker") -> DataFrame:
    return df.withColumn(name, (draw(seed, key) % workers).cast("int"))


def chunk_offsets(chunks: DataFrame, doc: str, order: str, length: Column, name: str = "char_start") -> DataFrame:
    """Running character position of text chunks that lie one after another."""
    summed = running_sum(chunks.withColumn("_len", length.cast("long")), [doc], [order], F.col("_len"), "_end")
    return summed.withColumn(name, F.col("_end") - F.col("_len")).drop("_len", "_end")


# ---- sorts and limits ------------------------------------------------------------------------------------
def multi_sort(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.orderBy(*order)


def stand_numbers(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted frame from 1, in the order in which they stand.

    The rows are stored once with their number inside their partition; what the partitions before hold is one row per partition.
    """
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return numbered.select(*ordered.columns, (F.col("_before") + inside + 1).alias(name))


def top_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sort_list_by_label(df: DataFrame, items: str, label_field: str, priority: Mapping[str, int]) -> DataFrame:
    return df.withColumn(items, arrays.sort_by_priority(F.col(items), label_field, dict(priority)))


def sort_by_length(df: DataFrame, items: str, key: str, longest_first: bool = True) -> DataFrame:
    size = F.size(items)
    return df.orderBy(size.desc() if longest_first else size.asc(), key)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows; without an order any n rows will do."""
    return (df.orderBy(*order) if order else df).limit(n)


def limit_per_split(df: DataFrame, split: str, order: str, limits: Mapping[str, int]) -> DataFrame:
    """First n rows of each named split."""
    parts = [df.where(F.col(split) == s).orderBy(order).limit(n) for s, n in limits.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- set operations ----------------------------------------------------------------------------------------
def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(df: DataFrame, a: str, b: str, name: str = "url") -> DataFrame:
    """Distinct values of two columns."""
    return df.select(F.explode(F.array(a, b)).alias(name)).where(F.col(name).isNotNull()).distinct()


def difference_size(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Number of distinct values of A that B lacks."""
    return a.select(column).distinct().join(b.select(column), column, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def intersection(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def labelled_union(frames: Mapping[str, DataFrame], name: str = "split") -> DataFrame:
    return union_all(*[df.withColumn(name, F.lit(label)) for label, df in frames.items()])


def unpivot_distinct(df: DataFrame, columns: Sequence[str], name: str = "url") -> DataFrame:
    return df.select(F.explode(F.array(*columns)).alias(name)).where(F.col(name).isNotNull()).distinct()
