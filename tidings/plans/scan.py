"""Running values along sorted rows: one sort, a fold inside each piece of it, and what crosses the edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.plans.skew import _as_column
from tidings.plans.storage import materialize


def segmented_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, for every row, values of its key's rows up to and including it.

    ``last`` names columns with the newest non-null value of an expression, ``total`` columns with its running sum (null
    counts as zero). Rows are sorted by key and order into pieces of even size, so a key that holds most of
    the table is many pieces. Each piece folds its own rows. Since pieces are sorted, only a piece's first key can go on from
    the piece before: what has gathered at the end of each piece is one row per piece, and that small table
    brings the state across the edges. Rows that are equal in keys and order stand in any order; equal rows may be in two pieces.
    """
    keys, last, total = list(keys), dict(last or {}), dict(total or {})
    values = {f"_v_{name}": expr for name, expr in {**last, **total}.items()}
    spread = df.withColumns(values).withColumn("_spread", F.monotonically_increasing_id())
    ordered = spread.orderBy(*keys, *[_as_column(o) for o in order], "_spread").drop("_spread")
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.shiftright("_at", 33)), "scan")

    # at most as many rows as the sort has partitions, from here to the broadcast
    key = F.struct(*keys)
    ends = placed.groupBy("_piece").agg(F.min(key).alias("_first"), F.max(key).alias("_final"))
    in_final = key == F.col("_final")
    newest = lambda name: F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col("_at")))
    tails = placed.join(F.broadcast(ends), "_piece").where(in_final).groupBy("_piece", "_first", "_final").agg(
        *[newest(name).alias(name) for name in last], *[F.coalesce(F.sum(f"_v_{name}"), F.lit(0)).alias(name) for name in total]
    )
    so_far = Window.partitionBy("_final").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    gathered = tails.select(
        "_piece", "_first", "_final", *[F.last(name, ignorenulls=True).over(so_far).alias(name) for name in last],
        *[F.sum(name).over(so_far).alias(name) for name in total],
    )
    pieces = Window.orderBy("_piece")
    goes_on = F.lag("_final").over(pieces) == F.col("_first")
    edges = gathered.select(
        "_piece", F.col("_first").alias("_edge"), *[F.when(goes_on, F.lag(name).over(pieces)).alias(f"_c_{name}") for name in (*last, *total)]
    )

    own = Window.partitionBy("_piece", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    folded = placed.select(
        "*", *[F.last(f"_v_{name}", ignorenulls=True).over(own).alias(f"_o_{name}") for name in last],
        *[F.coalesce(F.sum(f"_v_{name}").over(own), F.lit(0)).alias(f"_o_{name}") for name in total],
    )
    same = (F.col("l._piece") == F.col("e._piece")) & (F.struct(*[F.col(f"l.{k}") for k in keys]) == F.col("e._edge"))
    both = folded.alias("l").join(F.broadcast(edges.alias("e")), same, "left")
    return both.select(
        *[F.col(f"l.`{c}`") for c in df.columns], *[F.coalesce(f"_o_{name}", f"_c_{name}").alias(name) for name in last],
        *[(F.col(f"_o_{name}") + F.coalesce(f"_c_{name}", F.lit(0))).alias(name) for name in total],
    )

