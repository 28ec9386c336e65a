"""Turning arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack(
    df: DataFrame, keys: Sequence[str | Column], items: Column, value: str, index: str | None = None
) -> DataFrame:
    """One row per non-null element of an array expression.

    The outer form with a check on its output keeps Spark from deriving a filter on the array
    itself, which would evaluate an expensive expression (tokens, sentences) two more times.
    """
    rows = F.posexplode_outer(items).alias(index, value) if index else F.explode_outer(items).alias(value)
    return df.select(*keys, rows).where(F.col(value).isNotNull())


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, however often later steps refer to them.

    A later filter on an ordinary computed column is pushed below it and evaluates the
    expression a second time. A generated column stops that.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(row)))
