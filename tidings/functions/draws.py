"""Random numbers that a seed and a row's own values decide, the same in every run and on any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS = 16**13  # numbers that can be drawn


def draw(seed: int, *columns: str | Column) -> Column:
    """A whole number below 2^52 out of the seed and the columns as text; null counts as empty text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long")
