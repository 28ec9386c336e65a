"""Dates, capture stamps and intervals."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyyMMddHHmmss", "yyyyMMdd", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd",
]


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    """Timestamp of a free-form date, from the first format that fits; null when none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats or FORMATS])


def canonical_timestamp(published: Column, captured: Column) -> Column:
    """Publish date unless it is missing or ``None``, otherwise the capture time."""
    chosen = F.coalesce(F.nullif(published, F.lit("None")), captured)
    return parse_date(F.nullif(chosen, F.lit("Not Found")))


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_interval(text: str) -> timedelta:
    """``12h`` or ``6 weeks`` as a duration, before the job starts."""
    pieces = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text.strip().lower())
    rest = re.sub(r"(\d+(?:\.\d+)?)\s*([a-z]+)|[\s,]", "", text.strip().lower())
    if not pieces or rest or any(unit[0] not in _UNITS for _, unit in pieces):
        raise ValueError(f"{text!r} is not a duration")
    return timedelta(seconds=sum(float(n) * _UNITS[unit[0]] for n, unit in pieces))


def interval(text: str) -> Column:
    """``parse_interval`` as a column."""
    return F.lit(parse_interval(text))


def parse_compact_date(number: Column) -> Column:
    """``yyyymmdd`` integer as a timestamp; null if it is none."""
    return F.try_to_timestamp(number.cast("long").cast("string"), F.lit("yyyyMMdd"))


def capture_stamp(ts: Column) -> Column:
    """Timestamp as the integer ``yyyymmddhhmmss``; the current time when null."""
    return F.date_format(F.coalesce(ts, F.current_timestamp()), "yyyyMMddHHmmss").cast("long")


def stamp_to_timestamp(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp.cast("string"), F.lit("yyyyMMddHHmmss"))
