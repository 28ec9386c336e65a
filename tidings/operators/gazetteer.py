"""Typed entities of a text by a list of names: every name is looked up at every place, the longest wins.

A name is its words. Names meet places through a hash of their first words (two, or the only one), so a list of any
length is joined like any other table and no task holds all of it. What meets is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import tokens
from tidings.plans.shape import hold, unpack
from tidings.plans.skew import HOT_ROWS, salted_join
from tidings.plans.storage import materialize

PREFIX = 2  # words of a name that places are looked up by


def _prefix(words: Column, n: Column | int) -> Column:
    """Hash of the first words, and how many they are."""
    return F.xxhash64(F.array_join(F.slice(words, 1, n), " "), F.lit(n) if isinstance(n, int) else n)


def name_table(names: DataFrame, name: str, kind: str) -> DataFrame:
    """(words, n, type, key) of a gazetteer; names are compared by their words in lower case, names without words drop out."""
    rows = hold(names.select(F.col(name).alias("_name"), F.col(kind).alias("type")), words=tokens(F.col("_name")))
    rows = rows.where(F.size("words") > 0).select("words", "type").distinct().withColumn("n", F.size("words"))
    return rows.withColumn("key", _prefix(F.col("words"), F.least(F.col("n"), F.lit(PREFIX))))


def name_places(docs: DataFrame, doc: str, body: str, longest: int) -> DataFrame:
    """(doc, at, window, key): the words from each place of a text on, ``longest`` at most, by one word and by two."""
    held = hold(docs.select(F.col(doc).alias("doc"), body), _w=tokens(F.col(body)))
    starts = unpack(held.where(F.size("_w") > 0), ["doc", "_w"], F.sequence(F.lit(1), F.size("_w")), "at")
    places = starts.select("doc", F.col("at").cast("int").alias("at"), F.slice("_w", F.col("at"), longest).alias("window"))
    by = [_prefix(F.col("window"), n + 1) for n in range(PREFIX)]
    return places.withColumn("key", F.explode(F.array(by[0], *[F.when(F.size("window") > n, by[n]) for n in range(1, PREFIX)]))).where(F.col("key").isNotNull())


def typed_entities(
    docs: DataFrame, doc: str, body: str, names: DataFrame, name: str = "name", kind: str = "type", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc, at, n, entity, type) of the names found in each text, ``at`` in words from 0.

    A match inside a longer one goes; matches that only overlap stay. A name with several types gives one row for each. Texts are
    cut into words as names are, so line ends and signs between words do not matter. Null texts have no entities.
    """
    table = materialize(name_table(names, name, kind), "names")
    longest = table.agg(F.max("n")).first()[0] or 1
    keys = table.select("key").distinct()
    # most places begin no name: they go before anything is counted, shuffled or met
    places = materialize(name_places(docs, doc, body, longest).join(keys, "key", "left_semi"), "places")
    met = salted_join(places, table, ["key"], hot_rows=hot_rows).where(F.slice("window", 1, F.col("n")) == F.col("words"))
    spans = met.groupBy("doc", "at", "n").agg(F.first("words").alias("words"), F.collect_set("type").alias("types"))
    # the matches of one text; of those that start together only the longest is not inside another
    line = Window.partitionBy("doc").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("at") + F.col("n")).over(line)
    kept = spans.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("at") + F.col("n") > F.col("_reach")))
    return kept.select("doc", (F.col("at") - 1).alias("at"), "n", F.array_join("words", " ").alias("entity"), F.explode("types").alias("type"))
