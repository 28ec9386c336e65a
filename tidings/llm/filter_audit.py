"""What each of several filters removes, in every order in which they could run.

Every filter has a stored table of the ids that fail it. Survivors of a prefix of filters depend on the set of
its filters, not on their order, so there are ``2^n`` of them instead of ``n!``. They are built level by level:
the survivors of a set and one more filter are a left-anti join of the set's survivors with that filter's table.
What a filter removes after a prefix is a left-semi join of its table with the prefix's survivors. All sets of
one level go through one join, with the set as part of the key, so keys are as even as ids. Documents that fail
nothing survive every prefix; they are counted and take part in no join.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.plans.shape import hold
from tidings.plans.skew import salted_join
from tidings.llm.common import materialize, new_path, prepare

MAX_FILTERS = 6  # 720 orders; the table of orders is broadcast


def text_rules(text: str | Column = "text") -> dict[str, Column]:
    """Conditions under which a text fails: short (A), repetitive (B), shouting (C), markup (D)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """``row`` of the ``rows`` (``row``, ``id``, ``digest``) whose text a smaller id has as well.

    The first of each text are few columns and the join is by text and id, so a text that a third of all
    documents have is spread like any other.
    """
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    return rows.where("id IS NOT NULL").join(first, ["digest", "id"], "left_anti").select("row")


def failing_tables(docs: DataFrame, rules: Mapping[str, Column], copies: str | None, id_column: str, text_column: str, part_column: str):
    """All rows in short (``row``, ``id``, ``part``), and the stored id tables (``row`` by ``rule``), one folder per filter."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    flags = {f"_f{i}": F.coalesce(rule, F.lit(False)) for i, rule in enumerate(rules.values())}
    held = hold(docs, **flags).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text)).alias("digest"), *flags,
    )
    rows = materialize(held, "audit-rows")
    names = [*rules, copies] if copies else [*rules]
    fails = F.filter(F.array(*[F.when(F.col(f), F.lit(i)) for i, f in enumerate(flags)]), lambda x: x.isNotNull())
    failing = rows.select("row", F.explode(fails).alias("rule"))
    if copies:
        failing = failing.unionByName(later_copies(rows).withColumn("rule", F.lit(len(rules))))
    path = new_path(docs.sparkSession, "failing-ids")
    failing.write.partitionBy("rule").parquet(path)
    return rows.select("row", "id", "part"), docs.sparkSession.read.schema("row bigint, rule int").parquet(path), names


def survivors(failing: DataFrame, rows: DataFrame, n_filters: int) -> DataFrame:
    """``row``, its columns and ``set`` (bits of the filters run) of each row of ``rows`` that survives the set; stored level by level."""
    level = materialize(rows.withColumn("set", F.lit(0)), "survivors")
    made = level
    for _ in range(n_filters):
        # a set is reached once, from the set without its last filter
        after = F.expr(f"explode(filter(sequence(0, {n_filters - 1}), f -> shiftright(set, f) = 0))")
        level = level.withColumn("rule", after).join(failing, ["row", "rule"], "left_anti")
        level = materialize(level.withColumn("set", F.expr("set | shiftleft(1, rule)")).select(made.columns), "survivors")
        made = made.unionByName(level)
    return made


def orders(names: list[str]) -> list[tuple[str, int, int, int]]:
    """All orders as rows: names in order, step, filter, set that has run before."""
    return [
        ("".join(names[f] for f in order), step, f, sum(1 << x for x in order[: step - 1]))
        for order in permutations(range(len(names))) for step, f in enumerate(order, 1)
    ]


def audit_filters(
    docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column] | None = None, copies: str | None = "E",
    id_column: str = "doc_id", text_column: str = "text", part_column: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step.

    ``rules`` gives each filter's condition for failing; ``copies`` names a last filter that a text fails if a
    smaller id has the same text, anywhere in the table. The names are single letters. Columns: ``part``,
    ``filter_order``, ``step`` (from 1), and counts within the part: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (would have been removed, but was gone), ``unique_fails`` (fails this filter only), ``good_lost`` and
    ``toxic_lost`` (removed and labelled ``quality`` or ``toxic`` 1), ``shapley`` (removed by the filter over all orders).

    A null text is empty, a null part the empty string, a condition that is null does not fail. Each row counts
    by itself, repeated ones too; equal ids with the same text are not each other's copies, and a null id has no smaller one
    and no label. Several labels of one id count as the largest. An empty table has no parts and gives no rows.
    Other columns of ``docs`` and ``labels`` are not looked at.
    """
    prepare(docs.sparkSession)
    rules = text_rules(text_column) if rules is None else rules
    n = len(rules) + bool(copies)
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"from 1 to {MAX_FILTERS} filters can be audited in all orders")
    rows, failing, names = failing_tables(docs, rules, copies, id_column, text_column, part_column)
    label = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    bad = salted_join(rows.join(failing, "row", "left_semi"), label, ["id"], "left")
    bad = bad.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    bad = materialize(bad, "bad")
    left = survivors(failing, bad, n)

    # every set and filter outside it: the filter's table against the set's survivors; what is not among them is redundant
    others = F.expr(f"explode(filter(sequence(0, {(1 << n) - 1}), s -> (s & shiftleft(1, rule)) = 0))")
    asked = failing.join(bad, "row").withColumn("set", others)
    removed = asked.join(left.select("row", "set"), ["row", "set"], "left_semi").groupBy("part", "set", "rule").agg(
        F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")
    )
    alive = left.groupBy("part", "set").agg(F.count(F.lit(1)).alias("alive"))
    clean = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).join(alive.where("set = 0"), "part", "left")
    parts = clean.select("part", (F.col("rows") - F.coalesce("alive", F.lit(0))).alias("clean"))
    return _table(materialize(parts, "parts"), materialize(removed, "removed"), materialize(alive, "alive"), names)


def _table(parts: DataFrame, removed: DataFrame, alive: DataFrame, names: list[str]) -> DataFrame:
    """Counts by set and filter, laid out by order and step; zeros where nothing was counted."""
    n, spark = len(names), parts.sparkSession
    pairs = F.array(*[F.struct(F.lit(s).alias("set"), F.lit(f).alias("rule")) for f in range(n) for s in range(1 << n) if not s >> f & 1])
    grid = parts.select("part", "clean", F.inline(pairs)).join(removed, ["part", "set", "rule"], "left")
    grid = grid.withColumn("after", F.expr("set | shiftleft(1, rule)")).join(alive.withColumnRenamed("set", "after"), ["part", "after"], "left").fillna(0)
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("set") + 1)
    when = lambda condition: F.sum(F.when(condition, F.col("removed")).otherwise(0))
    per_filter = grid.groupBy("part", "rule").agg(
        F.sum(F.col("removed") * ways).alias("shapley"), when(F.col("set") == 0).alias("fails"), when(F.col("after") == (1 << n) - 1).alias("unique_fails")
    )
    steps = spark.createDataFrame(orders(names), "filter_order string, step int, rule int, set int")
    full = grid.join(per_filter, ["part", "rule"]).join(F.broadcast(steps), ["set", "rule"])  # n * n! rows, 4,320 at most
    return full.select(
        "part", "filter_order", "step", (F.col("clean") + F.col("alive")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
