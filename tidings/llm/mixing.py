"""Mixing sources to target weights by raking, in DataFrame operations only.

Documents are counted into cells (one per source, language and topic). Iterative proportional fitting
scales the tokens of the cells to the target shares of each marginal in turn. The fitted share of a
cell against its own tokens gives every document of the cell one probability, calibrated so that the
sample has the wanted number of tokens although no probability exceeds one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import materialize, prepare

ROUNDS = 50  # most passes over the marginals
TOLERANCE = 1e-6  # change of a marginal that no longer counts
CAPPING_ROUNDS = 12  # each fixes the cells whose probability has reached one
MAX_BROADCAST_CELLS = 100_000
FEW_CELLS = 100_000  # cells that are one partition; more are shuffled in every round


def word_count(text_column: str) -> Column:
    """White-space separated words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(r"\S+")), F.lit(0)).cast("long")


def form_topic(text_column: str) -> Column:
    """A coarse topic by form: ``records`` are rich in digits, ``lists`` in line ends, ``blank`` has no text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = F.length(text)
    digits, lines = size - F.length(F.translate(text, "0123456789", "")), size - F.length(F.translate(text, "\n", ""))
    return (
        F.when(F.trim(text) == "", "blank").when(50 * digits >= size, "records").when(200 * lines >= size, "lists").otherwise("prose")
    )


def gathered(cells: DataFrame, few: bool) -> DataFrame:
    """``cells``; few of them in one partition, which sums and joins need not shuffle.

    Rounds over few cells would otherwise be many almost empty tasks, and the driver keeps books of each.
    """
    return cells.coalesce(1) if few else cells


def tempered(cells: DataFrame, column: str, power: float) -> DataFrame:
    """Target shares that lean from the present shares (power 1) to equal ones (power 0)."""
    held = cells.groupBy(column).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("_p")).where("_p > 0")
    total = held.agg(F.sum("_p")).first()[0] or 1.0
    return held.select(column, (F.col("_p") / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``fitted``: tokens scaled to the target shares of each column of ``targets``.

    A value without a target keeps its tokens. Rounds end when the last one changed no marginal by more than
    ``tolerance`` of itself. Each round is stored, so a lost executor costs one round. Joins are
    shuffled, as the number of cells has no bound; up to ``FEW_CELLS`` are one partition, and no round shuffles.
    """
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total, few = total or 0, n <= FEW_CELLS
    fitted = gathered(cells, few).withColumn("fitted", F.col("tokens").cast("double"))
    for column, share in targets.items():
        fitted = fitted.join(share.select(column, (F.col("share") * total).alias(f"{column}_goal")).hint("shuffle_hash"), column, "left")
    fitted = gathered(materialize(fitted, "cells"), few)
    for _ in range(rounds):
        fitted = fitted.withColumn("_moved", F.lit(0.0))
        for column in targets:
            goal = F.first(f"{column}_goal")
            factor = fitted.groupBy(column).agg(F.when(goal.isNotNull() & (F.sum("fitted") > 0), goal / F.sum("fitted")).otherwise(1.0).alias("_factor"))
            # said again after each join, as Spark does not see that the join of single partitions is one
            fitted = gathered(fitted.join(factor.hint("shuffle_hash"), column), few).withColumns(
                {"fitted": F.col("fitted") * F.col("_factor"), "_moved": F.greatest("_moved", F.abs(F.col("_factor") - 1))}
            ).drop("_factor")
        fitted = gathered(materialize(fitted, "cells"), few)
        moved = fitted.agg(F.max("_moved")).first()[0] or 0.0
        fitted = fitted.drop("_moved")
        if moved <= tolerance:
            break
    return fitted.drop(*[f"{column}_goal" for column in targets])


def calibrated(fitted: DataFrame, rate: float) -> DataFrame:
    """``fitted`` with ``probability``: proportional to fitted tokens over tokens, at most 1, with ``rate`` of all tokens expected."""
    ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0)
    fitted = fitted.withColumn("ratio", ratio)
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    scale = float(rate)
    for _ in range(CAPPING_ROUNDS):
        full = F.col("ratio") * scale >= 1
        row = fitted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("fitted")))).first()
        capped, free = row[0] or 0, row[1] or 0.0
        new = (rate * total - capped) / free if free > 0 else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * scale))


def chance(id_column: str, seed: int) -> Column:
    """A number in [0, 1) that the id and the seed decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def mix(
    docs: DataFrame, rate: float = 0.8, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
    id_column: str = "doc_id", text_column: str = "text", topic: Column | None = None, seed: int = 17, rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with ``topic``, ``tokens``, ``weight`` (raking ratio), ``probability`` and ``kept``.

    ``targets`` gives shares per marginal (``source``, ``lang``, ``topic``) as tables with the value and
    ``share``; by default they are the present shares tempered by ``powers``. ``rate`` is the share of all tokens to keep. Null
    values of a marginal are a value of their own; documents without tokens weigh as their cell does.
    Rows of one id share their fate. An empty table stays empty. Columns of ``docs`` with the names of
    results are replaced.
    """
    prepare(docs.sparkSession)
    powers = powers or {"source": 0.7, "lang": 0.7, "topic": 0.9}
    kind = form_topic(text_column) if topic is None else topic
    new = ["topic", "tokens", "weight", "probability", "kept"]
    marked = docs.withColumns({"_topic": kind, "_tokens": word_count(text_column)}).drop(*new).withColumnsRenamed({"_topic": "topic", "_tokens": "tokens"})
    keys = ["source", "lang", "topic"]
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    cells = materialize(marked.groupBy(*[name(c).alias(f"_{c}") for c in keys]).agg(F.sum("tokens").alias("tokens")), "cells")
    cells = gathered(cells, cells.count() <= FEW_CELLS)
    goals = {
        f"_{c}": targets[c].select(name(c).alias(f"_{c}"), "share") if targets and c in targets else tempered(cells, f"_{c}", powers[c]) for c in keys
    }
    fitted = materialize(calibrated(rake(cells, goals, rounds), rate).select(*goals, F.col("ratio").alias("weight"), "probability"), "cells")
    if fitted.count() <= MAX_BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    old: Sequence[str] = [c for c in docs.columns if c not in new]
    out = marked.withColumns({f"_{c}": name(c) for c in keys}).join(fitted, list(goals))
    return out.select(*[F.col(f"`{c}`") for c in old], "topic", "tokens", "weight", "probability", (chance(id_column, seed) < F.col("probability")).alias("kept"))
