"""Sentence boundaries with abbreviations that the corpus itself gives away.

An abbreviation is a word that a full stop follows almost always. Words are counted with and without one over the whole
corpus, and a log-likelihood ratio says how much better "nearly always" explains the counts than the usual rate of stops;
short words and inner stops speak for an abbreviation. In the same way, words that stand after certain ends more often than elsewhere
are sentence starters, which end a sentence even after an abbreviation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import BREAK, words
from tidings.plans.shape import hold, unpack
from tidings.plans.skew import salted_join
from tidings.plans.storage import materialize

ABBREVIATION = 0.3  # score from which a word is an abbreviation
STARTER = 30.0  # log-likelihood ratio from which a word is a sentence starter
STOPPED = r"^[^\p{L}\p{N}]*(\p{L}[\p{L}\p{N}.&'-]*?)(\.?)[^\p{L}\p{N}]*$"  # a word and the stop after it
LAST_WORD = r"(\p{L}[\p{L}\p{N}.&'-]*)\.$"
FIRST_WORD = r"^[^\p{L}\p{N}]*([\p{L}\p{N}_]+)"


def _log_likelihood(hits: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of ``hits`` in ``n`` at rate ``p``, without the part that does not depend on the rate."""
    part = lambda k, q: F.when(k > 0, k * F.ln(F.greatest(q, F.lit(1e-12)))).otherwise(0.0)
    return part(hits, p) + part(n - hits, 1.0 - p)


def stop_counts(docs: DataFrame, body: str) -> DataFrame:
    """(word, stopped, total): how often each word, in lower case, stands before a full stop and at all."""
    rows = unpack(docs, [], words(F.col(body)), "token")
    pair = F.struct(F.lower(F.regexp_extract("token", STOPPED, 1)).alias("word"), (F.regexp_extract("token", STOPPED, 2) == ".").alias("stop"))
    return hold(rows, _p=pair).select("_p.*").where("word <> ''").groupBy("word").agg(
        F.count_if("stop").alias("stopped"), F.count(F.lit(1)).alias("total")
    )


def abbreviations(counts: DataFrame, threshold: float = ABBREVIATION) -> DataFrame:
    """(word, score) of the words of ``stop_counts`` that are abbreviations.

    The score is the likelihood ratio of "a stop follows in 99 of 100 cases" against the rate of all words, times e to the minus
    length, times the inner stops and one, times length to the minus occurrences without a stop.
    """
    rate = counts.select(F.sum("stopped") / F.sum("total")).scalar()
    k, n = F.col("stopped"), F.col("total")
    ratio = 2.0 * (_log_likelihood(k, n, F.lit(0.99)) - _log_likelihood(k, n, rate))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), k - n)
    return counts.where("stopped > 0").select("word", score.alias("score")).where(F.col("score") >= threshold)


def candidates(docs: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Pieces between possible ends (a stop, white space, a capital): keys, ``at``, ``piece``, ``before`` (word before the stop), ``first`` word."""
    marked = F.regexp_replace(body, r"([.!?])\s+(\p{Lu})", f"$1{BREAK}$2")
    pieces = F.filter(F.transform(F.split(marked, BREAK), lambda s: F.trim(s)), lambda s: s != "")
    held = hold(docs.select(*keys, body), _p=pieces)
    pair = F.transform("_p", lambda s, i: F.struct(s.alias("piece"), F.when(i > 0, F.get("_p", i - 1)).alias("previous")))
    rows = unpack(held, [*keys], pair, "_x", "at").select(*keys, "at", "_x.*")
    return rows.select(
        *keys, "at", "piece", F.lower(F.nullif(F.regexp_extract("previous", LAST_WORD, 1), F.lit(""))).alias("before"),
        F.lower(F.regexp_extract("piece", FIRST_WORD, 1)).alias("first"), F.col("previous").isNotNull().alias("inner"),
    )


def sentence_starters(docs: DataFrame, body: str, known: DataFrame, threshold: float = STARTER) -> DataFrame:
    """(word, ratio) of words that begin sentences more often than chance: after an end with no abbreviation (``known``: word) before it."""
    rows = materialize(candidates(docs, [], body).where("inner").select("before", "first"), "inner-ends")  # cut once, read twice
    sure = salted_join(rows, known.select(F.col("word").alias("before")), ["before"], "left_anti")
    begins = sure.where(~F.coalesce(F.length("before") == 1, F.lit(False)) & (F.col("first") != "")).groupBy(F.col("first").alias("word")).agg(F.count(F.lit(1)).alias("begins"))
    total = stop_counts(docs, body).select("word", "total")
    both = materialize(total.join(begins, "word", "left").fillna(0, ["begins"]).withColumn("begins", F.least("begins", "total")), "starters")
    n_begins, n = both.select(F.sum("begins")).scalar(), both.select(F.sum("total")).scalar()
    k, of, other, rest = F.col("begins"), F.col("total"), n_begins - F.col("begins"), n - F.col("total")
    overall, here, elsewhere = n_begins / n, k / of, other / F.greatest(rest, F.lit(1))
    ratio = 2.0 * (_log_likelihood(k, of, here) + _log_likelihood(other, rest, elsewhere) - _log_likelihood(k, of, overall) - _log_likelihood(other, rest, overall))
    return both.where(here > overall).select("word", ratio.alias("ratio")).where(F.col("ratio") >= threshold)


def split_sentences(docs: DataFrame, keys: Sequence[str], body: str, known: DataFrame, starters: DataFrame | None = None) -> DataFrame:
    """Sentences of each text as rows: keys, ``sent_idx`` from 0, ``sentence``.

    A possible end after ``!`` or ``?`` is one. After a full stop it is none if the word before is in ``known`` (column ``word``, lower case)
    or a single letter, unless the word after it is among the ``starters``. ``keys`` name a text; null and blank texts give no
    rows. White space at an end that is none becomes one space.
    """
    keys = list(keys)
    rows = materialize(candidates(docs, keys, body).select(*keys, "at", "piece", "before", "first"), "pieces")  # each join counts its keys first
    marked = salted_join(rows, known.select(F.col("word").alias("before"), F.lit(True).alias("_known")).distinct(), ["before"], "left")
    held = F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(F.length("before") == 1, F.lit(False))
    if starters is not None:
        marked = salted_join(marked, starters.select(F.col("word").alias("first"), F.lit(True).alias("_starts")).distinct(), ["first"], "left")
        held = held & F.col("_starts").isNull()
    # the pieces of one text
    number = F.sum((~held).cast("int")).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("_n", number)
    parts = numbered.groupBy(*keys, "_n").agg(F.min("at").alias("_at"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("_parts"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1
    return parts.select(*keys, place.alias("sent_idx"), F.array_join(F.col("_parts").getField("piece"), " ").alias("sentence"))
