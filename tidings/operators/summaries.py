"""Summaries of passages by ranking their sentences in the graph of their likeness.

The likeness of two sentences is the cosine of their weighted words, and a sentence ranks high if high ones are like it
(a random walk with restarts). The graph is never built: one step of the walk goes from sentences to their words and back.
Only the weights of words look beyond a passage, so a passage meets the weights of its words once and is stored as one row. Its
whole walk then runs inside a task, many passages at a time, and no step is shuffled or stored. All passages take the same
number of steps; a first pass finds it. A passage too long for one row walks by joins over (sentence, word) rows, a job
for each step, and its steps are stored.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import tokens
from tidings.plans.shape import hold, unpack
from tidings.plans.skew import HOT_ROWS, bytes_of, row_numbers, salted_join, top_rows
from tidings.plans.storage import materialize

DAMPING = 0.85
TOLERANCE = 1e-3  # change of a sentence's rank, as a share of the mean rank, that no longer counts
PASSAGE_WORDS, PASSAGE_BYTES = 200_000, 4 << 20  # a longer passage is not one row
WALK_WORDS = 100_000  # different words of passages, and sentences, that a task walks through together


class Walk:
    """The walk through some passages, from their ``words`` (a list for each sentence) and the ``idf`` of each passage's words."""

    def __init__(self, words: pa.Array, idf: pa.Array, damping: float):
        count = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        sentences, known = words.flatten(), idf.flatten()
        found = sentences.flatten()
        self.lengths, self.damping = count(words), damping
        codes = pa.concat_arrays([found, known.field(0)]).dictionary_encode()
        width, code = max(1, len(codes.dictionary)), codes.indices.to_numpy().astype(np.int64)
        self.passage = np.repeat(np.arange(len(words)), self.lengths)
        entry, tf = np.unique(np.repeat(np.arange(len(sentences)), count(sentences)) * width + code[: len(found)], return_counts=True)
        self.sent, word = entry // width, entry % width
        place, self.word = np.unique(self.passage[self.sent] * width + word, return_inverse=True)
        have = np.repeat(np.arange(len(words)), count(idf)) * width + code[len(found) :]
        order = np.argsort(have)
        weight = known.field(1).to_numpy(zero_copy_only=False)[order][np.searchsorted(have, place, sorter=order)]
        v = tf * weight[self.word]
        self.x = v / np.sqrt(self._by_sentence(v * v))[self.sent]
        # what a sentence's links add up to, its own included
        self.degree = self._by_sentence(self.x * self._at_words(self.x))
        self.there = self.degree > 0
        self.rank = np.where(self.there, 1.0, 1 - damping)

    def _by_sentence(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.sent, values, len(self.passage))

    def _at_words(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values)[self.word]

    def step(self) -> np.ndarray:
        """How far each rank moves."""
        give = np.divide(self.rank, self.degree, out=np.zeros(len(self.rank)), where=self.there)
        new = self._by_sentence(self.x * self._at_words(self.x * give[self.sent])) * self.damping + (1 - self.damping)
        moved, self.rank = np.abs(new - self.rank), new
        return moved

    def restless(self, tolerance: float) -> Iterator[int]:
        """Steps at which a rank moves by more than ``tolerance``.

        A move over the degree shrinks by the damping at least, for the largest one of the passage, which bounds all moves to come.
        """
        at, bound = 0, np.inf if self.there.any() else 0.0
        while bound > tolerance:
            moved, at = self.step(), at + 1
            if moved.max() > tolerance:
                yield at
            most = np.zeros(len(self.lengths))
            np.maximum.at(most, self.passage, np.divide(moved, self.degree, out=np.zeros(len(moved)), where=self.there))
            bound = self.damping * (self.degree * most[self.passage]).max()


def walks(words: pa.Array, idf: pa.Array, damping: float) -> Iterator[Walk]:
    """Walks through the passages of a batch, in their order, of about ``WALK_WORDS`` different words of passages each."""
    sizes = pc.fill_null(pc.list_value_length(idf), 0).to_numpy(zero_copy_only=False) + pc.list_value_length(words).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // WALK_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for at, end in zip(cuts, cuts[1:]):
        if end > at:
            yield Walk(words.slice(at, end - at), idf.slice(at, end - at), damping)


def word_weights(sentences: DataFrame, idf: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, sent, word, x): words of each sentence by tf-idf over all sentences, scaled to length one.

    ``group`` numbers nothing: it is a 64-bit hash of the keys. ``sent`` must tell the sentences apart.
    """
    counted = unpack(sentences, ["group", "sent"], F.col("words"), "word").groupBy("group", "sent", "word").agg(F.count(F.lit(1)).alias("tf"))
    raw = salted_join(materialize(counted, "words"), idf, ["word"], hot_rows=hot_rows).withColumn("v", F.col("tf") * F.col("idf"))
    raw = materialize(raw.select("group", "sent", "word", "v"), "weights")
    length = raw.groupBy("sent").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return raw.join(length, "sent").select("group", "sent", "word", (F.col("v") / F.col("l")).alias("x"))


def _last_step(restless: Collection[int], tolerance: float) -> int:
    """The first step at which nothing moves any more."""
    at = 0 if tolerance >= 1 else 1
    while at in restless:
        at += 1
    return at


def _walk_by_joins(
    sentences: DataFrame, idf: DataFrame, damping: float, tolerance: float, hot_rows: int, restless: Collection[int]
) -> tuple[DataFrame, int | None]:
    """``row`` and ``rank`` of sentences of passages of any length, and the number of steps; ``restless`` are steps that others need."""
    sent = materialize(row_numbers(sentences.select("group", "row", "words"), [F.xxhash64("group", "row")], name="sent", hot_rows=hot_rows), "sentences")
    weights = materialize(word_weights(sent, idf, hot_rows), "weights")
    total = weights.groupBy("group", "word").agg(F.sum("x").alias("t"))
    linked = salted_join(weights, materialize(total, "totals"), ["group", "word"], hot_rows=hot_rows)
    # what a sentence's links add up to, its own included
    degree = materialize(linked.groupBy("group", "sent").agg(F.sum(F.col("x") * F.col("t")).alias("degree")).withColumn("rank", F.lit(1.0)), "ranks")
    ranks, moved, steps = degree, 1.0, 0
    some = bool(ranks.head(1))
    while some and (moved > tolerance or steps in restless):
        out = weights.join(ranks.select("sent", (F.col("rank") / F.col("degree")).alias("give")), "sent")
        at_words = materialize(out.groupBy("group", "word").agg(F.sum(F.col("x") * F.col("give")).alias("t")), "at-words")
        back = salted_join(weights, at_words, ["group", "word"], hot_rows=hot_rows)
        new = back.groupBy("sent").agg((F.sum(F.col("x") * F.col("t")) * damping + (1 - damping)).alias("_new"))
        stepped = materialize(ranks.join(new, "sent").withColumn("_moved", F.abs(F.col("_new") - F.col("rank"))), "ranks")
        moved, steps = stepped.agg(F.max("_moved")).first()[0], steps + 1
        ranks = stepped.select("group", "sent", "degree", F.col("_new").alias("rank"))
    rank = F.coalesce("rank", F.lit(1 - damping)).alias("rank")
    return sent.join(ranks.select("sent", "rank"), "sent", "left").select("row", rank), steps if some else None


def rank_sentences(
    rows: DataFrame, keys: Sequence[str], body: str, damping: float = DAMPING, tolerance: float = TOLERANCE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` (one sentence each) with ``rank``: its share of the walk, times the number of sentences of its passage.

    A passage is what shares ``keys``; null keys are a value of their own. The mean rank of a passage is 1 where all its
    sentences have words; a sentence without words (null, blank) has 1 less the damping. Repeated rows are sentences of their own and back each other. The
    change shrinks by ``damping`` at least with every step, so the walk always ends. A passage of more than ``hot_rows`` words
    (``PASSAGE_WORDS`` at most) is split by salted joins, and so is a word in very many passages.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    apart = rows.select(F.xxhash64(*keys).alias("group"), row, bytes_of(rows, rows.columns).alias("bytes"), F.col(body).alias("body"))
    sent = hold(apart, words=F.coalesce(tokens(F.col("body")), F.array().cast("array<string>"))).drop("body")
    sent = materialize(sent, "sentences")
    n = sent.where(F.size("words") > 0).count() or 1
    # a rare word counts most; one that is everywhere still counts
    counts = unpack(sent, [], F.array_distinct("words"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    idf = materialize(counts.select("word", "n", F.log1p(F.lit(float(n)) / F.col("n")).alias("idf")), "idf")
    shares = idf.where(F.col("n") > hot_rows).select("word", F.ceil(F.col("n") / hot_rows).cast("int").alias("_shares"))
    idf = idf.drop("n")

    lengths = sent.groupBy("group").agg(F.sum(F.size("words")).alias("n"), F.sum("bytes").alias("bytes"))
    long = materialize(lengths.where((F.col("n") > min(hot_rows, PASSAGE_WORDS)) | (F.col("bytes") > PASSAGE_BYTES)).select("group"), "long-passages")
    split = not long.isEmpty()
    # like hot keys, few however many the rows
    short = sent.join(F.broadcast(long), "group", "left_anti") if split else sent
    texts = short.groupBy("group").agg(F.collect_list(F.struct("row", "words")).alias("sents"))
    words = unpack(short, ["group"], F.array_distinct("words"), "word").distinct()
    weights = salted_join(words, idf, ["word"], hot_rows=hot_rows, hot=shares).groupBy("group").agg(F.collect_list(F.struct("word", "idf")).alias("idf"))
    passages = materialize(texts.join(weights, "group", "left"), "passages")

    def moves(batches):
        for batch in batches:
            steps = {at for walk in walks(*batch.columns, damping) for at in walk.restless(tolerance)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(steps), pa.int32())], ["step"])

    found = passages.select("sents.words", "idf").mapInArrow(moves, "step int").distinct()
    restless = {r.step for r in found.collect()}  # of the few dozen steps that a walk takes
    steps, whole = None, None
    if split:
        whole, steps = _walk_by_joins(sent.join(F.broadcast(long), "group", "left_semi"), idf, damping, tolerance, hot_rows, restless)
    steps = _last_step(restless, tolerance) if steps is None else steps

    @F.arrow_udf("array<double>")
    def ranks(words: pa.Array, idf: pa.Array) -> pa.Array:
        out, lengths = [np.zeros(0)], [np.zeros(0, np.int64)]
        for walk in walks(words, idf, damping):
            for _ in range(steps):
                walk.step()
            out.append(walk.rank)
            lengths.append(walk.lengths)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))

    ranked = passages.select("sents.row", ranks("sents.words", "idf").alias("rank")).select(F.inline(F.arrays_zip("row", "rank")))
    return (ranked if whole is None else ranked.unionByName(whole)).select("row.*", "rank")


def graph_summaries(rows: DataFrame, keys: Sequence[str], order: str, body: str, n: int = 1, **settings) -> DataFrame:
    """(keys, place, sentence, rank): the ``n`` highest sentences of each passage, in the order of the text.

    ``rows`` are pieces of passages in ``order``; each is cut into sentences. Ties go to what comes first. Sentences that are repeated
    word for word are chosen once. A passage without sentences has no row.
    """
    from tidings.functions import text

    cut = unpack(rows, [*keys, F.col(order).alias("_o")], text.sentences(F.col(body)), "sentence", "_i")
    ranked = rank_sentences(cut, keys, "sentence", **settings)
    once = ranked.groupBy(*keys, "sentence").agg(F.min(F.struct("_o", "_i")).alias("_first"), F.max("rank").alias("rank"))
    # ranks end in rounding noise that must not decide
    best = top_rows(once, keys, [-F.round("rank", 6), F.col("_first"), F.col("sentence")], n, "_rn")
    placed = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_first", "sentence", "rank"))).alias("_l"))  # n of each
    return placed.select(*keys, F.posexplode("_l").alias("place", "_x")).select(*keys, "place", "_x.sentence", "_x.rank")
