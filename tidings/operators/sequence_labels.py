"""Labels of the sentences of a text as one sequence: a hidden Markov model counted out of labelled sentences.

Which label follows which, and which words stand under which label, are counts over the labelled sentences. A text's words
meet the word table by a join, the scores of its sentences come together in its row, and the best sequence is found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import tokens
from tidings.plans.shape import unpack
from tidings.plans.skew import salted_join
from tidings.plans.storage import materialize

MAX_LABELS = 256  # transitions are a square of this side at most


@dataclass
class SequenceModel:
    """``words``: (term, scores) log probabilities by label, stored; ``start`` and ``steps``: log probabilities of first labels and of label after label."""

    labels: list[str]
    words: DataFrame
    start: np.ndarray
    steps: np.ndarray


def learn_sequence_model(
    labelled: DataFrame, doc: str, order: str, label: str, sentence: str, smoothing: float = 0.1
) -> SequenceModel:
    """Counts of (doc, order, label, sentence) rows turned into log probabilities.

    ``smoothing`` is added to every count. Rows without a label are left out, so the label after it counts as following the
    one before. A null sentence has no words.
    """
    rows = materialize(labelled.where(F.col(label).isNotNull()).select(doc, order, F.col(label).alias("label"), F.col(sentence).alias("sentence")), "labelled")
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    before = F.lag("label").over(Window.partitionBy(doc).orderBy(order))
    steps = rows.select(before.alias("before"), "label").groupBy("before", "label").count().toPandas()  # labels squared at most
    at = {x: i for i, x in enumerate(labels)}
    start, matrix = np.full(len(labels), smoothing), np.full((len(labels), len(labels)), smoothing)
    for r in steps.itertuples(index=False):
        if r.before is None or r.before != r.before:
            start[at[r.label]] += r.count
        else:
            matrix[at[r.before], at[r.label]] += r.count

    terms = unpack(rows, ["label"], tokens(F.col("sentence")), "term").groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))
    terms = materialize(terms, "label-terms")
    n_terms = terms.select("term").distinct().count()
    totals = {r["label"]: r["n"] for r in terms.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    under = [F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)) for x in labels]
    scores = [F.log((n + smoothing) / (totals.get(x, 0) + smoothing * max(1, n_terms))) for x, n in zip(labels, under)]
    words = terms.groupBy("term").agg(F.array(*scores).alias("scores")) if labels else terms.select("term", F.array().cast("array<double>").alias("scores"))
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return SequenceModel(labels, materialize(words, "label-words"), log(start) if labels else start, log(matrix) if labels else matrix)


def best_sequence(scores: np.ndarray, start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Viterbi: the likeliest labels of sentences with these log scores (one row per sentence); the first label on a tie."""
    best, back = start + scores[0], np.zeros(scores.shape, np.int64)
    for i in range(1, len(scores)):
        ways = best[:, None] + steps
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[i]
    path = np.empty(len(scores), np.int64)
    path[-1] = best.argmax()
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def sentence_scores(model: SequenceModel, sents: DataFrame, doc: str, order: str, sentence: str) -> DataFrame:
    """(doc, order, scores): log probability of each sentence's words under every label; words the model has not met say nothing."""
    rows = sents.select(F.col(doc).alias("doc"), F.col(order).alias("order"), sentence)
    words = unpack(rows, ["doc", "order"], tokens(F.col(sentence)), "term").groupBy("doc", "order", "term").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(words, model.words, ["term"])
    sums = met.groupBy("doc", "order").agg(F.array(*[F.sum(F.col("n") * F.col("scores")[i]) for i in range(len(model.labels))]).alias("scores"))
    silent = F.array(*[F.lit(0.0)] * len(model.labels))
    return rows.select("doc", "order").distinct().join(sums, ["doc", "order"], "left").select("doc", "order", F.coalesce("scores", silent).alias("scores"))


def label_sequences(model: SequenceModel, sents: DataFrame, doc: str, order: str, sentence: str) -> DataFrame:
    """(doc, order, label) of every sentence: the likeliest sequence of each text.

    Rows that repeat a doc and order are one sentence with the words of all; nulls in either are dropped. A model without labels gives no rows.
    """
    kinds = f"{doc} {sents.schema[doc].dataType.simpleString()}, {order} {sents.schema[order].dataType.simpleString()}, label string"
    if not model.labels:
        return sents.sparkSession.createDataFrame([], kinds)
    known = sents.where(F.col(doc).isNotNull() & F.col(order).isNotNull())
    # the sentences of one text
    packed = sentence_scores(model, known, doc, order, sentence).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("order", "scores"))).alias("s"))
    labels, start, steps = np.array(model.labels, object), model.start, model.steps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in zip(batch["doc"], batch["s"]):
                path = best_sequence(np.array([list(r["scores"]) for r in rows]), start, steps)
                yield pd.DataFrame({doc: name, order: [r["order"] for r in rows], "label": labels[path]})

    return packed.mapInPandas(run, kinds)
