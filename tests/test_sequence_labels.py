"""Sequence labels: counts, the best path against all paths, and what the sequence adds."""

import itertools
import math
import random

import numpy as np
import pytest

from tidings.operators.sequence_labels import best_sequence, label_sequences, learn_sequence_model

NEXT = {"lead": "fact", "fact": "quote", "quote": "close", "close": "lead"}
WORDS = {"lead": ["today", "announced"], "fact": ["percent", "million"], "quote": ["said", "think"], "close": ["earlier", "background"]}


def texts(seed, n):
    """Labels mostly follow a ring; half of the sentences have no telling word."""
    rng, rows = random.Random(seed), []
    for d in range(n):
        label = "lead"
        for i in range(rng.randint(3, 9)):
            telling = rng.choice(WORDS[label]) if rng.random() < 0.5 else rng.choice(["the", "and"])
            rows.append((f"{seed}-{d}", i, label, f"The {telling} and"))
            label = NEXT[label] if rng.random() < 0.95 else rng.choice(list(NEXT))
    return rows


SCHEMA = "doc string, i int, label string, sentence string"


@pytest.fixture(scope="module")
def model(spark):
    return learn_sequence_model(spark.createDataFrame(texts(1, 200), SCHEMA), "doc", "i", "label", "sentence")


def test_counts_become_probabilities(spark):
    rows = [("a", 0, "x", "one two"), ("a", 1, "y", "two"), ("a", 2, None, "one"), ("a", 3, "y", None), ("b", 0, "x", "One")]
    m = learn_sequence_model(spark.createDataFrame(rows, SCHEMA), "doc", "i", "label", "sentence", smoothing=1.0)
    assert m.labels == ["x", "y"]
    assert np.allclose(np.exp(m.start), [3 / 4, 1 / 4]) and np.allclose(np.exp(m.steps), [[1 / 3, 2 / 3], [1 / 3, 2 / 3]])
    got = {r.term: [round(math.exp(s), 9) for s in r.scores] for r in m.words.collect()}
    assert got == {"one": [3 / 5, round(1 / 3, 9)], "two": [2 / 5, round(2 / 3, 9)]}


def test_best_path_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        scores, start, steps = rng.normal(size=(n, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        total = lambda p: start[p[0]] + sum(steps[a, b] for a, b in zip(p, p[1:])) + sum(scores[i, x] for i, x in enumerate(p))  # noqa: B023, E731
        assert tuple(best_sequence(scores, start, steps)) == max(itertools.product(range(3), repeat=n), key=total)


def f1(truth, got):
    parts = []
    for label in NEXT:
        hit = sum(got[k] == v == label for k, v in truth.items())
        parts.append(2 * hit / max(1, sum(v == label for v in truth.values()) + sum(v == label for v in got.values())))
    return sum(parts) / len(parts)


def test_held_out_labels(spark, model):
    rows = texts(2, 80)
    truth = {(d, i): label for d, i, label, _ in rows}
    unlabelled = spark.createDataFrame([(d, i, s) for d, i, _, s in rows], "doc string, i int, sentence string")
    got = {(r.doc, r.i): r.label for r in label_sequences(model, unlabelled, "doc", "i", "sentence").collect()}
    alone = {}
    scores = {r.term: r.scores for r in model.words.collect()}
    for d, i, _, s in rows:
        sums = sum(np.array(scores[w]) for w in s.lower().split())
        alone[d, i] = model.labels[int(np.argmax(sums))]
    assert got.keys() == truth.keys()
    assert f1(truth, got) > 0.9 > f1(truth, alone)


def test_odd_rows(spark, model):
    rows = [("a", 1, None), ("a", 0, "today"), (None, 0, "said"), ("b", None, "said"), ("c", 5, "unheard of"), ("a", 2, "said"), ("a", 2, "said")]
    out = label_sequences(model, spark.createDataFrame(rows, "doc string, i int, sentence string"), "doc", "i", "sentence").collect()
    assert sorted((r.doc, r.i) for r in out) == [("a", 0), ("a", 1), ("a", 2), ("c", 5)]
    assert {(r.doc, r.i): r.label for r in out}["a", 2] == "quote"
    empty = learn_sequence_model(spark.createDataFrame([], SCHEMA), "doc", "i", "label", "sentence")
    assert label_sequences(empty, spark.createDataFrame(rows, "doc string, i int, sentence string"), "doc", "i", "sentence").collect() == []
