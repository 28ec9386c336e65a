"""Sentence ranks against power iteration on the full likeness matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.operators import summaries as s

SENTENCES = {
    "a": ["The mill burned down.", "The old mill burned on Monday.", "Nobody was hurt at the old mill.", "Weather stays dry.", "Monday was dry."],
    "b": ["One two three.", "Three four five.", "Five six seven.", "Three five.", "Three five."],
    None: ["Left alone here.", "???"],
}


def by_hand(groups, damping):
    words = {k: [[w for w in "".join(c if c.isalnum() else " " for c in x.lower()).split()] for x in v] for k, v in groups.items()}
    flat = [w for v in words.values() for w in v if w]
    idf = {w: np.log1p(len(flat) / sum(w in x for x in flat)) for x in flat for w in x}
    out = {}
    for k, v in words.items():
        vocabulary = sorted({w for x in v for w in x})
        m = np.array([[x.count(w) * idf[w] for w in vocabulary] for x in v]).reshape(len(v), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        a = m @ m.T
        degree = a.sum(axis=1)
        p = np.divide(a, degree[:, None], out=np.zeros_like(a), where=degree[:, None] > 0)
        r = np.ones(len(v))
        for _ in range(300):
            r = np.where(degree > 0, damping * (p.T @ r) + 1 - damping, 1 - damping)
        out[k] = r
    return out


def table(spark):
    return spark.createDataFrame([(k, i, x, 7) for k, v in SENTENCES.items() for i, x in enumerate(v)], "k string, i int, body string, `group` int")


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_ranks_equal_the_walk_on_the_whole_graph(spark, hot_rows):
    """Also where words and passages count as hot and are split."""
    out = s.rank_sentences(table(spark), ["k"], "body", tolerance=1e-7, hot_rows=hot_rows).collect()
    expected = by_hand(SENTENCES, s.DAMPING)
    assert len(out) == sum(map(len, SENTENCES.values()))
    for r in out:
        assert r["rank"] == pytest.approx(expected[r["k"]][r["i"]], abs=1e-5), r


def test_summaries_take_each_sentence_once_in_order(spark):
    rows = spark.createDataFrame([("x", 1, "Three five. One two three. Three five."), ("x", 0, "Three four five. Nine. Five six seven."), ("y", 0, None), ("z", 0, "")],
                                 "k string, o int, body string")
    out = s.graph_summaries(rows, ["k"], "o", "body", n=2).orderBy("place").collect()
    assert [(r["k"], r["place"], r["sentence"]) for r in out] == [("x", 0, "Three four five."), ("x", 1, "Three five.")]


def test_edges(spark):
    rows = table(spark)
    assert s.rank_sentences(rows.where("false"), ["k"], "body").count() == 0
    blank = s.rank_sentences(rows.withColumn("body", F.lit(None).cast("string")), ["k"], "body").collect()
    assert {r["rank"] for r in blank} == {1 - s.DAMPING} and len(blank) == rows.count()


def test_steps_are_not_stored_and_long_passages_take_as_many(spark, monkeypatch):
    """Passages inside tasks, split ones and both together: the same number of steps and the same ranks."""
    stored, keep = [], s.materialize
    monkeypatch.setattr(s, "materialize", lambda df, label: stored.append(label) or keep(df, label))
    ranks = lambda hot_rows: {(r["k"], r["i"]): r["rank"] for r in s.rank_sentences(table(spark), ["k"], "body", hot_rows=hot_rows).collect()}
    inside = ranks(1_000_000)
    assert "at-words" not in stored and "ranks" not in stored
    for hot_rows in (3, 17):  # all passages are long, only one is
        stored.clear()
        assert ranks(hot_rows) == pytest.approx(inside, abs=1e-9)
        assert "at-words" in stored
