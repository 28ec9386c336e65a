"""Removed bytes against a count of all strings."""

import random
from collections import Counter

import numpy as np
import pytest

from tidings.llm.repeats import MIN, remove_repeats, window_runs


def brute(texts):
    count = Counter(t[i : i + MIN] for t in texts for i in range(len(t) - MIN + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - MIN + 1):
            if count[t[i : i + MIN]] > 1:
                hit[i : i + MIN] = b"\1" * MIN
        runs = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), runs, bytes(b for b, x in zip(t, hit) if not x)))
    return out


@pytest.mark.parametrize("hot_runs", [50_000, 3])
def test_against_all_strings(spark, hot_runs):
    r = random.Random(5)
    rnd = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    p = [rnd(260) for _ in range(4)]
    texts = ["a" * 201, "b" * 200, "", None, "xyz" * 100, p[0] + rnd(100) + p[1], rnd(50) + p[0][:210] + rnd(10), rnd(300) + p[0][:199] + rnd(30)]
    texts += [p[2] * 3, p[1][20:] + p[2], rnd(5000), "q" * 9000, *["same " + p[3] * 2] * 3]
    texts += [rnd(r.randint(0, 200)) + r.choice(p)[r.randint(0, 40) : r.randint(200, 260)] + rnd(r.randint(0, 100)) + r.choice(p)[r.randint(0, 60) :] for _ in range(20)]
    rows = [(None if i in (5, 6) else min(i, 30), t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed long")
    got = remove_repeats(docs, hot_runs=hot_runs)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"]
    found = sorted((x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept_bytes"])) for x in got.collect())
    assert found == sorted(brute([(t or "").encode() for t in texts]))


def test_windows_have_one_name_wherever_they_stand():
    r = random.Random(1)
    a, b, c = (bytes(r.choices(range(97, 123), k=k)) for k in (150, 400, 90))
    name_at = lambda text, i: next(m for m, at, n, _ in zip(*window_runs(text)) if at <= i < at + n)
    assert [name_at(a + b + c, 150 + i) for i in range(0, 201, 20)] == [name_at(c + b + a, 90 + i) for i in range(0, 201, 20)]
    assert sum(window_runs(a + b + c)[2]) == 640 - MIN + 1
    assert window_runs(b"z" * 300)[3].tolist() == [True]
    assert not len(window_runs(b"short")[0])


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert np.size(window_runs(b"")[0]) == 0
