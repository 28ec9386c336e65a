"""Benchmark windows against a scan with a set of windows."""

import random
import re

import numpy as np
import pytest

from tidings.llm.common import LOWER
from tidings.llm.decontaminate import FMIndex, benchmark_hits

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(item))
    out = []
    for text in texts:
        w = words(text)
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    found |= windows[tuple(w[a : a + size])]
                    hit[a : a + size] = [1] * size
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [16_000_000, 300])
def test_against_scan(spark, block_bytes):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ñü"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 2, 3, 9, 10, 11, 25])))) for i in range(30)] + [(31, None), (3, "A,b.C")]
    texts = [None, "", "x y z", "!!"] + [
        " ".join(r.choice([*vocabulary, "zz"]) for _ in range(r.randint(1, 60))) + " " + (r.choice(items)[1] or "") + "; " + (r.choice(items)[1] or "").upper()
        for _ in range(40)
    ]
    texts += texts[-2:]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    found = benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(x["n_words"], x["n_hit"], x["items"]) for x in found] == brute(texts, items)
    for x, text in zip(found, texts):
        assert sum(len(words((text or "").encode()[a:b].decode())) for a, b in zip(x["spans"][::2], x["spans"][1::2])) == x["n_hit"]


def test_index_counts_and_locates():
    r = np.random.default_rng(1)
    text = np.append(r.integers(1, 5, 200), 0)
    index = FMIndex(text, 4)
    patterns = np.array([[0, *text[i : i + 3]] for i in range(0, 190, 7)] + [[4, 4, 4, 4], [0, 0, 0, 2]])
    for line, low, high in zip(patterns, *index.search(patterns)):
        want = line[line > 0]
        places = [i for i in range(200 - len(want) + 1) if (text[i : i + len(want)] == want).all()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == places


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(docs, none).first()["n_hit"] == 0
    assert benchmark_hits(docs.limit(0), none).collect() == []
