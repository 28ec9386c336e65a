"""Backoff scores against counters."""

import math
import random
from collections import Counter

from tidings.llm.lm_scores import score_documents


def brute(rows):
    marked = [(i, (t or "").lower().split()) for i, t in rows]
    pairs = [list(zip([None, *w], [*w, False])) if w else [] for _, w in marked]
    both, first, second = Counter(p for x in pairs for p in x), Counter(a for x in pairs for a, _ in x), Counter(b for x in pairs for _, b in x)
    total = sum(second.values())
    score = lambda a, b: math.log(both[a, b] / first[a] if both[a, b] > 1 else 0.4 * second[b] / total)
    return sorted((str(i), len(w), round(sum(score(a, b) for a, b in x), 6)) for (i, w), x in zip(marked, pairs))


def run(docs, **how):
    return sorted((str(r["doc_id"]), r["n_words"], round(r["score"], 6)) for r in score_documents(docs, **how).collect())


def test_against_counters(spark):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(words[at : at + r.randint(1, 80)])) for i, at in enumerate(range(0, 3900, 40))] + [(500, None), (501, " \n"), (None, "W1 w2"), (0, "w1 w2"), (0, "w1 w2")]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double").repartition(3, "doc_id")
    want = brute(rows)
    assert run(docs) == want
    assert run(docs, part_words=300, max_hot=50) == want  # many parts, frequent words dealt by pairs
    assert [x["mean_score"] for x in score_documents(docs).where("n_words = 0").collect()] == [None, None]


def test_equal_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "c")], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "x"))
    docs.write.mode("append").parquet(str(tmp_path / "x"))
    again = spark.read.parquet(str(tmp_path / "x"))
    assert run(again) == brute([(1, "a b a b"), (2, "c")] * 2)


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
