"""Held-out accuracy, calibration and rejection."""

import numpy as np
import pytest
from check import DATA
from pyspark.sql import functions as F

from tidings.llm.language import bucket_counts, has_letter, held_out, identified, identify, train


@pytest.mark.skipif(not (DATA / "sf0.01").exists(), reason="the provided tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    # labels of held-out rows must not matter
    hidden = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang")))
    found = identified(hidden, per_language=150).toPandas()
    test = found[found.held_out]
    assert (test.truth == test.lang_pred).mean() > 0.98
    assert "xx" not in set(found.lang_pred)
    assert found.score.between(0, 1).all() and abs((test.truth == test.lang_pred).mean() - test.score.mean()) < 0.05
    assert found.accepted.mean() > 0.995
    assert ((found.doc_id % 1).eq(0)).all() and len(found) == docs.count()


def test_edge_cases(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 ,.!", None), (5, "", "de"), (6, "—…", None), (7, "A", None)]
    rows += [(None, "the dog", None), (8, "the of and " * 20_000, None), (2, "der hund und die katze", "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = train(docs)
    found = {(r["doc_id"], r["text"]): r for r in identify(docs, model).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 and not found[k]["accepted"] for k in [(3, None), (4, "12 ,.!"), (5, ""), (6, "—…")])
    assert found[(7, "A")]["lang_pred"] in ("en", "de")
    assert found[(8, rows[8][1])]["lang_pred"] == "en"
    assert train(docs.where("lang = 'none'")) is None
    assert {r["lang_pred"] for r in identify(docs, None).collect()} == {"und"}
    assert identified(docs.limit(0)).collect() == []


def test_counts_do_not_depend_on_neighbours():
    texts = [b"ab cd", b"", b"Zebra crossing", "é à".encode()]
    together = bucket_counts(texts)
    assert all((together[i] == bucket_counts([t])[0]).all() for i, t in enumerate(texts))
    assert together[1].sum() == 0
    assert (bucket_counts([b"ZEBRA  crossing"]) == together[2]).all()
    assert has_letter("1é".encode()) and not has_letter(b"1 !") and not has_letter(None)
    assert np.array_equal(together.shape, (4, 8192))
