"""One document of each group of near copies, whatever the ids are."""

import corpus_pipeline


def test_one_of_each_group(spark):
    text = lambda topic, *edits: " ".join([f"{topic}{i}" for i in range(60)] + list(edits))
    groups = {
        "repeated id": [(5, text("a")), (5, text("a", "new")), (7, text("a", "other"))],
        "null ids": [(None, text("b")), (None, text("b", "new")), (None, text("b", "new")), (None, text("b", "other"))],
        "null beside an id": [(None, text("c")), (9, text("c", "new"))],
        "repeated rows": [(11, text("d")), (11, text("d"))],
        "same id, other group": [(5, text("e")), (6, text("e", "new"))],
    }
    blank = [(12, ""), (13, None), (None, None), (13, None)]
    docs = spark.createDataFrame([r for g in groups.values() for r in g] + blank, "doc_id long, text string")
    found = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    ids = {"repeated id": 5, "null ids": None, "null beside an id": 9, "repeated rows": 11, "same id, other group": 5}
    for name, rows in groups.items():
        (stays,) = [r for r in found if r in rows]
        assert stays[0] == ids[name]
    assert sorted([r for r in found if not r[1]], key=str) == sorted(set(blank), key=str)
    assert len(found) == 8
