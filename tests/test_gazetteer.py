"""Typed entities against a search at every place."""

import random
import re

import pytest
from conftest import plan_of

from tidings.operators.gazetteer import name_table, typed_entities


def brute(texts, names):
    words = lambda t: re.findall(r"[^\W]+", (t or "").lower())
    listed = {}
    for n, kind in names:
        if words(n):
            listed.setdefault(tuple(words(n)), set()).add(kind)
    out = set()
    for doc, text in texts:
        w = words(text)
        spans = [(i, len(n)) for n in listed for i in range(len(w)) if tuple(w[i : i + len(n)]) == n]
        for i, n in spans:
            if not any(j <= i and i + n <= j + m and (j, m) != (i, n) for j, m in spans):
                out |= {(doc, i, n, " ".join(w[i : i + n]), kind) for kind in listed[tuple(w[i : i + n])]}
    return out


@pytest.mark.parametrize("hot_rows", [2_000_000, 10])
def test_against_every_place(spark, hot_rows):
    rng = random.Random(5)
    vocabulary = ["new", "york", "city", "times", "bank", "of", "england", "river", "the", "acme"]
    names = [(" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))).title(), rng.choice(["ORG", "LOC", "PER"])) for _ in range(60)]
    names += [("New York", "LOC"), ("New York", "ORG"), ("new  YORK city", "LOC"), ("...", "ORG"), ("", "ORG"), (None, "ORG")]
    texts = [(i, " ".join(rng.choices(vocabulary + ["a", "b", "c"], k=rng.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "In New York, City-Times."), (103, "York"), (104, "new york " * 200)]
    found = typed_entities(
        spark.createDataFrame(texts, "id int, body string"), "id", "body", spark.createDataFrame(names, "name string, type string"), hot_rows=hot_rows
    )
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(texts, names)


def test_empty_tables(spark):
    docs, names = spark.createDataFrame([(1, "New York")], "id int, body string"), spark.createDataFrame([("York", "LOC")], "name string, type string")
    assert typed_entities(docs.limit(0), "id", "body", names).collect() == []
    assert typed_entities(docs, "id", "body", names.limit(0)).collect() == []
    assert name_table(names.limit(0), "name", "type").collect() == []


def test_a_large_list_is_not_broadcast(spark):
    names = spark.range(3_000).selectExpr("concat('name ', id) AS name", "'X' AS type")
    docs = spark.range(50).selectExpr("id", "concat('we met name ', id * 7, ' there') AS body")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        found = typed_entities(docs, "id", "body", names)
        assert "BuildRight" not in plan_of(found) and found.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_that_begin_no_name_meet_nothing(spark, monkeypatch):
    """Keys are counted, and rows shuffled, only for places that begin a name."""
    from tidings.operators import gazetteer

    seen, join = [], gazetteer.salted_join
    monkeypatch.setattr(gazetteer, "salted_join", lambda left, *a, **k: seen.append(left.count()) or join(left, *a, **k))
    docs = spark.createDataFrame([(1, "one two three " * 50 + "acme corp")], "id int, text string")
    names = spark.createDataFrame([("Acme Corp", "org")], "name string, type string")
    assert [tuple(r) for r in gazetteer.typed_entities(docs, "id", "text", names).collect()] == [(1, 150, 2, "acme corp", "org")]
    assert seen == [1]
