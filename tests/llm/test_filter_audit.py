"""Counts of every order against filters that run one after another."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidings.llm.filter_audit import audit_filters, text_rules


def brute(rows, labels):
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    docs = []
    for key, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": key is not None and first[t] < key,
        }
        docs.append((part or "", {x for x, bad in fails.items() if bad}, labels.get(key, (0, 0))))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                only = sum(d[1] == {f} for d in mine)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), redundant, only, sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)))
    return sorted(o + (shapley[o[0], o[1][o[2] - 1]],) for o in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, row long")


def test_against_filters_in_turn(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    kinds = [
        lambda: " ".join(word(5) for _ in range(60)), lambda: " ".join(word(4) for _ in range(20)), lambda: "again " * 70,
        lambda: (" ".join(word(4) for _ in range(55))).upper(), lambda: " ".join(word(6) for _ in range(51)) + " a|b", lambda: "É" * 3 + " Ab\x0bcd",
    ]
    rows = [(i, r.choice(kinds)(), r.choice(["s", "s", "t", None])) for i in range(80)]
    rows += [(100 + i, r.choice(rows)[1], r.choice("st")) for i in range(30)]
    rows += [(5, rows[5][1], "s"), (5, rows[5][1], "t"), (None, rows[1][1], "t"), (None, None, "t"), (200, None, "u"), (201, "", "s"), (202, "x " * 200_000, "s")]
    labels = {k: (r.randint(0, 1), r.randint(0, 1)) for k in range(0, 130, 2)}
    doubled = [(k, q, t) for k, (q, t) in labels.items()] + [(4, None, 0), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    found = audit_filters(table(spark, rows), spark.createDataFrame(doubled, "doc_id long, quality int, toxic int"))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(rows, labels)


def test_own_rules_and_limits(spark):
    docs = spark.createDataFrame([("x", 1, "p"), ("y", 5, "p"), ("z", None, None)], "key string, size int, kind string").withColumn("text", F.lit("t"))
    labels = spark.createDataFrame([], "key string, quality int, toxic int")
    found = audit_filters(docs, labels, {"S": F.col("size") < 3, "L": F.col("size") > 4}, None, "key", part_column="kind")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in found.collect()}
    assert got == {
        ("p", "SL", 1): (1, 1, 2), ("p", "SL", 2): (0, 1, 2), ("p", "LS", 1): (1, 1, 2), ("p", "LS", 2): (0, 1, 2),
        ("", "SL", 1): (1, 0, 0), ("", "SL", 2): (1, 0, 0), ("", "LS", 1): (1, 0, 0), ("", "LS", 2): (1, 0, 0),
    }
    with pytest.raises(ValueError):
        audit_filters(docs, labels, {str(i): F.lit(True) for i in range(7)}, None, "key")


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(table(spark, []), labels).collect() == []
    one = audit_filters(table(spark, [(1, None, None)]), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""}
    assert sum(r["removed"] for r in one) == 120


def test_rules_of_nulls(spark):
    row = spark.createDataFrame([(None,)], "text string").select(*[c.alias(k) for k, c in text_rules().items()]).first()
    assert tuple(row) == (True, False, False, False)
