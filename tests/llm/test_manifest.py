"""Manifests and proofs against a tree built in one go."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidings.llm.manifest import FIELDS, build, height, leaf_digest, missing_nodes, prove, width

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at >>= 1
    return out


def fold(value, steps):
    for odd, sibling in steps:
        value = H(*([sibling, value] if odd else [value, sibling] if sibling else [value]))
    return value


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars"""
    of = lambda r, more=0: H(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, of(r)))
        trees.append((mine, tree([of(r) for r in mine])))
    top = tree([levels[-1][0] for _, levels in trees])
    out = []
    for t, (mine, levels) in enumerate(trees):
        for i, r in enumerate(mine):
            steps = path(levels, i) + path(top, t)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            root = fold(of(r, bad), steps)
            out.append((r[0], of(r), levels[-1][0], top[-1][0], H(*[s for _, s in steps if s]), root, root == top[-1][0]))
    return sorted(out, key=str)


def query(docs, levels=10):
    raised = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    made = build(docs, claim=leaf_digest([raised if f == "n_chars" else F.col(f) for f in FIELDS]), levels=levels)
    x = lambda c: F.lower(F.hex(c))
    got = prove(made).select(
        "id", x("leaf"), x("subroot"), F.lit(made.root.hex()), F.sha2(x("proof"), 256), x("folded_root"), F.col("folded_root") == F.lit(made.root), "derived_root"
    ).collect()
    assert all(bytes(r["derived_root"]) == made.root for r in got)
    return sorted([tuple(r)[:-1] for r in got], key=str)


def rows_of(n, seed=1):
    r = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", None, "zz", "en-x"]
    rows = [(i, f"text {i % 9} é😀", r.choice(langs), r.choice(["a", None]), r.choice([i, None])) for i in range(n)]
    return rows + [(None, None, "en", None, None), (None, "x", "en", None, 3), (7, "t", "de", "a", 1), (7, "t", "de", "a", 1), (7, "", "de", "a", 1), (3, "lone", "solo", "a", 9)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, index int, row string"


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_against_one_tree(spark, levels):
    for n in (0, 40, 133):
        rows = rows_of(n)
        assert query(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), levels) == brute(rows)
    one = [(1, "only", "en", "a", 4)]
    assert query(spark.createDataFrame([(*r, "x", 1, "y") for r in one], SCHEMA), levels) == brute(one)


def test_proofs_of_some_leaves(spark):
    rows = rows_of(90)
    made = build(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), levels=3)
    every = {(r["tree"], r["index"]): bytes(r["proof"]) for r in prove(made).collect()}
    some = prove(made, made.leaves.where("index % 5 = 2")).collect()
    assert len(every) == len(rows) and len(some) == made.leaves.where("index % 5 = 2").count() > 10
    for r in some:
        assert bytes(r["proof"]) == every[r["tree"], r["index"]] and bytes(r["folded_root"]) == bytes(r["derived_root"]) == made.root


def test_fewest_missing_nodes():
    r = random.Random(2)
    for size in (1, 2, 3, 7, 8, 21, 64):
        for _ in range(20):
            known = r.sample(range(size), r.randint(1, size))
            missing = set(missing_nodes(known, size))
            have = {(0, k) for k in known} | missing
            for level in range(height(size)):  # everything up to the root can be derived ...
                for i in range(width(size, level)):
                    if i % 2 == 0 and (level, i) in have and (i + 1 == width(size, level) or (level, i + 1) in have):
                        assert (level + 1, i >> 1) not in missing  # ... and nothing that can be derived is fetched
                        have.add((level + 1, i >> 1))
            assert (height(size), 0) in have
            below = {(level, k >> level) for k in known for level in range(height(size) + 1)}
            assert not missing & below and all((level, i ^ 1) in below for level, i in missing)
    assert missing_nodes(range(10), 10) == []


def test_string_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(f"k{i:03}", i % 2) for i in range(30)] + [("k000", None)], "key string, part int")
    made = build(docs, ["key", "part"], "key", "part")
    assert [r["size"] for r in made.trees.orderBy("tree").collect()] == [1, 15, 15]
    assert all(bytes(r["folded_root"]) == made.root for r in prove(made).collect())
    nothing = build(docs.limit(0), ["key", "part"], "key", "part")
    assert nothing.root is None and prove(nothing).collect() == []


def test_very_long_text(spark):
    rows = [(1, "long " * 500_000, "en", "a", 2_500_000), (2, "short", "en", "a", 5)]
    assert query(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)) == brute(rows)
