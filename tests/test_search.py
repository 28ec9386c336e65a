"""Searches that leave most of the data out, against searches that look at all of it."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidings.operators import retrieval
from tidings.operators import vector_index as vi


# ---- vectors ----------------------------------------------------------------------------------------------
def clusters(spark, n=3_000, groups=60, width=12, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    rows = middles[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    df = clusters(spark)
    return df, vi.build_vector_index(df, "id", "v")


def test_recall_grows_with_probes_and_few_vectors_are_scored(clustered):
    df, index = clustered
    queries = df.where("id % 20 = 0")
    true = retrieval.dense_top_k(queries, df, "id", "id", "v", k=20)
    probes = vi.probes_for(index, 20, recall=0.95)
    assert 1 < probes < len(index.centres) / 3
    recalls = [vi.recall_of(vi.search_vectors(index, queries, "id", "v", 20, p), true) for p in (1, probes)]
    assert recalls[0] < recalls[1] and recalls[1] >= 0.9
    scored = vi.scored_vectors(index, queries, "id", "v", probes)
    assert scored.count() == queries.count() and scored.agg(F.avg("vectors")).first()[0] < 3_000 / 3
    assert vi.scored_vectors(index, queries, "id", "v", 1).agg(F.max("vectors")).first()[0] <= index.sizes().agg(F.max("vectors")).first()[0]


def test_every_row_is_in_the_index(clustered):
    df, index = clustered
    assert index.cells.count() == 3_000 and index.cells.select("doc").distinct().count() == 3_000
    assert len(index.centres) == round(3_000**0.5) and np.allclose(np.linalg.norm(index.centres, axis=1), 1)


def test_all_cells_give_the_exact_result(spark, clustered):
    df, index = clustered
    queries = df.where("id < 40")
    small = vi.build_vector_index(df, "id", "v", n_cells=5, sample_per_cell=10, vectors_per_block=200)
    assert small.cells.agg(F.max("block")).first()[0] > 1
    rows = lambda out: sorted((r.query, r.doc, r.score, r["rank"]) for r in out.collect())
    exact = rows(retrieval.dense_top_k(queries, df, "id", "id", "v", k=7))
    assert rows(vi.search_vectors(small, queries, "id", "v", 7, probes=5, queries_per_block=11)) == exact
    assert rows(vi.search_vectors(index, queries, "id", "v", 7, probes=10_000)) == exact


def test_odd_vectors(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None), ("c", [1.0, 1.0]), ("d", [2.0, 2.0]), ("e", [-1.0, 0.0])], "id string, v array<double>")
    index = vi.build_vector_index(df, "id", "v", n_cells=2)
    found = vi.search_vectors(index, df.where("id IN ('b', 'c')"), "id", "v", 3, probes=2).orderBy("query", "rank").collect()
    assert [(r.query, r.doc, r.score) for r in found] == [("b", "a", 0.0), ("b", "b", 0.0), ("b", "c", 0.0), ("c", "c", 1.0), ("c", "d", 1.0), ("c", "a", 0.0)]
    empty = vi.build_vector_index(df.limit(0), "id", "v")
    assert vi.search_vectors(empty, df, "id", "v").collect() == [] and vi.probes_for(empty) == 1
    assert vi.search_vectors(index, df.limit(0), "id", "v").collect() == []


def test_best_columns_and_merging():
    rng = np.random.default_rng(1)
    scores = np.round(rng.random((20, 50)), 1)  # many ties
    for k in (1, 7, 49, 50, 80):
        assert (retrieval._best(scores, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()
    ids, docs = np.arange(20), np.arange(50)
    block = lambda at: pd.DataFrame({"query": np.repeat(ids, len(at)), "doc": np.tile(docs[at], 20), "score": scores[:, at].ravel()})
    merged = retrieval._better(block(np.arange(30, 50)), block(np.arange(30)), 20, 6)
    assert (merged["doc"].to_numpy().reshape(20, 6) == np.argsort(-scores, axis=1, kind="stable")[:, :6]).all()


# ---- words ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    shares = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, shares, k=n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 120))) for i in range(900)], "id long, text string")
    queries = [(i, " ".join(rng.sample(words[60:], 2)) + " " + " ".join(words[:6])) for i in range(12)]
    queries += [(100, "w1 w1 w2"), (101, "unknown"), (102, ""), (103, None), (104, "w299 unknown")]
    return retrieval.build_index(docs, "id", "text"), spark.createDataFrame(queries, "id long, text string")


def ranked(out):
    return {(r.query, r["rank"]): (r.doc, round(r.score, 8)) for r in out.collect()}


def full(index, queries, cutoff, **kw):
    from tidings.plans.skew import top_rows

    return top_rows(retrieval.bm25_scores(index, queries, "id", "text", **kw), ["query"], [F.desc("score"), "doc"], cutoff, "rank")


@pytest.mark.parametrize("cutoff", [1, 5, 2_000])
def test_pruned_search_finds_what_the_full_one_finds(collection, cutoff):
    index, queries = collection
    assert ranked(retrieval.search(index, queries, "id", "text", cutoff)) == ranked(full(index, queries, cutoff))


def test_pruned_search_with_excluded_documents(spark, collection):
    index, queries = collection
    everything = full(index, queries, 2_000)
    out = everything.where("rank <= 4 OR (query = 3 AND rank > 2)").select("query", "doc")
    got = ranked(retrieval.search(index, queries, "id", "text", 5, exclude=out))
    assert got == ranked(full(index, queries, 5, exclude=out)) and (3, 1) not in got and (4, 5) in got


def test_common_words_bring_no_candidates(collection):
    index, queries = collection
    bounds = retrieval.score_bounds(index, queries, "id", "text", 3)
    marks = {(r.query, r.term): r.essential for r in bounds.terms.collect()}
    assert not any(marks[i, "w0"] for i in range(12)) and sum(marks.values()) < len(marks) / 2
    candidates = retrieval.candidate_scores(bounds, index).count()
    assert 12 * 3 <= candidates < retrieval.bm25_scores(index, queries, "id", "text").count() / 4


def test_rounded_ties_keep_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "same words here " + "x " * (i % 2)) for i in range(40)], "id long, text string")
    index = retrieval.build_index(docs, "id", "text")
    queries = spark.createDataFrame([(0, "same here")], "id long, text string")
    for digits in (None, 6, 0):
        got = retrieval.search(index, queries, "id", "text", 10, digits=digits).orderBy("rank").collect()
        assert [r.doc for r in got] == (list(range(10)) if digits == 0 else list(range(0, 20, 2)))
        assert all(math.isclose(r.score, got[0].score, abs_tol=1e-6) for r in got)


def test_what_waits_to_be_settled_is_bounded():
    """A group has many blocks of queries: each holds little besides its results, and single precision loses nothing."""
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    queries, vectors = unit(300), unit(2_400)
    vectors[1_200:] = vectors[:1_200]  # equal scores: the first stays
    block = retrieval.Best(queries, 5, 6)
    for a in range(0, len(vectors), 800):
        block.meet(vectors[a : a + 800], a, np.arange(a, a + 800))
        assert block.waiting <= 2 * 300 * 5 and sum(len(x[0]) for x in block.parts) <= 3 * 300 * 5
    row, score, place, ids = block.settle()
    scores = np.round(queries @ vectors.T, 6)
    expect = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert (ids.reshape(300, 5) == expect).all() and (place == ids).all() and (score.reshape(300, 5) == np.take_along_axis(scores, expect, axis=1)).all()


def odd_texts(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=n))
    rows = [(i % 60, text(rng.randint(0, 30))) for i in range(90)] + [(None, text(9)), (None, text(5)), (70, None), (3, None), (71, "")]
    queries = [(i, text(4)) for i in range(9)] + [(9, None), (None, "w2 w3"), (1, "w5 w39")]
    return spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(queries, "id long, text string")


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_texts_are_read_once_and_postings_stay_out_of_it(spark, monkeypatch, size):
    """Repeated and null documents, null and blank texts: the same as from rows of postings, which a search doesn't make."""
    from tidings.operators import postings

    docs, queries = odd_texts(spark)
    index = retrieval.build_index(docs, "id", "text")
    scores = lambda out: {k: v[1] for k, v in ranked(out).items()}  # noqa: E731  documents of equal scores may change places
    want = scores(full(index, queries, 7))
    monkeypatch.setattr(postings, "PRODUCTS", size)
    monkeypatch.setattr(postings, "CELLS", size)
    monkeypatch.setattr(postings, "TEXTS", min(size, 1_000))
    thin = retrieval.Index(None, None, index.n_docs, index.texts)
    assert scores(retrieval.search(thin, queries, "id", "text", 7)) == want and len(want) > 60
    monkeypatch.setattr(retrieval, "ASKED_TERMS", 2)  # by rows of postings; the bound of a term doesn't know of repeated documents
    once = docs.where("id IS NOT NULL").dropDuplicates(["id"]).localCheckpoint()
    index = retrieval.build_index(once, "id", "text")
    assert scores(retrieval.search(index, queries, "id", "text", 7)) == scores(full(index, queries, 7))


def test_documents_in_several_batches_are_one(spark, monkeypatch):
    from tidings.operators import postings

    docs = spark.createDataFrame([(i % 3, "a b a") for i in range(40)] + [(None, "a")] * 9, "doc long, body string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = postings.asked_counts(docs, ["a", "b", "c"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc: (sorted(r.lens), dict(zip(r.codes, r.tfs))) for r in rows}
    assert len(rows) == 4 and got[None] == ([1] * 9, {0: 9})
    assert {d: (len(n), set(n), c) for d, (n, c) in got.items() if d is not None} == {0: (14, {3}, {0: 28, 1: 14}), 1: (13, {3}, {0: 26, 1: 13}), 2: (13, {3}, {0: 26, 1: 13})}


def test_long_words_are_found_once(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from conftest import plan_of
    from workload import retrieval as workload

    spark.createDataFrame([(1, "extraordinary profit"), (2, "extraordinary board"), (3, "profit")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "extraordinary profit")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, overlap = [], workload.joins.entity_overlap
    monkeypatch.setattr(workload.joins, "entity_overlap", lambda t, a, *more, **kw: seen.append(plan_of(a)) or overlap(t, a, *more, **kw))
    assert [(r["query"], r.doc) for r in entry.queries()["bm25_excluding"](spark, str(tmp_path)).collect()] == [(7, 3)]
    assert len(seen) == 1 and "Generate" not in seen[0]
