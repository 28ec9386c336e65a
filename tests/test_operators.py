import math
import random
import statistics

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.operators import aggregates as agg
from tidings.operators import evaluate, reports, retrieval, scoring

SENT = "article_url string, press_release_url string, press_release_idx int, contradiction double, neutral double, entailment double"


# ---- aggregates --------------------------------------------------------------------------------
def test_two_level_fixture(spark):
    rows = [("a", "r", 0, c, n, c) for c, n in zip([0.9, 0.5, 0.1, 0.7], [0.1, 0.2, 0.3, 0.9])]
    rows += [("a", "r", 1, c, n, c) for c, n in zip([0.2, 0.4], [0.5, 0.7])]
    out = agg.two_level_scores(spark.createDataFrame(rows, SENT)).first()
    assert (round(out.contradiction, 9), round(out.neutral, 9)) == (0.5, 0.4)


def test_large_k_is_the_plain_mean(spark):
    rng = random.Random(2)
    rows = [("a", str(i % 3), i % 5, rng.random(), rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, SENT)
    names = ("contradiction", "entailment", "neutral")
    top = {s: (m, 1_000) for s, m in zip(names, ("top_k_mean", "bottom_k_mean", "top_k_mean"))}
    mean = {s: ("mean", None) for s in names}
    key = lambda d: {r.press_release_url: [round(r[s], 9) for s in names] for r in d.collect()}
    assert key(agg.two_level_scores(df, level_1=top, level_2=top)) == key(agg.two_level_scores(df, level_1=mean, level_2=mean))
    with pytest.raises(ValueError, match="unknown"):
        agg.two_level_scores(df, level_1={"neutral": ("mode", None)})


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (2000,), (2001,), (1999,)], "x int")
    assert {r.bin: r.n for r in agg.histogram(df, "x", 0, 2000, 50).collect()} == {0: 1, 49: 2}


def test_percentiles_of_groups(spark):
    rng = random.Random(4)
    values = {k: [rng.randrange(30) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), (None, 1)], "k string, v int")
    for r in agg.box_summary(df, "k", "v").collect():
        vs = sorted(values[r.k])
        at = lambda p: vs[math.floor(p * (len(vs) - 1))] + (p * (len(vs) - 1) % 1) * (vs[math.ceil(p * (len(vs) - 1))] - vs[math.floor(p * (len(vs) - 1))])
        assert (r.min, r.max, r.median) == (vs[0], vs[-1], statistics.median(vs))
        assert math.isclose(r.q1, at(0.25)) and math.isclose(r.q3, at(0.75))


def test_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "k string, f int")
    assert {r.k: r.n for r in agg.value_counts(df, "k").collect()} == {"a": 2}
    assert {r.k: r.share for r in agg.value_shares(df, "k").collect()} == {"a": 1.0}
    assert {r.k: r.rate for r in agg.rate_by_group(df, "k", "f").collect()} == {"a": 1.0}


def test_frequent_entities(spark):
    rows = spark.createDataFrame([(d, e) for d in range(100) for e in ("all", "few" if d < 3 else "some" if d < 10 else "x")], "doc int, ent string")
    out = agg.frequent_by_documents(rows, 100, spark.createDataFrame([("all",)], "e string"))
    assert {r.ent for r in out.collect()} == {"x", "some"}
    assert {r.ent for r in agg.frequent_by_documents(rows, 100, top=2).collect()} == {"all", "x"}


def test_auc_and_f1(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.randrange(10)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s int")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expect = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(agg.roc_auc(df, "y", "s").first()["auc"], expect)
    f1 = {r.label: r.f1 for r in agg.f1_by_class(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (2, 0)], "t int, p int"), "t", "p").collect()}
    assert f1 == {0: 0.5, 1: 2 / 3, 2: 0.0}


def test_balancing(spark):
    df = spark.range(50).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = agg.balance_classes(df, "y", "id", seed=1)
    rows = out.collect()
    assert sorted(set(r.y for r in rows)) == [0, 1] and all(sum(r.y == c for r in rows) == 45 for c in (0, 1))
    assert all((r.id % 10 == 0) == bool(r.y) for r in rows)
    assert out.exceptAll(agg.balance_classes(df, "y", "id", seed=1)).count() == 0


def test_sources_per_document(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("a", "y"), ("b", None)], "d string, s string")
    assert {r.d: r.n_sources for r in agg.sources_per_document(df, "d", "s").collect()} == {"a": 2}
    assert {r.d: r.n_sources for r in agg.sources_per_document(df, "d", "s", count_null=True).collect()} == {"a": 2, "b": 0}


# ---- retrieval -------------------------------------------------------------------------------------
COLLECTION = [
    ("doc_1", "Generals gathered in their masses"), ("doc_2", "Just like witches at black masses"),
    ("doc_3", "Evil minds that plot destruction"), ("doc_4", "Sorcerer of death's construction"),
]


@pytest.fixture(scope="module")
def index(spark):
    return retrieval.build_index(spark.createDataFrame(COLLECTION, "id string, text string"), "id", "text")


def found(index, spark, query, **kw):
    q = spark.createDataFrame([("q", query)], "query string, text string")
    return [(r.doc, r.score) for r in retrieval.search(index, q, "query", "text", **kw).orderBy("rank").collect()]


def pairs(spark, *docs):
    return spark.createDataFrame([("q", d) for d in docs], "query string, doc string")


def test_bm25_demo(spark, index):
    everything = found(index, spark, "witches masses")
    assert [d for d, _ in everything] == ["doc_2", "doc_1"]
    only = found(index, spark, "witches masses", include=pairs(spark, "doc_2", "doc_3", "doc_4"))
    assert [d for d, _ in only] == ["doc_2"] and math.isclose(only[0][1], everything[0][1])
    assert found(index, spark, "nothing known") == []
    n, length = 4, 6 / (21 / 4)
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert math.isclose(everything[0][1], (idf(1) + idf(2)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length)), rel_tol=1e-4)


def test_filters_partition_the_results(spark, index):
    everything = dict(found(index, spark, "their black plot construction"))
    some = pairs(spark, "doc_1", "doc_3", "unknown")
    inside = dict(found(index, spark, "their black plot construction", include=some))
    outside = dict(found(index, spark, "their black plot construction", exclude=some))
    assert inside.keys() | outside.keys() == everything.keys() and not inside.keys() & outside.keys()
    assert all(math.isclose(everything[d], s) for d, s in {**inside, **outside}.items())
    both = found(index, spark, "their black plot construction", include=some, exclude=pairs(spark, "doc_1"))
    assert [d for d, _ in both] == ["doc_3"]
    assert len(found(index, spark, "their black plot construction", include=pairs(spark, *[d for d, _ in COLLECTION]))) == len(everything)


def test_stored_index(spark, index, tmp_path):
    index.save(str(tmp_path / "index"), buckets=2)
    loaded = retrieval.Index.load(spark, str(tmp_path / "index"))
    assert found(loaded, spark, "witches masses") == found(index, spark, "witches masses")


def test_similar_articles(spark):
    weights = retrieval.tfidf_weights(spark.createDataFrame(COLLECTION, "id string, text string"), "id", "text", max_df=1.0)
    cands = spark.createDataFrame([("doc_1", "doc_2", 1), ("doc_1", "doc_3", 2), ("doc_1", "gone", 3), ("new", "doc_4", 2), ("new", "doc_1", 1)], "t string, c string, p int")
    got = [(r.t, r.c, r["rank"]) for r in retrieval.similar_top_k(cands, weights, "t", "c", "p", k=1).collect()]
    assert sorted(got) == [("doc_1", "doc_2", 1), ("new", "doc_1", 1)]
    few = retrieval.similar_top_k(cands, weights, "t", "c", "p", k=10)
    assert few.count() == 5


@pytest.mark.parametrize("block", [2_048, 7])
def test_dense_search_equals_brute_force(spark, block):
    rng = random.Random(8)
    vecs = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(60)}
    vecs[3] = [0.0] * 4
    df = spark.createDataFrame(list(vecs.items()), "id int, v array<float>")
    queries = df.where("id < 20")
    out = retrieval.dense_top_k(queries, df, "id", "id", "v", k=5, queries_per_block=block, vectors_per_block=16).collect()
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    import numpy as np

    as_float = {i: [float(np.float32(x)) for x in v] for i, v in vecs.items()}
    for q in range(20):
        score = lambda d: round(sum(a * b for a, b in zip(as_float[q], as_float[d])) / norm(as_float[q]) / norm(as_float[d]), 6)
        expect = sorted(as_float, key=lambda d: (-score(d), d))[:5]
        assert [r.doc for r in sorted(out, key=lambda r: r["rank"]) if r.query == q] == expect


def test_dense_search_of_many_blocks_shuffles_no_scores(spark):
    """Groups of queries meet all vectors in one task each; repeated and null ids count as one query."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(1, 90)]
    rows += [(5, rows[20][1]), (5, rows[30][1]), (None, rows[2][1]), (None, rows[3][1]), (95, None), (96, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    out = retrieval.dense_top_k(df, df, "id", "id", "v", k=7, queries_per_block=10, vectors_per_block=16)
    plan = plan_of(out)
    assert "Window" not in plan and plan.count("Exchange") == 1
    unit = retrieval.unit_rows(pd.Series([r[1] for r in rows]), 4)
    scores = np.round(unit @ unit.T, 6) + 0.0
    expect = set()
    for query in {r[0] for r in rows}:
        pairs = [(-scores[i, j], rows[j][0] is not None, rows[j][0] or 0) for i, r in enumerate(rows) if r[0] == query for j in range(len(rows))]
        expect |= {(query, d if known else None, -s, n + 1) for n, (s, known, d) in enumerate(sorted(pairs)[:7])}
    got = [(r["query"], r["doc"], r["score"] + 0.0, r["rank"]) for r in out.collect()]
    assert set(got) == expect and len(got) == len(expect)


def test_pair_cosines_make_no_rows_of_terms(spark):
    """Pairs meet whole vectors: repeated pairs and terms, unknown and null documents, two tables."""
    left = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "b", 0.25), (2, "c", 1.0), (3, None, 1.0)], "doc int, term string, weight double")
    right = spark.createDataFrame([("x", "b", 2.0), ("x", "a", 1.0), ("y", "c", 3.0), ("y", "d", None)], "doc string, term string, weight double")
    rows = [(1, "x"), (1, "x"), (1, "y"), (2, "y"), (2, "z"), (3, "x"), (9, "y"), (None, "x"), (1, None)]
    pairs = spark.createDataFrame(rows, "t int, c string")
    out = retrieval.pair_cosines(pairs, left, right, "t", "c")
    value = {(1, "x"): 2.0, (2, "y"): 3.0}
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((*r, value.get(r, 0.0))) for r in rows)
    assert "term" not in "".join(x for x in plan_of(out).splitlines() if "Join" in x)
    # one table for both sides, and more candidates than one step takes
    many = spark.range(1, 2_500).select(F.col("id").cast("int").alias("doc"), F.explode(F.array(F.lit("a"), F.concat(F.lit("t"), F.col("id") % 7))).alias("term"), (F.col("id") / 10).alias("weight"))
    asked = many.where("doc > 1").select(F.lit(1).alias("t"), F.col("doc").alias("c")).distinct()
    got = {r.c: r.cosine for r in retrieval.pair_cosines(asked, many, many, "t", "c").collect()}
    assert len(got) == 2_498 and all(abs(v - c / 100 * (1 + (c % 7 == 1))) < 1e-9 for c, v in got.items())


def test_texts_are_dealt_once_for_all_that_goes_by_document(spark):
    docs = spark.createDataFrame([(1, "profit rose and rose"), (2, "the board met"), (2, "profit"), (None, "profit fell")], "id int, body string")
    plan = plan_of(retrieval.tfidf_weights(docs, "id", "body", min_df=0.0, max_df=1.0))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    index = retrieval.build_index(docs, "id", "body")
    assert plan_of(index.postings).count("Exchange hashpartitioning(doc") == 2 and "hashpartitioning(doc#" in plan_of(index.postings)
    assert "term" not in "".join(x for x in plan_of(index.postings).splitlines() if "Exchange" in x)


def test_excluded_pairs_are_made_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"profit rose word{i}") for i in range(6)], "id int, body string")
    left, right = spark.createDataFrame([(1, 7)], "query int, k int"), spark.createDataFrame([(7, 2)], "k int, doc int")
    given = []
    bounds = retrieval.score_bounds
    monkeypatch.setattr(retrieval, "score_bounds", lambda *args: given.append(args[5]) or bounds(*args))
    asked = spark.createDataFrame([(1, "profit word2")], "id int, body string")
    out = retrieval.search(retrieval.build_index(docs, "id", "body"), asked, "id", "body", cutoff=10, exclude=left.join(right, "k"))
    assert sorted(r.doc for r in out.collect()) == [0, 1, 3, 4, 5]
    assert "parquet" in plan_of(given[0]) and "Join" not in plan_of(given[0])


def test_products_of_vectors_are_bounded():
    import numpy as np

    rng = np.random.default_rng(4)
    queries, docs = rng.normal(size=(700, 3)), rng.normal(size=(3_000, 3))
    biggest = []
    best = retrieval._best
    try:
        retrieval._best = lambda scores, k: biggest.append(scores.size) or best(scores, k)
        found = retrieval.best_of_block(np.arange(700), queries, np.arange(3_000), docs, 4, 6)
    finally:
        retrieval._best = best
    assert max(biggest) <= 1 << 20 and sum(biggest) == 700 * 3_000
    assert (found["doc"].to_numpy().reshape(700, 4) == best(np.round(queries @ docs.T, 6), 4)).all()


def test_hard_negatives(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 6, 1)
    found_ = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(["q", "late", "old", "ok", "same"])] + [("lonely", "late", 1)], "query string, doc string, rank int")
    q_times = spark.createDataFrame([("q", t), ("lonely", t)], "query string, query_time timestamp")
    times = spark.createDataFrame(
        [("q", t), ("late", t + timedelta(1)), ("old", t - timedelta(60)), ("ok", t - timedelta(59)), ("same", t)], "doc string, doc_time timestamp"
    )
    picks = {retrieval.hard_negatives(found_, q_times, times, seed=s).first()["doc"] for s in range(12)}
    assert picks == {"ok", "same"}
    assert retrieval.hard_negatives(found_, q_times, times).count() == 1
    assert retrieval.hard_negatives(found_, q_times, times, first=1).first()["doc"] == "ok"


def test_row_pair_cosines(spark):
    df = spark.createDataFrame([(1, "profit rose", "profit rose"), (2, "profit rose", "board met"), (3, None, "x")], "id int, a string, b string")
    got = {r.id: round(r.cosine, 9) for r in retrieval.row_pair_cosines(df, "id", "a", "b", max_df=1.0).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


# ---- scoring -----------------------------------------------------------------------------------------
def test_native_and_batch_pair_scores_agree(spark):
    rows = [(0, "Profit rose today", "The profit rose"), (1, "It did not rise", "It did rise"), (2, "...", "a"), (3, "Été no", "été")]
    df = spark.createDataFrame(rows, "id int, article_sents string, press_release_sents string")
    native = scoring.lexical_pair_scores(scoring.token_features(scoring.token_features(df, "article_sents", "article"), "press_release_sents", "press_release"))
    batch = scoring.score_pairs(df, scoring.lexical_pair_scorer, partitions=2)
    assert "InPandas" not in plan_of(scoring.score_pairs(df))
    key = lambda d: {r.id: (r.entailment, r.neutral, r.contradiction) for r in d.collect()}
    assert key(native) == key(batch)
    assert key(native)[0][0] == 2 / 3 and key(native)[1][2] == 0.75 and key(native)[2] == (0.0, 1.0, 0.0)


def test_scorer_is_loaded_per_task_and_named(spark):
    def shout():
        return lambda a, b: [(1.0, 0.0, 0.0) for _ in a]

    df = spark.createDataFrame([("d", "s", 0, "h", "1")], "doc_idx string, article_sentence string, article_sent_idx int, archive_headline string, archive_headline_idx string")
    out = scoring.score_consistency(df, "shout", ["yes", "maybe", "no"], {"shout": shout}).first()
    assert out.model_prediction == "yes" and out.archive_headline_idx == "1"


def test_error_filter_keeps_parallel_lists(spark):
    good = "The board of the company met on Tuesday."
    df = spark.createDataFrame([(1, [good, "###### 1234 $$$$ 5555 %%%% 66", "a b c"], [["G"], ["J"], ["S"]]), (2, ["x"], [["x"]])], "id int, sent_lists array<string>, w array<array<string>>")
    out = scoring.filter_errors(df, words="w").collect()
    assert [(r.id, r.sent_lists, r.w, r.best_class) for r in out] == [(1, [good], [["G"]], ["Main"])]


def test_scores_regroup_to_the_same_lengths(spark):
    df = spark.createDataFrame([(i, ["s"] * i) for i in range(6)], "id int, s array<string>")
    counts = {r.doc_id: r.n for r in scoring.score_discourse(df, "id", "s").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: i for i in range(1, 6)}


def test_attribution_and_spans(spark):
    df = spark.createDataFrame([(1, ["Profit rose, Jane Doe said today.", "It fell."])], "id int, s array<string>")
    assert [r.attribution for r in scoring.attribute_sources(df, "id", "s").orderBy("sent_idx").collect()] == ["Jane Doe", ""]
    doc = "array<struct<head:string,sent:string,quote_type:string>>"
    rows = [(1, [("Jane; Bob", "Jane and Bob spoke", "TWEET"), (None, "It fell", None), ("Zed", "no one", "QUOTE")]), (2, [("speaker-1", "x", "QUOTE")])]
    got = scoring.source_spans(spark.createDataFrame(rows, f"id int, doc {doc}"), "id").collect()
    whole = "journalist passive-voice Jane and Bob spoke It fell no one"
    assert {(r.source, whole[r.start : r.end + 1], r.quote_type) for r in got} == {("Jane", "Jane", "SOCIAL MEDIA POST"), (" Bob", "Bob", "SOCIAL MEDIA POST")}


def test_coreference(spark):
    df = spark.createDataFrame([(1, ["Jane Doe spoke .", "She left."])], "id int, sent_lists array<string>")
    assert scoring.resolve_coreference(df).first()["coref_resolved_sents"] == ["Jane Doe spoke.", "Jane Doe left."]


def test_entities_with_gazetteer(spark):
    df = spark.createDataFrame([(1, "We met Acme Corp today. Then Bob left."), (2, "nothing")], "id int, t string")
    listed = spark.createDataFrame([("Acme Corp",)], "n string")
    got = {r.id: r.ents for r in scoring.extract_entities(df, "t", gazetteer=listed, row_id="id").collect()}
    assert got == {1: ["Acme Corp"], 2: []}


def test_summaries_take_the_first_documents(spark):
    df = spark.createDataFrame([(d, 0, "Main", "A b. C") for d in range(5)], "doc_id int, i int, l string, s string")
    out = scoring.summarise_groups(df, "doc_id", "l", "s", "i", first_docs=2).collect()
    assert {r.doc_id for r in out} == {0, 1} and out[0].summary == "A b."


def test_prompts(spark):
    ex = spark.createDataFrame([(2, "<p>Two é</p>", "n2"), (1, "One\n one", "n1")], "o int, r string, n string")
    block = scoring.example_block(ex, "o", "r", "n", template="{sentences} from {release}")
    targets = spark.createDataFrame([("T" * 2000,)], "r string")
    p = scoring.prompts(targets, "r", block, template="<{examples}>{other}<{release}>").first()["prompt"]
    assert p == "<n1 from One one\n\nn2 from  Two e >{other}<" + "T" * 2000 + ">"
    cut = scoring.prompts(targets, "r", scoring.example_block(ex, "o", "r", "n", first=1), release_chars=1000).first()["prompt"]
    assert "One one" in cut and "Two" not in cut and "T" * 1000 in cut and "T" * 1001 not in cut


def test_marked_pipeline(spark):
    df = spark.createDataFrame([("u", "a<NEW_SENT>b")], "url string, docs string")
    out = scoring.marked_sentences_pipeline().fit(df).transform(df).orderBy("sent_idx").collect()
    assert [(r.sentence, r.discourse_label) for r in out][0] == ("a", "Main") and len(out) == 2


# ---- evaluation and reports ------------------------------------------------------------------------------
def _pair_rows(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(40):
        y = i % 2
        labels.append((f"a{i}", "r", bool(y), bool(i % 3), bool(y and i % 3)))
        for j in range(3):
            for _ in range(4):
                rows.append((f"a{i}", "r", j, rng.random() * 0.3 + 0.6 * y, rng.random(), rng.random() * 0.3 + 0.6 * y))
    names = "article_url string, press_release_url string, y_true_q1 boolean, y_true_q2 boolean, y_true_both boolean"
    return spark.createDataFrame(rows, SENT), spark.createDataFrame(labels, names)


def test_parameter_search(spark):
    scores, labels = _pair_rows(spark)
    out = evaluate.parameter_search(scores, labels, "article_url", inner=[2], outer=[3], splits=1).collect()
    assert len(out) == 1 and out[0].mean_f1 > 0.9 and out[0].i_entailment == 2


def test_grid_equals_single_settings(spark):
    scores, _ = _pair_rows(spark)
    grid = {(r.article_url, r.score, r.inner_k, r.outer_k): r.value for r in evaluate.roll_up_grid(scores, [1, 3], [2]).collect()}
    for k in (1, 3):
        one = agg.two_level_scores(
            scores, level_1={"contradiction": ("top_k_mean", k), "entailment": ("top_k_mean", k), "neutral": ("bottom_k_mean", k)},
            level_2={"contradiction": ("top_k_mean", 2), "entailment": ("top_k_mean", 2), "neutral": ("median", None)},
        )
        for r in one.collect():
            for s in ("contradiction", "entailment", "neutral"):
                assert math.isclose(grid[r.article_url, s, k, 2], r[s])


def test_version_difference(spark):
    df = spark.createDataFrame([("r", 1, "s1", "A b. C d."), ("r", 2, "s2", "C d. E f."), ("q", 1, "s3", "X y.")], "r string, t int, s string, b string")
    got = {(x.change, x.sentence) for x in reports.version_difference(df, "r", "t", "s", "b").collect()}
    assert got == {("removed", "A b."), ("added", "E f.")}


def test_viewer_graph(spark):
    s = "article_url string, press_release_url string, article_idx int, article_sents string, press_release_idx int, press_release_sents string, entailment double, contradiction double"
    df = spark.createDataFrame([("a", "r", 0, '"x"', 0, "<p>y</p>", 0.9, 0.9), ("a", "r", 1, "z", 0, "<p>y</p>", 0.9, 0.1)], s)
    row = reports.viewer_graph(df).first()
    assert [(n.version, n.sent_idx, n.sentence) for n in row.nodes] == [("article", 0, "''x''"), ("article", 1, "z"), ("press_release", 0, "y")]
    assert [tuple(a) for a in row.arcs] == [(0, 0)]


def test_blacklist(spark):
    pages = spark.createDataFrame([("https://www.nytimes.com/a",), ("https://x.gov/a",), ("https://b.co.uk",)], "url string")
    rules = spark.createDataFrame([("ads.tracker.com",)], "host string")
    got = {r.domain for r in reports.domain_blacklist(pages, "url", extra=["wire"], social=["fb"], rules=rules).collect()}
    assert got == {"nytimes", "b", "wire", "fb", "tracker"}


def test_main_event_pairs(spark):
    rel = spark.createDataFrame([(1, "one"), (2, "two")], "id int, body string")
    sents = spark.createDataFrame([(1, 1, "B", "Main"), (1, 0, "A", "Main"), (2, 0, "C", "NA")], "id int, sent_idx int, sentences string, discourse_preds string")
    assert [tuple(r) for r in reports.main_event_pairs(rel, sents, "id", "body").collect()] == [(1, "one", "A B")]


def test_tokens_match_words_of_any_script(one):
    assert one(text.tokens(F.lit("Über-Größe, 漢字 x_1!"))) == ["über", "größe", "漢字", "x_1"]
