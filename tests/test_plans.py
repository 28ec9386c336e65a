import random
from datetime import datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tidings.functions import text
from tidings.operators import joins
from tidings.operators import windows as win
from tidings.plans import asof, linkage, skew
from tidings.plans.scan import segmented_scan
from tidings.plans.shape import hold, unpack

PAIRING = ("BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(1000), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, v int, id int")


def test_split_running_sum_equals_the_window(skewed):
    split = skew.running_sum(skewed, ["k"], ["v", "id"], F.col("v").cast("long"), "s", hot_rows=50)
    plain = skew.running_sum(skewed, ["k"], ["v", "id"], F.col("v").cast("long"), "s")
    assert split.count() == 3000 and split.exceptAll(plain).count() == 0


def test_global_row_numbers(skewed):
    out = skew.row_numbers(skewed, [F.desc("v"), "id"], name="rn").orderBy("rn").collect()
    assert [r.rn for r in out] == list(range(1, 3001))
    assert [(-r.v, r.id) for r in out] == sorted((-r.v, r.id) for r in out)


def test_null_keys_in_a_split(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [(1, i) for i in range(5)], "k int, id int")
    out = skew.row_numbers(df, ["id"], ["k"], hot_rows=10).groupBy("k").agg(F.max("rn").alias("m")).collect()
    assert {r.k: r.m for r in out} == {None: 30, 1: 5}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_join(spark, skewed, how):
    right = spark.createDataFrame([(k, f"r{k}{c}") for k in range(0, 60, 2) for c in "ab"], "k int, w string")
    salted = skew.salted_join(skewed, right, ["k"], how, hot_rows=100)
    plain = skewed.join(right, ["k"], how).select(*salted.columns)
    assert salted.exceptAll(plain).count() == plain.exceptAll(salted).count() == 0


def test_salted_join_spreads_the_hot_key(spark, skewed):
    right = spark.createDataFrame([(0, "x")], "k int, w string")
    salts = skew.hot_keys(skewed, ["k"], 100).collect()
    assert [(r.k, r._shares) for r in salts] == [(0, 10)]
    with pytest.raises(ValueError, match="right"):
        skew.salted_join(skewed, right, ["k"], "right")


def test_top_rows_cut_before_the_shuffle(skewed):
    plan = plan_of(skew.top_rows(skewed, ["k"], ["v", "id"], 3))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_unpack_evaluates_once(spark):
    df = spark.createDataFrame([("A b. C",), (None,), ("",)], "t string")
    out = unpack(df, [], text.sentences(F.col("t")), "s", "i")
    assert [(r.i, r.s) for r in out.collect()] == [(0, "A b."), (1, "C")]
    assert plan_of(out).count("regexp_replace") == 1
    held = hold(df, n=F.length(text.transliterate(F.col("t")))).where("n > 1")
    assert [r.n for r in held.collect()] == [6] and plan_of(held).count("translate") <= plan_of(held.drop("n")).count("translate") + 2


# ---- as-of ------------------------------------------------------------------------------------
def _moments(spark, n, seed):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), base + timedelta(minutes=rng.randrange(4000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, k int, t timestamp")


@pytest.mark.parametrize(("reverse", "inclusive"), [(False, False), (True, True), (True, False), (False, True)])
def test_last_before_equals_brute_force(spark, reverse, inclusive):
    probes, pdf = _moments(spark, 150, 1)
    facts, fdf = _moments(spark, 120, 2)
    out = asof.last_before(pdf, fdf.select("k", F.col("t").alias("ft"), F.col("id").alias("f")), ["k"], "t", "ft", "f",
                           reverse=reverse, inclusive=inclusive)
    got = {r.id: r.found for r in out.collect()}
    for i, k, t in probes:
        ok = lambda ft: ft == t and inclusive or (ft > t if reverse else ft < t)
        hits = [(ft, f) for f, fk, ft in facts if fk == k and ok(ft)]
        best = None
        if hits:
            when = min(hits)[0] if reverse else max(hits)[0]
            best = min(f for ft, f in hits if ft == when)
        assert got[i] == best


def test_prior_coverage_fixture(spark):
    day = lambda s: datetime.fromisoformat(s)
    rows = [
        ("a", day("2024-03-31 00:00:00"), "k"), ("out", day("2024-03-01 00:00:00"), "k"), ("in", day("2024-03-01 00:01:00"), "k"),
        ("same", day("2024-03-31 00:00:00"), "k"), ("other", day("2024-03-20 00:00:00"), "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, ts timestamp, key string")
    got = joins.prior_coverage(df).where("doc_id = 'a'").collect()
    assert [(r.archive_id, r["rank"]) for r in got] == [("in", 1)]


@pytest.mark.parametrize("newest", [2, 20])
def test_prior_coverage_equals_brute_force(spark, newest):
    rng = random.Random(5)
    base = datetime(2024, 1, 1)
    times = {d: base + timedelta(hours=rng.randrange(0, 24 * 60, 6)) for d in range(120)}
    keys = {d: {rng.choice("aaabcd") for _ in range(rng.randrange(1, 4))} for d in times}
    rows = [(d, times[d], k) for d in times for k in keys[d]]
    arts = spark.createDataFrame([r for r in rows if r[0] % 2 == 0], "doc_id int, ts timestamp, key string")
    arch = spark.createDataFrame(rows, "doc_id int, ts timestamp, key string")
    out = joins.prior_coverage(arts, arch, newest=newest)
    expected = set()
    for d in [d for d in times if d % 2 == 0]:
        hits = [
            o for o in times
            if o != d and keys[o] & keys[d] and times[d] - timedelta(days=30) < times[o] < times[d]
        ]
        hits.sort(key=lambda o: (-times[o].timestamp(), o))
        expected |= {(d, o, i + 1) for i, o in enumerate(hits[:newest])}
    assert {tuple(r) for r in out.collect()} == expected
    assert not any(p in plan_of(out) for p in PAIRING)


@pytest.mark.parametrize(("sort_by", "mode", "expected"), [
    ("past", "time", "20200101000000"), ("future", "time", "20200601000000"), ("nearest", "time", "20200601000000"),
])
def test_nearest_capture(spark, sort_by, mode, expected):
    stamps = [("20200101000000", "200"), ("20200301000000", "-"), ("20200601000000", "200")]
    caps = spark.createDataFrame([("u", s, c) for s, c in stamps], "u string, s string, c string").withColumn(
        "at", F.to_timestamp("s", "yyyyMMddHHmmss")
    )
    target = spark.createDataFrame([("u", datetime(2020, 5, 1))], "u string, t timestamp")
    out = joins.nearest_capture(target, caps, ["u"], "t", "at", "s", sort_by, mode, status="c")
    assert out.first()["capture"] == expected


def test_nearest_capture_by_digits(spark):
    target = spark.createDataFrame([("u", datetime(2020, 1, 1))], "u string, t timestamp")
    caps = spark.createDataFrame(
        [("u", datetime(2019, 12, 31, 23, 59, 59), "before"), ("u", datetime(2020, 1, 8), "after")], "u string, at timestamp, v string"
    )
    by = lambda mode: joins.nearest_capture(target, caps, ["u"], "t", "at", "v", "nearest", mode).first()["capture"]
    assert by("time") == "before" and by("digits") == "after"


# ---- entities and pairs -----------------------------------------------------------------------------
def test_entity_overlap_fixture(spark):
    docs = lambda rows: joins.entity_rows(spark.createDataFrame(rows, "d string, e array<string>"), "d", "e")
    out = joins.entity_overlap(docs([("T", ["a", "b", None])]), docs([("X", ["b", "c"]), ("Y", ["a"]), ("Z", ["c", None])]))
    assert {tuple(r) for r in out.collect()} == {("T", "X"), ("T", "Y")}
    assert not any(p in plan_of(out) for p in PAIRING)


def test_entity_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: {i: {rng.choice("abcdefghij") for _ in range(rng.randrange(4))} for i in range(n)}
    a, b = make(40), make(50)
    rows = lambda d: joins.entity_rows(spark.createDataFrame([(i, sorted(s)) for i, s in d.items()], "d int, e array<string>"), "d", "e")
    expected = {(i, j) for i in a for j in b if a[i] & b[j]}
    for hot in (5, 1_000):
        assert {tuple(r) for r in joins.entity_overlap(rows(a), rows(b), hot_rows=hot).collect()} == expected
    cos = {(r.target, r.archive): r.cosine for r in joins.entity_cosine(rows(a), rows(b)).collect()}
    assert all(abs(cos[i, j] - len(a[i] & b[j]) / (len(a[i]) * len(b[j])) ** 0.5) < 1e-9 for i, j in expected)


@pytest.mark.parametrize("hot", [2, 1_000])
def test_pair_sentences(spark, hot):
    docs = spark.createDataFrame([("A", ["p", "q", "p"]), ("B", ["x"]), ("R", ["r"])], "url string, s array<string>")
    mapping = spark.createDataFrame([("A", "R"), ("A", "R"), ("B", "R")], "article_url string, press_release_url string")
    rows = lambda p: joins.sentence_rows(docs, "url", F.col("s"), p)
    out = joins.pair_sentences(mapping, rows("article"), rows("press_release"), hot_rows=hot)
    got = {(r.article_url, r.article_idx, r.article_sents, r.press_release_idx, r.press_release_sents) for r in out.collect()}
    assert got == {("A", 0, "p", 0, "r"), ("A", 1, "q", 0, "r"), ("B", 0, "x", 0, "r")}


def test_best_scores_give_the_same_roll_up(spark):
    from tidings.operators.aggregates import two_level_scores

    words = "acme not said profit rose fell sharply today board".split()
    rng = random.Random(9)
    sent = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))).capitalize() + "."
    docs = lambda n, m: spark.createDataFrame([(i, " ".join(sent() for _ in range(rng.randrange(1, m)))) for i in range(n)], "id int, text string")
    arts, rels = docs(12, 15), docs(4, 6)
    mapping = arts.select(F.col("id").alias("article_url")).join(rels.select(F.col("id").alias("press_release_url")), F.expr("article_url % 2 = press_release_url % 2"))
    a = linkage.sentence_features(arts, "id", "text", "article")
    r = linkage.sentence_features(rels, "id", "text", "press_release")
    from tidings.operators.scoring import lexical_pair_scores

    full = two_level_scores(lexical_pair_scores(joins.pair_sentences(mapping, a, r)))
    best = two_level_scores(linkage.best_scores(mapping, a, r, 3, chunk=4))
    key = lambda df: {(x.article_url, x.press_release_url): tuple(round(x[c], 9) for c in ("contradiction", "entailment", "neutral")) for x in df.collect()}
    assert key(full) == key(best) and len(key(full)) == mapping.count()


def test_new_on_either_side(spark):
    s = "article_url string, press_release_url string"
    pairs = spark.createDataFrame([("a", "r"), ("a", "new"), ("new", "r"), ("b", "r")], s)
    seen = spark.createDataFrame([("a", "r"), ("b", "q")], s)
    assert {tuple(r) for r in joins.new_on_either_side(pairs, seen).collect()} == {("a", "new"), ("new", "r")}


def test_captures_cannot_multiply_articles(spark):
    arts = spark.createDataFrame([("com,wsj)/a",), ("com,zzz)/b",)], "article_url string")
    caps = spark.createDataFrame([("https://www.wsj.com/a", "20200102000000"), ("https://www.wsj.com/a", "20200101000000"), ("x", "Not Found")], "url string, timestamp string")
    amap = spark.createDataFrame([("com,wsj)/a", "com,zzz)/b")], "target_article_url string, archival_url string")
    got = {r.article_url: r for r in joins.attach_capture_times(arts, caps, amap).collect()}
    assert got["com,wsj)/a"].timestamp == datetime(2020, 1, 1) and got["com,wsj)/a"].is_press_release_article
    assert got["com,zzz)/b"].timestamp is None and got["com,zzz)/b"].is_archival_article
    assert [r.article_url for r in joins.unknown_crawl_prefixes(arts).collect()] == ["com,zzz)/b"]


def test_archive_lists_are_whole_or_an_error(spark):
    pairs = spark.range(25).select(F.lit("T").alias("target"), F.col("id").cast("string").alias("archive"))
    lists = joins.archive_lists(pairs).collect()
    assert len(lists) == 1 and sorted(int(x) for x in lists[0].archive_list) == list(range(25))
    with pytest.raises(Exception, match="a list of .* bytes"):
        joins.archive_lists(pairs, list_bytes=50).collect()


# ---- windows ---------------------------------------------------------------------------------------------
def test_round_robin(spark):
    out = win.round_robin(spark.range(5), ["id"], 2).orderBy("id").collect()
    assert [r.worker for r in out] == [0, 1, 0, 1, 0]


def test_token_budget(spark):
    df = spark.createDataFrame([("d", 0, 5000), ("d", 1, 3000), ("d", 2, 500)], "d string, i int, n int")
    assert sorted(r.i for r in win.within_token_budget(df, "d", "i", F.col("n")).collect()) == [0, 1]


def test_last_versions_need_a_second_one(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("s", 1, "c")], "r string, t int, id string")
    assert [x.id for x in win.last_versions(df, "r", "t", "id").collect()] == ["b"]
    assert {x.id for x in win.first_versions(df, "r", "t", "id").collect()} == {"a", "c"}


def test_lists_are_whole_or_an_error(spark):
    from tidings.operators import aggregates as agg

    df = spark.createDataFrame([(1, i) for i in range(23)] + [(2, 5), (None, 1)], "k int, v int")
    out = agg.ordered_lists(df, "k", "v", "v")
    assert out.columns == ["k", "v"]
    assert {r.k: r.v for r in out.collect()} == {1: list(range(23)), 2: [5], None: [1]}
    with pytest.raises(Exception, match="a list of .* bytes"):
        agg.ordered_lists(df, "k", "v", "v", list_bytes=100).collect()


def test_bridges_never_multiply(spark):
    from tidings.operators.reports import star_report

    facts = spark.createDataFrame([(1,), (2,)], "k int")
    bridge = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(5)], "k int, v int")
    out = star_report(facts, {}, {"a": (bridge, "k", "v", "v"), "b": (bridge, "k", "v", "v")}).collect()
    assert sorted(tuple(r) for r in out) == [(k, "0,1,2,3,4", "0,1,2,3,4") for k in (1, 2)]


@pytest.mark.parametrize("how", [{}, {"reverse": True}, {"inclusive": True}])
def test_null_keys_match_nothing(spark, how):
    at = lambda h: datetime(2024, 1, 1, h)
    probes = spark.createDataFrame([(None, 1, at(12)), ("a", 1, at(12)), ("a", None, at(12)), ("b", 1, None)], "k string, j int, t timestamp")
    facts = spark.createDataFrame([(None, 1, at(11), "x"), (None, 1, at(13), "x"), ("a", 1, at(11), "y"), ("a", 1, at(13), "z"), ("a", None, at(11), "x"), ("b", 1, None, "x")], "k string, j int, u timestamp, p string")
    found = {(r.k, r.j): r.found for r in asof.last_before(probes, facts, ["k", "j"], "t", "u", "p", **how).collect()}
    assert found == {(None, 1): None, ("a", 1): "z" if "reverse" in how else "y", ("a", None): None, ("b", 1): None}


@pytest.fixture
def pieces(spark):
    """Sorts into many pieces, as on a cluster."""
    settings = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
@pytest.mark.parametrize("hot", [True, False])
def test_segmented_scan_equals_brute_force(spark, pieces, keys, hot):
    rng = random.Random(8)
    pick = lambda: rng.choice(["a"] * 40 + ["b", None]) if hot else rng.choice("abcdefgh")
    rows = [(i, pick(), rng.choice([0, None]), rng.randrange(50), rng.choice([None, None, i]), rng.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, j int, t int, p int, n int")
    out = segmented_scan(df, keys, ["t", "id"], last={"found": F.col("p")}, total={"sum": F.col("n")})
    assert out.columns == [*df.columns, "found", "sum"]
    expected = {}
    for i, k, j, t, _, _ in rows:
        before = [r for r in rows if r[1] == k and (len(keys) == 1 or r[2] == j) and (r[3], r[0]) <= (t, i)]
        facts = [(r[3], r[0], r[4]) for r in before if r[4] is not None]
        expected[i] = (max(facts)[2] if facts else None, sum(r[5] or 0 for r in before))
    assert {r.id: (r.found, r.sum) for r in out.collect()} == expected
    assert segmented_scan(df.limit(0), keys, ["t"], total={"sum": F.col("n")}).collect() == []


def test_one_key_is_many_tasks(spark, pieces):
    line = spark.range(7_000).select(F.lit("only").alias("k"), F.col("id").alias("t"))
    out = segmented_scan(line, ["k"], ["t"], total={"n": F.lit(1)})
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 5_000
    assert out.where("n <> t + 1").isEmpty()


def test_lookups_shuffle_little(spark):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "doc_id int, key string, ts timestamp")
    caps = spark.createDataFrame([("a", datetime(2024, 1, 1), "v")], "key string, at timestamp, v string")
    exchanges = lambda out: plan_of(out).count("Exchange ")
    assert exchanges(joins.prior_coverage(df)) <= 10
    for side in ("past", "future", "nearest"):
        assert exchanges(joins.nearest_capture(df, caps, ["key"], "ts", "at", "v", side)) <= 10


@pytest.mark.parametrize("how", ["left", "left_anti", "inner"])
def test_rows_without_a_key_are_spread(spark, how):
    left = spark.createDataFrame([(i, None if i % 3 else "hot") for i in range(300)] + [(300, "cold")], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), (None, 3)], "k string, v int")
    out = skew.salted_join(left, right, ["k"], how, hot_rows=20)
    plain = left.join(right, "k", how).select(out.columns)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_numbers_of_sorted_rows(spark, pieces):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    out = win.stand_numbers(rows.orderBy(F.desc("v")), "n")
    assert out.columns == ["v", "n"] and out.where("n <> 500 - v").isEmpty() and out.count() == 500
    assert win.stand_numbers(rows.limit(0).orderBy("v")).collect() == []
