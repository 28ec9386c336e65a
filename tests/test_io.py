import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidings.plans import combine
from tidings.plans.storage import materialize, work_root
from tidings.sources import readers, writers
from tidings.streaming import ingest


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"u":1}\nbad\n{"u":2}\n')
    assert readers.read_jsonl(spark, str(tmp_path), "u int").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path), "u int", tolerant=False).collect()


def test_truncated_gzip_gives_its_readable_part(spark, tmp_path):
    lines = "".join(json.dumps({"u": i, "pad": str(hash(str(i)))}) + "\n" for i in range(20_000))
    whole = gzip.compress(lines.encode())
    (tmp_path / "a.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    n = readers.read_jsonl(spark, str(tmp_path), "u int").where("u is not null").count()
    assert 0 < n < 20_000
    assert 0 < readers.count_readable_lines(spark, str(tmp_path)).first()["n"] < 20_000


def test_raw_and_linked_articles(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"article_url":"u","article_html":"x"}\n{"article_url":"v","html":"y"}\n')
    assert {r.html for r in readers.read_raw_articles(spark, str(tmp_path)).collect()} == {"x", "y"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text('{"article_url":"u","links":[]}\n{"article_url":"v","links":[{"href":"h"}]}\n')
    assert [r.article_url for r in readers.read_linked_articles(spark, str(tmp_path / "p")).collect()] == ["v"]


def test_annotation_files(spark, tmp_path):
    for split in ("train/x", "validation"):
        d = tmp_path / split
        d.mkdir(parents=True)
        (d / "n1.txt").write_text("URL http://a.org\nH A head\nS1 First one.\nS2 Second\nS10 Tenth")
        (d / "n1.ann").write_text("T1\tMain extra\tS1\nT2\tSpeech x\tS2\nbroken\nT3\tNA\tS10")
    got = readers.read_annotation_pairs(spark, [f"{tmp_path}/*/*.txt", f"{tmp_path}/*/*/*.txt"], [f"{tmp_path}/*/*.ann", f"{tmp_path}/*/*/*.ann"])
    rows = {(r.key, r.sent_id): (r.label, r.sentence, r.url, r.headline) for r in got.collect()}
    assert rows["train/x/n1", "S1"] == ("Main", "First one.", "http://a.org", "A head")
    assert rows["validation/n1", "S10"][0] == "NA" and len(rows) == 4


def test_outlets_from_names(spark, tmp_path):
    for name in ("wsj-articles-parsed.jsonl", "fox-business-articles-parsed.jsonl", "other.jsonl"):
        (tmp_path / name).write_text('{"u":1}\n')
    df = readers.read_many(spark, str(tmp_path), "json", "u int", name_parts=["wsj", "fox"], outlet=True)
    assert {r.source for r in df.collect()} == {"wsj", "fox-business"}


def test_dated_reads_prune_folders(spark, tmp_path):
    from conftest import plan_of

    df = spark.range(72).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    writers.write_by_date(df, str(tmp_path / "a"), "ts")
    out = readers.read_date_partitions(spark, str(tmp_path / "a"), "2024-01-02", "2024-01-02")
    assert out.count() == 24 and "PartitionFilters: [isnotnull(date" in plan_of(out)


def test_cached_stage_and_refresh(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "s")
    assert writers.cached_stage(spark, path, compute).count() == 1
    assert writers.cached_stage(spark, path, compute).count() == 1
    assert writers.cached_stage(spark, path, compute, refresh=True).count() == 2 and len(calls) == 2


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(3), "x")
    assert spark.conf.get("spark.checkpoint.dir") == work_root(spark)
    assert all(work_root(spark) in f for f in df.inputFiles()) and df.count() == 3


def test_two_way_and_keyed_json(spark, tmp_path):
    writers.write_two_way(spark.range(10), f"{tmp_path}/a", f"{tmp_path}/b", lambda d: d.where("id < 3"))
    assert (spark.read.json(f"{tmp_path}/a").count(), spark.read.json(f"{tmp_path}/b").count()) == (10, 3)
    graph = spark.createDataFrame([("a", "r", [(1,)], [])], "article_url string, press_release_url string, nodes array<struct<i:int>>, arcs array<int>")
    writers.write_viewer_json(graph, f"{tmp_path}/v")
    assert json.loads(spark.read.text(f"{tmp_path}/v").first()["value"]) == {"a | r": {"nodes": [{"i": 1}], "arcs": []}}


def test_incremental_ingest_with_event_time(spark, tmp_path):
    schema = "article_url string, at timestamp"
    for i, url in enumerate(["a", "b", "a"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"article_url": url, "at": "2024-01-01T00:00:00"}))
        stream = ingest.new_articles(ingest.stream_files(spark, str(tmp_path / "in"), schema), time="at")
        ingest.incremental_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.article_url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_extraction_skips_what_is_there(spark):
    raw = spark.createDataFrame([("u", '<a href="https://x.org/press">p</a>'), ("v", "<p>q</p>")], "article_url string, html string")
    out = combine.extract_articles(raw, spark.createDataFrame([("v",)], "article_url string"))
    assert [(r.article_url, r.links[0].is_press_release) for r in out.collect()] == [("u", True)]
    assert combine.release_articles(combine.extract_articles(raw)).count() == 1


def test_sql_reader_and_criteria(spark):
    from tidings.operators.predicates import match_criteria

    out = readers.read_sql(spark, "SELECT max(id) AS m FROM numbers", numbers=spark.range(5))
    assert out.first()["m"] == 4
    assert match_criteria(spark.range(5).withColumn("b", F.lit("x")), id=3, b="x").count() == 1


def test_annotation_files_share_folders(spark, tmp_path, monkeypatch):
    """150 conversations, one of them without an id, need no folder each; a table without rows gives none."""
    import workload
    from workload import staging

    monkeypatch.setattr(staging, "_path", lambda t, label: str(tmp_path / label))
    rows = [(i or None, turn, role, f"said  {i}\n{turn}") for i in range(150) for turn, role in enumerate(["system", "user"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in" / "conversations.parquet"))
    got = workload.QUERIES["annotation_pairs"](spark, str(tmp_path / "in")).collect()
    assert sorted((r.conv_id or 0, r.sent_id, r.label, r.sentence) for r in got) == [(i, "S2", "user", f"said {i} 1") for i in range(150)]
    files = [p for p in (tmp_path / "annotated").rglob("*") if p.is_file()]
    assert len(files) == 300 and len({p.parent for p in files}) <= 128

    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    monkeypatch.setattr(staging, "_path", lambda t, label: f"file://{tmp_path}/empty")
    assert workload.QUERIES["annotation_pairs"](spark, str(tmp_path / "none")).count() == 0


def test_names_that_make_no_file_are_errors(spark, tmp_path):
    for name in (None, "", "a/b", "_a", ".a"):
        with pytest.raises(Exception, match="no file can be written"):
            writers.write_named_texts(spark.createDataFrame([(name, "x")], "k string, v string"), str(tmp_path / "files"), "k", "v", ".txt")
