"""Each stage on its own input against brute force, and the stages in a row."""

import pytest
from check import DATA
from test_decontaminate import brute as contamination
from test_near_dedup import brute as groups

import corpus_pipeline
from tidings.llm.language import has_letter

pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="the provided tables are not here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with nulls, blanks, repeated rows, and benchmark passages in odd places."""
    root = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    items = spark.read.parquet(str(DATA / "sf0.001" / "benchmark.parquet"))
    first, item = docs.orderBy("doc_id").first(), items.orderBy("item_id").first()["text"]
    extra = [
        (None, None, None, None, None), (9001, "", "en", "src1", 0), (9002, "123 !", None, None, 5), (9003, f"{first['text']} more", "en", None, 9),
        (first["doc_id"], first["text"], first["lang"], first["source"], first["n_chars"]), (9004, "Before. " + item.upper() + " After.", "en", "src2", 9),
        (None, "a text without an id in plain words of the english kind", "en", None, 1),
    ]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(str(root / "documents.parquet"))
    items.write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept[name] = (before, after)
        assert docs.columns[: len(columns)] == columns and (name == "sharding" or docs.columns == columns)
    before, after = kept["language_id"]
    assert all(has_letter((t or "").encode()) for _, t in after)
    assert sorted(after, key=str) == sorted([x for x in before if has_letter((x[1] or "").encode())], key=str)  # clean documents stay
    before, after = kept["near_dedup"]
    assert sorted((i for i, _ in after), key=str) == sorted({i for i, n, c, k in groups(before) if k}, key=str)
    assert len(after) < len(before)
    before, after = kept["decontamination"]
    assert after == [x for x, hits in zip(before, contamination([t for _, t in before], items)) if not hits[1]] and len(after) < len(before)
    before, after = kept["mixing"]
    assert set(after) <= set(before) and 0.6 * len(before) < len(after) <= len(before)
    before, after = kept["sharding"]
    assert sorted(after, key=str) == sorted(before, key=str)
    assert docs.groupBy("shard").count().count() > 8
