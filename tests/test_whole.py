"""Queries on tables beyond what the given ones hold: nothing is cut."""

import __spark_entry__ as entry
from tidings.operators.joins import pair_with_candidates
from tidings.operators.predicates import text_length_between

QUERIES = entry.queries()


def test_very_long_documents_stay(spark, tmp_path):
    rows = [(1, "a" * 1_000_001, "en", "src0", 1), (2, "short", "en", "src0", 1), (3, "", "en", "src0", 1), (4, None, "en", "src0", 1), (5, "a" * 1_000_001, "de", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["select_rename_filter"](spark, str(tmp_path)).collect()
    assert sorted(r["article_id"] for r in found) == [1, 2]
    assert [r["doc_id"] for r in text_length_between(docs, "text", high=999_999).collect()] == [2]


def test_long_conversations_meet_all_their_turns(spark, tmp_path):
    rows = [(1, i, "user" if i % 2 else "assistant", f"word{i // 2} common") for i in range(60)]
    rows += [(2, 0, "user", "alone"), (3, 0, "assistant", "alone"), (None, 0, "user", "x"), (None, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["consistency_scores"](spark, str(tmp_path)).collect()
    want = {(1, i, j): 1.0 if i // 2 == j // 2 else 0.5 for i in range(1, 60, 2) for j in range(0, 60, 2)}
    assert len(found) == 900 and {tuple(r)[:3]: r["model_prediction"] for r in found} == want


def test_pairs_of_a_hot_document_are_dealt(spark):
    a = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(40 if d == 1 else 3)] + [(None, 0)], "doc_id long, i long")
    b = spark.createDataFrame([(d, i) for d in (1, 3) for i in range(30)] + [(2, 0), (None, 0)], "doc_id long, j long")
    want = sorted([(1, i, j) for i in range(40) for j in range(30)] + [(2, i, 0) for i in range(3)])
    for hot_rows in (100, 10_000):
        assert sorted(tuple(r) for r in pair_with_candidates(a, b, hot_rows=hot_rows).collect()) == want
