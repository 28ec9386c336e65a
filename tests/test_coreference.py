"""References by sieves: one fixture per sieve, whole texts, and the cases that must not break anything."""

import pytest
from pyspark.sql import functions as F

from tidings.operators import coreference as c


def links(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    rows = c.resolve_mentions(c.sentence_rows(docs, "id", "body")).collect()
    return {(r["doc"], r["sent_idx"], r["mention"], r["sieve"], r["referent"]) for r in rows}


@pytest.mark.parametrize("text, expected", [
    ("Anna Smith spoke. Later Smith left.", {(0, 1, "Later Smith", None, None)}),
    ("Anna Smith spoke and then Smith left.", {(0, 0, "Smith", "suffix", "Anna Smith")}),
    ("The plan of Acme Rubber Corp worked. So says Acme too.", {(0, 1, "Acme", "prefix", "Acme Rubber Corp")}),
    ("The World Health Organization met, and WHO spoke.", {(0, 0, "WHO", None, None)}),
    ("He met World Health Organization staff, and WHO spoke.", {(0, 0, "WHO", "acronym", "World Health Organization")}),
    ("We saw Mrs Anna Jones. He left. She stayed.", {(0, 2, "She", "pronoun", "Mrs Anna Jones")}),
    ("We saw Acme Group near Anna Jones. It grew while she slept.", {(0, 1, "It", "pronoun", "Anna Jones"), (0, 1, "she", "pronoun", "Anna Jones")}),
    ("We saw Dr Jones near Acme Group. He said it grew.", {(0, 1, "He", "pronoun", "Dr Jones"), (0, 1, "it", "pronoun", "Acme Group")}),
    ("It rained. They slept.", set()),
])
def test_sieves(spark, text, expected):
    wanted = {x for x in expected if x[3] is not None}
    assert links(spark, text) >= wanted
    if not wanted:
        assert links(spark, text) == set()


def test_chain_of_short_forms_ends_at_the_longest_name(spark):
    found = links(spark, "Here is Anna Maria Smith Jones and Smith Jones and also Jones.")
    assert {(m, r) for _, _, m, _, r in found} == {("Smith Jones", "Anna Maria Smith Jones"), ("Jones", "Anna Maria Smith Jones")}
    # a prefix of what is itself a suffix
    found = links(spark, "see Big Acme Rubber Corp then Acme Rubber Corp then Acme here")
    assert ("Acme", "Big Acme Rubber Corp") in {(m, r) for _, _, m, _, r in found}


def test_documents_do_not_mix(spark):
    assert links(spark, "We met Anna Smith here.", "then Smith left and she slept") == set()


def test_sentences_are_spelled_out(spark):
    docs = spark.createDataFrame([(1, "We met Anna Smith here, (twice). She left; Smith slept!", 9)], "id long, body string, new int")
    assert [r["sentence"] for r in c.resolved_texts(docs, "id", "body").orderBy("sent_idx").collect()] == [
        "We met Anna Smith here, (twice).", "Anna Smith left; Anna Smith slept!"]
    only = c.resolved_texts(docs, "id", "body", sieves=["pronoun"]).orderBy("sent_idx").collect()
    assert only[1]["sentence"] == "Anna Smith left; Smith slept!"


def test_edges(spark):
    rows = [(None, "We met Anna Smith. She left."), (3, None), (4, ""), (5, "  "), (6, "We met Anna Smith. She left."), (6, "We met Anna Smith. She left."),
            (7, "We met Anna Smith. She left."), (7, "We saw Bob Brown here. He slept.")]
    docs = spark.createDataFrame(rows, "id long, body string")
    out = c.resolved_texts(docs, "id", "body").collect()
    assert len(out) == 10  # no sentence is lost or doubled
    assert sum(r["sentence"] == "Anna Smith left." for r in out if r["doc"] in (None, 6)) == 3
    assert c.resolved_texts(docs.where("false"), "id", "body").count() == 0


def test_very_long_runs_stay_linear(spark):
    """A text of capitalised words only is one name; it has a handful of short forms, and no word is left out."""
    body = " ".join(f"Word{i}" for i in range(60_000)) + " and then Word59999 left."
    docs = spark.createDataFrame([(1, body)], "id long, body string")
    forms = docs.select(F.size(c.short_forms(F.lit(" ".join(["Aa"] * 5_000)))).alias("n")).first()["n"]
    assert forms == 2 * c.SHORT + 1
    out = c.resolved_texts(docs, "id", "body").first()["sentence"]
    assert len(out) > 2 * body.index(" and") - 100
