"""Learned abbreviations, and the rule that uses them, on planted texts."""

import random

import pytest

from tidings.operators.boundaries import abbreviations, sentence_starters, split_sentences, stop_counts


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    nouns = ["report", "market", "company", "river", "letter", "garden", "winter", "number", "answer", "window"]
    names = ["Smith", "Jones", "Miller", "Weber"]
    texts = []
    for _ in range(n):
        sents = []
        for _ in range(rng.randint(2, 6)):
            words = [rng.choice(nouns) for _ in range(rng.randint(3, 9))]
            words[rng.randrange(len(words))] = rng.choice(["Dr. " + rng.choice(names), "Acme Inc. of", "the U.S. trade", "J. " + rng.choice(names), "to", "by"])
            sents.append(rng.choice(["The", "However", "It"]) + " " + " ".join(words) + rng.choice([".", ".", ".", "!", "?"]))
        texts.append(" ".join(sents))
    return texts


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "id int, text string")
    known = abbreviations(stop_counts(docs, "text"))
    return docs, known, sentence_starters(docs, "text", known)


def test_counts(spark):
    docs = spark.createDataFrame([("Dr. No met (Dr. Who). no dr",), ("U.S. \"end.\"",), (None,), ("... 5. - a.",)], "text string")
    got = {r.word: (r.stopped, r.total) for r in stop_counts(docs, "text").collect()}
    assert got == {"dr": (2, 3), "no": (0, 2), "met": (0, 1), "who": (0, 1), "u.s": (1, 1), "end": (1, 1), "a": (1, 1)}


def test_abbreviations_and_starters_are_found(learned):
    _, known, starters = learned
    words = {r.word for r in known.collect()}
    assert {"dr", "inc", "u.s"} <= words and not words & {"report", "market", "company", "river", "to", "by"}
    assert {r.word for r in starters.collect()} == {"the", "however", "it"}


def test_rule(spark, learned):
    _, known, starters = learned
    texts = {
        1: "We met Dr. Smith. He left.\nThe U.S. Army won! Really? Yes.", 2: "J. K. Miller wrote. It sold.", 3: "Made by Acme Inc. However it failed. End.",
        4: None, 5: " ", 6: "no end", 7: "One. Two.  Three",
    }
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    out = {}
    for r in split_sentences(docs, ["id"], "text", known, starters).orderBy("id", "sent_idx").collect():
        assert r.sent_idx == len(out.setdefault(r.id, []))
        out[r.id].append(r.sentence)
    assert out == {
        1: ["We met Dr. Smith.", "He left.", "The U.S. Army won!", "Really?", "Yes."], 2: ["J. K. Miller wrote.", "It sold."],
        3: ["Made by Acme Inc.", "However it failed.", "End."], 6: ["no end"], 7: ["One.", "Two.", "Three"],
    }
    plain = split_sentences(docs, ["id"], "text", known).where("id = 3").orderBy("sent_idx").collect()
    assert [r.sentence for r in plain] == ["Made by Acme Inc. However it failed.", "End."]


def test_planted_corpus_is_cut_at_its_ends(spark, learned):
    docs, known, starters = learned
    assert split_sentences(docs, ["id"], "text", known, starters).count() == sum(
        len([w for w in t.split() if w in ("The", "However", "It")]) for t in corpus()
    )


def test_empty_tables(spark, learned):
    docs, known, starters = learned
    none = docs.limit(0)
    assert abbreviations(stop_counts(none, "text")).collect() == [] == sentence_starters(none, "text", known).collect()
    assert split_sentences(none, ["id"], "text", known, starters).collect() == []
    alone = spark.createDataFrame([(1, "A met Dr. No. End")], "id int, text string")
    assert split_sentences(alone, ["id"], "text", known.limit(0), starters.limit(0)).count() == 3


def test_texts_are_cut_once_for_all_joins(spark, monkeypatch):
    """What the joins read, to count keys and to join, is stored: no pattern runs again."""
    from conftest import plan_of
    from tidings.operators import boundaries

    plans, join = [], boundaries.salted_join
    monkeypatch.setattr(boundaries, "salted_join", lambda left, *a, **k: plans.append(plan_of(left)) or join(left, *a, **k))
    docs = spark.createDataFrame([(1, "He met Mr. Smith. They left.")], "id int, text string")
    known = spark.createDataFrame([("mr",)], "word string")
    out = boundaries.split_sentences(docs, ["id"], "text", known)
    assert sorted(r.sentence for r in out.collect()) == ["He met Mr. Smith.", "They left."]
    boundaries.sentence_starters(docs, "text", known).collect()
    assert len(plans) == 2 and not any("regexp_replace" in p for p in plans)
