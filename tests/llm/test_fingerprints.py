"""Recovered differences and likeness against sets of paragraphs."""

import hashlib
import random

from tidings.llm.fingerprints import Fingerprint, difference, fingerprints, likeness, paragraph_digests


def brute(rows):
    rows = sorted((i is not None, i or 0, t or "") for i, t in rows)
    out = []
    for k, (_, _, t) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][2], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]

        def near(a, b):
            a, b = set(paragraph_digests(a.encode())), set(paragraph_digests(b.encode()))
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after)))
    return sorted(out)


def test_against_sets(spark):
    r = random.Random(4)
    line = lambda: " ".join(f"w{r.randint(0, 40)}é" for _ in range(r.randint(1, 6))) + r.choice([".", "\n", "! ", ""])
    rows = [(r.randint(-50, 400), "".join(line() for _ in range(r.randint(0, 40)))) for _ in range(120)]
    rows += [(None, "a"), (None, "b.\nc"), (3, None), (3, "x" * 9), (3, "x" * 9), (7, "é😀" * 20)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, bucket int")
    for size in (5, 1_000):
        found = fingerprints(docs, rows_per_bucket=size).collect()
        assert sorted((x["n_chars"], x["edited_sha256"], x["near_edited"], x["near_next"]) for x in found) == brute(rows)
    by_text = {}
    for x in found:
        by_text.setdefault((x["doc_id"], x["n_chars"]), set()).add(x["fingerprint"])
    assert len(by_text[(3, 9)]) == 1


def test_differences_are_recovered():
    for only_a, only_b, common in [(0, 0, 5), (1, 0, 0), (3, 4, 50), (200, 90, 10), (0, 1000, 3)]:
        lines = [b"line %d" % i for i in range(only_a + only_b + common)]
        a, b = Fingerprint(b"\n".join(lines[: only_a + common])), Fingerprint(b"\n".join(lines[only_a:]))
        left, right = difference(a, b)
        digests = [set(paragraph_digests(b"\n".join(x))) for x in (lines[: only_a + common], lines[only_a:])]
        assert set(left) == digests[0] - digests[1] and set(right) == digests[1] - digests[0]
        assert (len(left), len(right)) == (only_a, only_b)
    short = b"\n".join([bytes([c]) for c in range(97, 123)] * 40)
    assert len(paragraph_digests(short)) == 26 * 40  # copies of one-letter paragraphs are told apart
    assert len(difference(Fingerprint(short), Fingerprint(b""))[0]) == 26 * 40
    assert likeness(Fingerprint(b"x.\nx.\ny"), Fingerprint(b"y\nx.")) == 2 / 3
    assert str(Fingerprint(b"a\nb")) == str(Fingerprint(b"b\na")) != str(Fingerprint(b"a"))


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints(one.limit(0)).collect() == []
