"""Removed words against a count of all windows; paths against the graph built in one go."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidings.llm import debruijn
from tidings.llm.debruijn import WINDOW, chain_labels, grams, joined_spans, node_runs, remove_repeated_passages, stretches


def windows(words):
    return [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def brute(texts):
    texts = [(t or "").encode().split() for t in texts]
    count = Counter(w for t in texts for w in windows(t))
    out = []
    for words in texts:
        hit = [False] * len(words)
        for i, w in enumerate(windows(words)):
            if count[w] > 1:
                hit[i : i + WINDOW] = [True] * WINDOW
        out.append((len(words), sum(hit), b" ".join(w for w, h in zip(words, hit) if not h).decode()))
    return out


def brute_paths(texts):
    """Spans of unbranched chains of repeated edges: sets of (text, start, end) per chain."""
    texts = [(t or "").encode().split() for t in texts]
    count = Counter(w for t in texts for w in windows(t))
    edges = [w for w, n in count.items() if n > 1]
    into, out = defaultdict(list), defaultdict(list)
    for e in edges:
        out[e[:-1]].append(e)
        into[e[1:]].append(e)
    label = {e: e for e in edges}

    def top(e):
        while label[e] != e:
            e = label[e]
        return e

    for node, here in into.items():
        if len(here) == 1 and len(out[node]) == 1:
            label[top(here[0])] = top(out[node][0])
    chains = defaultdict(list)
    for at, words in enumerate(texts):
        for i, w in enumerate(windows(words)):
            if count[w] > 1:
                spans = chains[top(w)]
                if spans and spans[-1][0] == at and spans[-1][2] == i + WINDOW - 1:
                    spans[-1] = (at, spans[-1][1], i + WINDOW)
                else:
                    spans.append((at, i, i + WINDOW))
    return {frozenset(s) for s in chains.values()}


def texts(seed=3):
    r = random.Random(seed)
    some = lambda n: [f"{r.choice('abé')}{r.randint(0, 400)}" for _ in range(n)]
    p = [some(n) for n in (35, 60, 34, 200, 48)]
    made = [None, "", " \t\n", " ".join(some(34)), "one " * 34, "two " * 36, "a b " * 40, "a b c " * 30]
    for i in range(30):
        words = some(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            q = r.choice(p)
            a = r.choice([0, 0, r.randint(0, len(q) // 2)])
            words += q[a : r.choice([len(q), r.randint(a, len(q))])] + some(r.randint(0, 40))
        made.append(("  " if i % 3 else "\x0b").join(words))
    made += [" ".join(p[3])] * 4 + [" ".join(p[1] + p[4] + p[1]), " ".join(p[4] + p[1]), " ".join(some(3) + p[2] + some(3)), " ".join(some(3) + p[2] + some(3))]
    return made


@pytest.mark.parametrize("hot_runs, shard_bytes", [(50_000, 6_000_000), (50_000, 2_000), (2, 2_000), (0, 6_000_000)])
def test_against_all_windows(spark, monkeypatch, hot_runs, shard_bytes):
    monkeypatch.setattr(debruijn, "SHARD_BYTES", shard_bytes)
    given = texts()
    rows = [(None if i in (8, 9) else i, t, 1) for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed long")
    found = remove_repeated_passages(docs, hot_runs=hot_runs)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed", "passages", "kept_text"]
    got = found.collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(brute(given))
    at = {t: [i for i, x in enumerate(given) if x == t] for t in given}
    chains = defaultdict(set)
    for r in got:
        i = r["doc_id"] if r["doc_id"] is not None else at[r["text"]][0]
        assert [p["start"] for p in r["passages"]] == sorted(p["start"] for p in r["passages"])
        for p in r["passages"]:
            chains[p["path"]].add((i, p["start"], p["end"]))
    assert {frozenset(s) for s in chains.values()} == brute_paths(given)


def test_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "x", "y")] * 3 + [(2, "short", "x", "y")]
    found = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, m string, kept_text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"], r["m"]) for r in found) == [(1, 50, "", "x")] * 3 + [(2, 0, "short", "x")]
    ids = spark.createDataFrame([("a", text), ("b", text + " more")], "key string, body string")
    assert sorted((r["key"], r["n_removed"]) for r in remove_repeated_passages(ids, "key", "body").collect()) == [("a", 50), ("b", 50)]


def test_very_long_text(spark):
    r = random.Random(9)
    words = [f"v{r.randint(0, 10_000)}" for _ in range(400_000)]
    shared = words[1_000:1_100]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["z"] * 3 + shared)), (3, "q " * 300_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeated_passages(docs).select("doc_id", "n_removed").collect()} == {1: 100, 2: 100, 3: 300_000}


def test_empty_table(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_and_names():
    h = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    for size in (1, 2, 3, 7, 10, 34, 35, 64):
        made = grams(h, size)
        again = grams(np.concatenate([h[5:9], h[100 : 100 + size]]), size)
        assert len(made) == 300 - size + 1 and len(set(made.tolist())) == len(made) and made[100] == again[-1]
    assert len(grams(h[:3], 4)) == 0
    _, m, at, nodes, twice = node_runs(h, np.array([300]))
    assert nodes.sum() == 300 - WINDOW + 2 and not twice.any()
    # the same words in other surroundings, and texts too short for a node beside them
    more = np.concatenate([h[:34], h[:7], h[50:250], h[:20]])
    text, *moved = node_runs(more, np.array([34, 207, 0, 20]))
    assert set(text.tolist()) == {1} and moved[2].sum() == 207 - WINDOW + 2
    name = lambda runs, i: next(x for x, a, n in zip(*runs[:3]) if a <= i < a + n)
    assert all(name((m, at, nodes), 100 + i) == name(moved, 57 + i) for i in range(50))
    start, end = np.array([3, 10, 100, 100]), np.array([50, 57, 101, 100])
    made = stretches(h, start, end)
    assert len(set(made.tolist())) == 4
    assert stretches(np.concatenate([h[7:], h]), start + 293, end + 293).tolist() == made.tolist()


def test_chains():
    # 1 -> 2 -> 3 -> 4, 3 -> 5, and a ring 6 -> 7 -> 8 -> 6
    source, target = np.array([1, 2, 3, 3, 6, 7, 8, 9]), np.array([2, 3, 4, 5, 7, 8, 6, 9])
    h = np.arange(10, 18)
    every = np.arange(10)
    assert chain_labels(h, source, target, every).tolist() == [10, 10, 12, 13, 14, 14, 14, 17]
    assert chain_labels(h, source, target, np.array([6, 7, 8, 9])).tolist() == [10, 11, 12, 13, 14, 14, 14, 17]
    assert chain_labels(h[:0], source[:0], target[:0], every).tolist() == []


def test_spans_of_one_path_join():
    flat = np.array([0, 3, 7, 3, 2, 7, 10, 1, 7, 3, 1, 8, 3, 2, 7])
    assert joined_spans(flat).tolist() == [[0, 5 + WINDOW - 1, 7], [3, 4 + WINDOW - 1, 8], [10, 11 + WINDOW - 1, 7]]
