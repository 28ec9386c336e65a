"""Near-duplicate groups against all pairs of full shingle sets."""

import random
import re

import pytest

from tidings.llm import near_dedup
from tidings.llm.near_dedup import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and label[i] != label[j] and 100 * len(a & b) >= 75 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for i, (key, _) in enumerate(rows):
        component = min((k for (k, _), x in zip(rows, label) if x == label[i] and k is not None), default=None)
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n long")
    return sorted([tuple(r)[:4] for r in near_duplicates(docs).collect()], key=str)


def copies(seed, n_groups, n_copies, words=60, edits=4):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 300)}"
    rows, boiler = [], " ".join(word() for _ in range(25))
    for _ in range(n_groups):
        base = [word() for _ in range(words)]
        for _ in range(n_copies):
            new = list(base)
            for _ in range(r.randint(0, edits)):
                new[r.randrange(len(new))] = word()
            rows.append((len(rows), " ".join(new).title() if r.random() < 0.5 else "\t ".join(new)))
    rows += [(len(rows) + i, boiler + " " + " ".join(word() for _ in range(r.randint(5, 60)))) for i in range(30)]
    r.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = copies(1, 6, 8) + [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  two"), (905, "one two three"), (906, "A b c d e")]
    rows += [(907, "a B c d e"), (908, rows[0][1]), (908, rows[0][1]), (None, rows[1][1]), (None, "alone of its kind it is"), (None, None)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("hubs", [(1,), (1, 4)])
def test_long_lists_by_blocks(spark, monkeypatch, hubs):
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    monkeypatch.setattr(near_dedup, "SHORT", 3)
    monkeypatch.setattr(near_dedup.long_list_links, "__defaults__", (7,))
    rows = copies(2, 2, 60, edits=6)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_read_their_links_once(spark):
    """Finding links may be most of the work; chains, stars, loops and repeated links are joined as ever."""
    from tidings.llm.common import components

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, i + 1) for i in range(10, 40)] + [(50, i) for i in range(60, 70)] + [(7, 50), (7, 7), (8, 8), (2, 1), (1, 2), (2, 1), (None, 3)]
    links = spark.createDataFrame(rows, "a long, b long").mapInArrow(count, "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert seen.value == len(rows)
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 7 for i in [7, 50, *range(60, 70)]}, 1: 1, 2: 1}


def test_rounds_over_few_labels_shuffle_once(spark, monkeypatch):
    """Each join by a shuffle is a task per partition in the driver's books; many labels go by shuffles to the same result."""
    from tidings.llm import common

    plans, store = [], common.materialize

    def noted(df, label):
        plans.append(len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString())))
        return store(df, label)

    monkeypatch.setattr(common, "materialize", noted)
    rows = [(i, i + 1) for i in range(10, 40)] + [(50, i) for i in range(60, 70)] + [(7, 50), (7, 7), (2, 1), (1, 2), (None, 3)]
    links = spark.createDataFrame(rows, "a long, b long")
    want = {**{i: 10 for i in range(10, 41)}, **{i: 7 for i in [7, 50, *range(60, 70)]}, 1: 1, 2: 1}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for few in (len(want), len(want) - 1):
            monkeypatch.setattr(common, "FEW_LABELS", few)
            plans.clear()
            assert {r["node"]: r["label"] for r in common.components(links).collect()} == want
            assert len(plans) > 3 and all(n == 1 if few == len(want) else n > 3 for n in plans[2:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
