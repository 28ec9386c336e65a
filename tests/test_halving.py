"""Settings search: the models equal plain Newton fits on the driver, and a round costs the same jobs for any number of settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.operators import halving as h


@pytest.fixture(scope="module")
def rows(spark):
    """Labelled rows with six values; the label depends on the second, some values are missing."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(400, 6))
    y = (values[:, 1] + 0.5 * rng.normal(size=400) > 0.3).astype(float)
    values[rng.random((400, 6)) < 0.05] = np.nan
    table = [(float(a), [None if np.isnan(x) else float(x) for x in v]) for a, v in zip(y, values)]
    return values, y, spark.createDataFrame(table, "y double, values array<double>").repartition(5)


PICKS = np.array([[0, 2, 4], [1, 2, 4], [1, 3, 5]])


def by_hand(values, y, pick, share, ridge=1e-3):
    x = values[:, pick]
    ok = ~np.isnan(x).any(axis=1)
    x, t = np.column_stack([np.ones(ok.sum()), x[ok]]), y[ok]
    w, beta = np.where(t > 0, 0.5 / share, 0.5 / (1 - share)), np.zeros(4)
    pull = len(t) * np.diag([1e-9, ridge, ridge, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pull, x.T @ (w * (t - p)) - pull @ beta)
    return x, t, beta


def test_fits_and_measures_equal_plain_newton(rows, monkeypatch):
    values, y, table = rows
    monkeypatch.setattr(h, "BLOCK", 100)  # one setting at a time
    weights = h.fit_settings(table, PICKS, 6, y.mean(), steps=15)
    found = h.judge_settings(table, PICKS, weights, 6)
    for pick, w, (f1, loss, n) in zip(PICKS, weights, found):
        x, t, beta = by_hand(values, y, pick, y.mean())
        assert w == pytest.approx(beta, abs=1e-5)
        p = 1 / (1 + np.exp(-x @ beta))
        hit, false, missed = ((p > 0.5) & (t > 0)).sum(), ((p > 0.5) & (t == 0)).sum(), ((p <= 0.5) & (t > 0)).sum()
        assert f1 == pytest.approx(2 * hit / (2 * hit + false + missed))
        assert loss == pytest.approx(-np.log(np.where(t > 0, p, 1 - p)).mean(), abs=1e-5)
        assert n == len(t)
    assert found[1, 0] > found[0, 0]


def sentence_pairs(spark, n_docs=150):
    """Documents whose label shows in the highest contradiction of few sentences, and is drowned when many are averaged."""
    rng = np.random.default_rng(5)
    pairs, labels = [], []
    for d in range(n_docs):
        true = bool(rng.random() < 0.5)
        labels.append((f"a{d}", "r", int(true), int(true), int(true)))
        for s in range(4):
            for k in range(12):
                high = 0.9 + 0.1 * rng.random() if true and s == 0 and k == 0 else 0.8 * rng.random()
                pairs.append((f"a{d}", "r", s, float(high), float(rng.random()), float(rng.random())))
    return (spark.createDataFrame(pairs, "article_url string, press_release_url string, press_release_idx int, contradiction double, entailment double, neutral double"),
            spark.createDataFrame(labels, "article_url string, press_release_url string, y_true_q1 int, y_true_q2 int, y_true_both int"))


def test_search_finds_the_setting_that_shows_the_label(spark):
    pairs, labels = sentence_pairs(spark)
    out = h.halving_search(pairs, labels, "article_url", inner=(1, 12), outer=(1, 4)).toPandas()
    assert len(out) == 64 and out["round"].max() == 3
    assert [int((out["round"] >= r).sum()) for r in (1, 2, 3)] == [64, 32, 16]
    last = out[out["round"] == 3].sort_values(["f1", "log_loss"], ascending=[False, True]).iloc[0]
    assert (last["i_contradiction"], last["o_contradiction"]) == (1, 1) and last["f1"] > 0.9
    assert (out.loc[out["round"] == 3, "share"] == 1.0).all()


def test_jobs_do_not_grow_with_the_settings(rows, spark):
    _, y, table = rows

    def jobs(picks):
        done = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
        before = done()
        h.fit_settings(table, picks, 6, y.mean(), steps=2)
        return done() - before

    assert 0 < jobs(PICKS)
    assert jobs(PICKS) == jobs(np.tile(PICKS, (50, 1)))


def test_edges(spark):
    pairs, labels = sentence_pairs(spark, 6)
    none = h.halving_search(pairs, labels.where("false"), "article_url", inner=(1,), outer=(1, 2)).toPandas()
    assert len(none) == 8 and (none["f1"] == 0).all()
    one_class = labels.withColumn("y_true_q1", F.lit(1))
    assert h.halving_search(pairs, one_class, "article_url", inner=(1,), outer=(1,)).count() == 1
    with pytest.raises(ValueError):
        h.halving_search(pairs, labels, "article_url", inner=range(1, 20), outer=range(1, 20))
