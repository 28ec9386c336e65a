"""Search over roll-up settings by successive halving, with all models of a round fitted in the same jobs.

Every labelled document pair is stored once, with its roll-up values at every (inner, outer). A setting picks one value for each
score, so its model needs no data of its own: a task reads its rows once and adds up the gradient and the curvature of
every setting's logistic regression. The driver gets one small row per setting and step (never rows of data), takes the
Newton step, and sends the weights out again. A round costs the same number of jobs whatever the number of settings.

The first round judges all settings on a share of the documents, the better part goes on to more of them, and the last round
uses every document. Shares are hash ranges of the document key, so a round contains the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.evaluate import QUESTIONS, SCORES, roll_up_grid
from tidings.plans.storage import materialize

BLOCK = 1_000_000  # rows times settings worked on at once inside a task
MAX_SETTINGS = 100_000  # their weights and sums (under 200 bytes each) pass through the driver
SIZE = 1 + len(SCORES)  # weights of a model, the constant included


def labelled_values(
    pairs: DataFrame, labels: DataFrame, key: str, inner: Sequence[int], outer: Sequence[int], question: str = "q1", seed: int = 0
) -> DataFrame:
    """(y, place, test, values): label, place in [0, 1) by hash of ``key``, held-out mark, and all roll-up values in one array.

    The array goes by score, then inner, then outer. Pairs without a label and labels that are null are left out, a
    value that is missing is null. A fifth of the keys is held out.
    """
    docs = ["article_url", "press_release_url"]
    known = labels.where(F.col(QUESTIONS[question]).isNotNull()).select(
        *docs, F.col(QUESTIONS[question]).cast("double").alias("y"),
        *[(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(2 * seed + i)), F.lit(n)) / n).alias(c) for i, n, c in ((0, 1_000_000, "place"), (1, 5, "_fold"))],
    )
    grid = roll_up_grid(pairs.join(known.select(*docs).distinct(), docs, "left_semi"), inner, outer)
    cells = [(s, i, o) for s in SCORES for i in inner for o in outer]
    picked = [F.max(F.when((F.col("score") == s) & (F.col("inner_k") == i) & (F.col("outer_k") == o), F.col("value"))) for s, i, o in cells]
    wide = grid.groupBy(*docs).agg(F.array(*picked).alias("values"))
    return known.join(wide, docs).select("y", "place", (F.col("_fold") == 0).alias("test"), "values")


def _batches(tables: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for t in tables:
        if t.num_rows:
            flat = t.column("values").flatten().to_numpy(zero_copy_only=False).astype(float)
            yield t.column("y").to_numpy(zero_copy_only=False), flat.reshape(-1, width)


def _design(values: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (rows, settings, SIZE) and which of them are whole; what is missing counts as no row."""
    x = values[:, picks]
    whole = ~np.isnan(x).any(axis=2)
    return np.concatenate([np.ones((*x.shape[:2], 1)), np.where(whole[:, :, None], x, 0.0)], axis=2), whole


def _summed(rows: DataFrame, picks: np.ndarray, weights: np.ndarray, width: int, size: int, measure) -> np.ndarray:
    """``measure`` (rows, settings, ``size``) added up over all rows: one row per setting and task, then one per setting."""

    def run(tables):
        total = np.zeros((len(picks), size))
        for y, values in _batches(tables, width):
            step = max(1, BLOCK // len(y))
            for lo in range(0, len(picks), step):
                x, whole = _design(values, picks[lo : lo + step])
                z = np.clip(np.einsum("nsk,sk->ns", x, weights[lo : lo + step]), -30, 30)
                total[lo : lo + step] += measure(x, whole, y[:, None], 1 / (1 + np.exp(-z)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(picks))), pa.array(list(total))], names=["setting", "sums"])

    parts = rows.select("y", "values").mapInArrow(run, "setting bigint, sums array<double>")
    out = parts.groupBy("setting").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]).toArrow()
    sums = np.zeros((len(picks), size))
    if out.num_rows:
        sums[out["setting"].to_numpy()] = np.column_stack([out[f"s{i}"].to_numpy() for i in range(size)])
    return sums


def fit_settings(train: DataFrame, picks: np.ndarray, width: int, share_true: float, steps: int = 8, ridge: float = 1e-3) -> np.ndarray:
    """Weights (settings, SIZE) of balanced logistic regressions, one Newton step per job for all settings together.

    Classes weigh alike. ``ridge`` times the number of rows holds the weights (not the constant) back, so that separable
    classes have finite ones.
    """
    weights = np.zeros((len(picks), SIZE))
    by_class = (0.5 / max(1 - share_true, 1e-9), 0.5 / max(share_true, 1e-9))

    def measure(x, whole, y, p):
        w = np.where(y > 0, by_class[1], by_class[0]) * whole
        gradient = np.einsum("ns,nsk->sk", w * (y - p), x)
        curvature = np.einsum("ns,nsk,nsl->skl", w * p * (1 - p), x, x)
        return np.concatenate([gradient, curvature.reshape(len(gradient), -1), whole.sum(axis=0)[:, None]], axis=1)

    held = np.diag([1e-9, *[ridge] * (SIZE - 1)])
    for _ in range(steps):
        sums = _summed(train, picks, weights, width, SIZE + SIZE * SIZE + 1, measure)
        n = np.maximum(sums[:, -1], 1)[:, None, None]
        pull = n * held
        gradient = sums[:, :SIZE] - (pull @ weights[:, :, None])[:, :, 0]
        step = np.linalg.solve(sums[:, SIZE:-1].reshape(-1, SIZE, SIZE) + pull, gradient[:, :, None])[:, :, 0]
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def judge_settings(test: DataFrame, picks: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Per setting: F1 of the true class, mean log loss, and rows judged."""

    def measure(x, whole, y, p):
        guess, loss = p > 0.5, -np.log(np.where(y > 0, p, 1 - p))
        parts = [whole & guess & (y > 0), whole & guess & (y == 0), whole & ~guess & (y > 0), whole * loss, whole]
        return np.stack([a.sum(axis=0) for a in parts], axis=1).astype(float)

    hit, false, missed, loss, n = _summed(test, picks, weights, width, 5, measure).T
    return np.column_stack([2 * hit / np.maximum(2 * hit + false + missed, 1), loss / np.maximum(n, 1), n])


def halving_search(
    pairs: DataFrame, labels: DataFrame, key: str, inner: Sequence[int] = (2, 10, 30), outer: Sequence[int] = (10, 50, 100), question: str = "q1",
    first_share: float = 0.25, keep: float = 0.5, seed: int = 0,
) -> DataFrame:
    """Every setting of the k values with the last round it was in: (i_<score>, o_<score>, round, share, n_test, f1, log_loss).

    Each round leaves ``keep`` of the settings (by F1 on held-out documents, then log loss, then the order of the settings) and
    doubles the share of documents, up to all of them. The winner is the best row of the last round. Without labelled
    pairs every setting has F1 0.
    """
    options = list(product(range(len(inner)), range(len(outer))))
    settings = list(product(options, repeat=len(SCORES)))
    if len(settings) > MAX_SETTINGS:
        raise ValueError(f"{len(settings)} settings; at most {MAX_SETTINGS} are searched at once")
    width = len(SCORES) * len(options)
    picks = np.array([[s * len(options) + options.index(o) for s, o in enumerate(chosen)] for chosen in settings])
    rows = materialize(labelled_values(pairs, labels, key, inner, outer, question, seed), "labelled")
    moments = rows.select("y", F.posexplode("values").alias("i", "v")).where("v is not null").groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y"))
    mean, scale, share_true = np.zeros(width), np.ones(width), 0.5
    for i, m, s, y in moments.collect():  # one row per place of the array
        mean[i], scale[i], share_true = m, s or 1.0, y
    even = F.transform("values", lambda v, i: (v - F.get(F.array(*[F.lit(float(x)) for x in mean]), i)) / F.get(F.array(*[F.lit(float(x)) for x in scale]), i))
    rows = materialize(rows.withColumn("values", even), "scaled")

    left, share, turn, result = np.arange(len(settings)), first_share, 1, {}
    while True:
        share = 1.0 if len(left) <= 1 else min(1.0, share)
        part = rows.where(F.col("place") < share)
        weights = fit_settings(part.where("not test"), picks[left], width, share_true)
        found = judge_settings(part.where("test"), picks[left], weights, width)
        for s, (f1, loss, n) in zip(left.tolist(), found.tolist()):
            result[s] = (turn, share, int(n), f1, loss)
        if share >= 1.0:
            break
        order = sorted(range(len(left)), key=lambda i: (-round(found[i, 0], 9), round(found[i, 1], 9), left[i]))
        left = np.sort(left[order[: max(1, int(np.ceil(keep * len(left))))]])
        share, turn = share * 2, turn + 1
    table = [(*[k for i, o in settings[s] for k in (inner[i], outer[o])], *r) for s, r in sorted(result.items())]
    names = ", ".join(f"i_{s} int, o_{s} int" for s in SCORES)
    return rows.sparkSession.createDataFrame(table, f"{names}, round int, share double, n_test long, f1 double, log_loss double")
