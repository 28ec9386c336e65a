"""Classifiers over texts and roll-up scores, and the search over roll-up settings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings import lexicon
from tidings.operators.aggregates import balance_classes, f1_by_class, macro_f1, roc_auc, split_rows
from tidings.plans.skew import top_rows
from tidings.plans.storage import materialize

SCORES = ("contradiction", "entailment", "neutral")
ROWS_PER_PART = 5_000  # training texts that a task reads
QUESTIONS = {"q1": "y_true_q1", "q2": "y_true_q2", "both": "y_true_both"}


def label_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Roll-up scores next to the human labels of the same document pair."""
    return labels.join(scores, ["article_url", "press_release_url"])


# ---- texts ------------------------------------------------------------------------------------
def text_classifier(
    body: str, label: str, min_df: float = 0.005, max_df: float = 0.5, stop_words: Sequence[str] | None = None
) -> Pipeline:
    """Word counts and logistic regression as one pipeline; words of two letters or more."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
            RegexTokenizer(
                inputCol=body, outputCol="words", pattern=r"[\p{L}\p{N}_]+", gaps=False, minTokenLength=2
            ),
            StopWordsRemover(
                inputCol="words", outputCol="content_words", stopWords=list(stop_words or lexicon.STOP_WORDS)
            ),
            CountVectorizer(inputCol="content_words", outputCol="features", minDF=min_df, maxDF=max_df),
            LogisticRegression(labelCol="label_index", featuresCol="features", maxIter=50, regParam=0.01),
        ]
    )


def evaluate_text_classifier(train: DataFrame, test: DataFrame, body: str, label: str, **settings) -> DataFrame:
    """Macro F1 on the test rows of a classifier fitted on the training rows.

    Fitting reads the same parts again and again, so they are of at most about ``ROWS_PER_PART`` rows.
    """
    parts = -(-train.count() // ROWS_PER_PART)
    if parts > train.sparkSession.sparkContext.defaultParallelism:
        train = train.repartition(parts)
    model = text_classifier(body, label, **settings).fit(train)
    return macro_f1(model.transform(test), "label_index", "prediction")


# ---- verdicts -----------------------------------------------------------------------------------
def _fit_and_test(train: DataFrame, test: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    model = Pipeline(stages=[assemble, LogisticRegression(labelCol=target, featuresCol="features")]).fit(train)
    scored = model.transform(test).select(target, "prediction", vector_to_array("probability")[1].alias("p"))
    scored = materialize(scored, "scored")  # read by both measures
    f1 = f1_by_class(scored, target, "prediction").where(F.col("label") == 1).agg(
        F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1")
    )
    return f1.withColumn("auc", roc_auc(scored, target, "p").scalar())


def verdict_classifier(
    labelled: DataFrame,
    key: str,
    features: Sequence[str] = SCORES,
    questions: Mapping[str, str] = QUESTIONS,
    splits: int = 5,
    only_where: Mapping[str, str] | None = None,
) -> DataFrame:
    """F1 and AUC per question and split: 80/20 split, balanced training rows, logistic regression.

    The second question is only put where the first is true (``only_where``).
    """
    only_where = {"q2": "y_true_q1"} if only_where is None else only_where
    rows = []
    for q, column in questions.items():
        part = labelled.where(F.col(only_where[q]).cast("boolean")) if q in only_where else labelled
        part = part.withColumn("_y", F.col(column).cast("int"))
        for seed in range(splits):
            marked = split_rows(part, key, seed)
            # fitting goes over the rows again and again
            train = materialize(balance_classes(marked.where(F.col("split") == "train"), "_y", key, seed), "train")
            result = _fit_and_test(train, marked.where(F.col("split") == "test"), "_y", features)
            rows.append(result.select(F.lit(q).alias("question"), F.lit(seed).alias("seed"), "f1", "auc"))
    return reduce(DataFrame.unionByName, rows)


# ---- roll-up settings ------------------------------------------------------------------------------
def roll_up_grid(
    pairs: DataFrame,
    inner: Sequence[int],
    outer: Sequence[int],
    document_keys: Sequence[str] = ("article_url", "press_release_url"),
    sentence_key: str = "press_release_idx",
    low_first: Iterable[str] = ("neutral",),
) -> DataFrame:
    """Roll-up scores for every (inner k, outer k) in one job: long (documents, score, inner_k, outer_k, value).

    Ranks do not depend on k: rows are ranked once per level, and each k is a condition in one
    aggregate. Scores named in ``low_first`` average their lowest values at level 1 and take the
    median at level 2, so for them ``outer_k`` makes no difference.
    """
    docs, low_first = list(document_keys), list(low_first)
    long = pairs.select(
        *docs, sentence_key,
        F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in SCORES]))
        .alias("_s"),
    ).select(*docs, sentence_key, "_s.*")
    signed = F.when(F.col("score").isin(low_first), F.col("value")).otherwise(-F.col("value"))
    ranked = top_rows(long.withColumn("_o", signed), [*docs, sentence_key, "score"], ["_o"], max(inner), "_rn")
    at_k = lambda ks, v: F.array(
        *[F.struct(F.lit(k).alias("k"), F.avg(F.when(F.col("_rn") <= k, F.col(v))).alias("value")) for k in ks]
    )
    level_1 = (
        ranked.groupBy(*docs, sentence_key, "score").agg(at_k(inner, "value").alias("_g"))
        .select(*docs, "score", F.explode("_g").alias("_g"))
        .select(*docs, "score", F.col("_g.k").alias("inner_k"), F.col("_g.value").alias("value"))
    )
    groups = [*docs, "score", "inner_k"]
    high = top_rows(
        level_1.where(~F.col("score").isin(low_first)).withColumn("_o", -F.col("value")), groups, ["_o"], max(outer), "_rn"
    ).groupBy(*groups).agg(at_k(outer, "value").alias("_g"))
    low = level_1.where(F.col("score").isin(low_first)).groupBy(*groups).agg(F.median("value").alias("_m"))
    low = low.select(
        *groups, F.array(*[F.struct(F.lit(k).alias("k"), F.col("_m").alias("value")) for k in outer]).alias("_g")
    )
    return high.unionByName(low).select(*groups, F.explode("_g").alias("_g")).select(
        *groups, F.col("_g.k").alias("outer_k"), F.col("_g.value").alias("value")
    )


def parameter_search(
    pairs: DataFrame,
    labels: DataFrame,
    key: str,
    inner: Sequence[int] = (2, 10, 30),
    outer: Sequence[int] = (10, 50, 100),
    question: str = "q1",
    splits: int = 5,
) -> DataFrame:
    """Mean F1 of every setting of the six k values, best first.

    Only pairs with a label are rolled up. The grid is computed once and stored; what repeats
    per setting is a fit on the labelled pairs.
    """
    docs = ["article_url", "press_release_url"]
    grid = materialize(roll_up_grid(pairs.join(labels.select(*docs), docs, "left_semi"), inner, outer), "grid")
    out = []
    for ks in product(product(inner, outer), repeat=len(SCORES)):
        chosen = [
            F.max(F.when((F.col("score") == s) & (F.col("inner_k") == i) & (F.col("outer_k") == o), F.col("value")))
            .alias(s)
            for s, (i, o) in zip(SCORES, ks, strict=True)
        ]
        wide = label_scores(labels, grid.groupBy(*docs).agg(*chosen))
        result = verdict_classifier(wide, key, questions={question: QUESTIONS[question]}, splits=splits)
        named = [F.lit(v).alias(f"{p}_{s}") for s, k in zip(SCORES, ks, strict=True) for p, v in zip("io", k)]
        out.append(result.agg(F.avg("f1").alias("mean_f1")).select(*named, "mean_f1"))
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("mean_f1"))
