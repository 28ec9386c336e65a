"""Counts, shares, distributions, lists per document, and the two-level score roll-up."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings.plans.shape import unpack
from tidings.functions.draws import draw
from tidings.plans.skew import LIST_BYTES, bytes_of, row_numbers, running_sum, top_rows, whole_list



def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# ---- counts ------------------------------------------------------------------------------------
def count_rows(df: DataFrame, distinct: bool = False) -> DataFrame:
    return (df.distinct() if distinct else df).agg(_count("n"))


def sum_flags(df: DataFrame, *flags: str) -> DataFrame:
    return df.agg(*[F.sum(F.col(f).cast("int")).alias(f) for f in flags])


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(_count(name))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts as a row x value matrix with 0 for what does not occur; values are given, not looked up."""
    return df.groupBy(row).agg(
        *[F.count(F.when(F.col(column) == v, 1)).alias(str(v).lower().replace(" ", "_")) for v in values]
    )


def rate_by_group(df: DataFrame, key: str, flag: str | Column, name: str = "rate") -> DataFrame:
    """Mean of a boolean per group, null flags and null keys left out."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(flag.cast("int")).alias(name))


def value_counts(df: DataFrame, column: str, n: int | None = None, name: str = "n") -> DataFrame:
    """Frequency of non-null values, most frequent first (smaller value first on a tie)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(_count(name)).orderBy(F.desc(name), column)
    return counts.limit(n) if n is not None else counts


def value_shares(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Frequency of non-null values divided by their total."""
    known = df.where(F.col(column).isNotNull())
    total = known.select(F.count(F.lit(1))).scalar()
    return known.groupBy(column).agg((F.count(F.lit(1)) / total).alias(name))


def n_unique(df: DataFrame, column: str, approximate: bool = False, name: str = "n") -> DataFrame:
    """Number of distinct non-null values."""
    if approximate:
        return df.agg(F.approx_count_distinct(column).alias(name))
    return df.agg(F.count_distinct(column).alias(name))


def set_sizes(df: DataFrame, key: str, value: str, name: str = "size") -> DataFrame:
    """Size of the value set of each key, as two partial counts instead of a set per key."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias(name))


def set_size_distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    return set_sizes(df, key, value).groupBy("size").agg(_count("n"))


def sources_per_document(df: DataFrame, doc: str, source: str, count_null: bool = False) -> DataFrame:
    """Distinct sources of each document.

    By default null is no source and a document without any is absent. With ``count_null`` null
    counts as one and 1 is taken off, the other usual measure.
    """
    if not count_null:
        return set_sizes(df.where(F.col(source).isNotNull()), doc, source, "n_sources")
    return df.select(doc, source).distinct().groupBy(doc).agg((F.count(F.lit(1)) - 1).alias("n_sources"))


def having_count(df: DataFrame, key: str, at_least: int = 2) -> DataFrame:
    return df.groupBy(key).agg(_count("n")).where(F.col("n") >= at_least)


def mean_group_size(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(_count("_n")).agg(F.avg("_n").alias("mean_size"))


def mean_label_profile(df: DataFrame, doc: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Mean number of rows of each label per document, documents without one counting 0.

    Every label's mean has the same divisor, so no document x label matrix is needed.
    """
    docs = df.where(F.col(label).isNotNull()).select(doc).distinct().select(F.count(F.lit(1))).scalar()
    return df.agg(*[(F.count(F.when(F.col(label) == x, 1)) / docs).alias(str(x).lower()) for x in labels])


def fetch_audit(to_fetch: DataFrame, fetched: DataFrame, outlet: str = "outlet", url: str = "url") -> DataFrame:
    """Per outlet: distinct addresses to fetch, fetched rows, addresses outstanding."""
    wanted, have = to_fetch.select(outlet, url).distinct(), fetched.select(outlet, url)
    left = wanted.join(have.distinct(), [outlet, url], "left_anti")
    a = wanted.groupBy(outlet).agg(_count("n_to_fetch"))
    b = have.groupBy(outlet).agg(_count("n_fetched"))
    c = left.groupBy(outlet).agg(_count("n_outstanding"))
    return a.join(b, outlet, "full").join(c, outlet, "full").na.fill(0)


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def total_list_size(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(F.greatest(F.size(column), F.lit(0))).alias("n"))


# ---- frequent values ----------------------------------------------------------------------------
def frequent_by_mentions(df: DataFrame, items: str, above: float = 0.01) -> DataFrame:
    """Elements that make up more than a share of all mentions."""
    mentions = unpack(df, [], F.col(items), "ent")
    total = mentions.select(F.count(F.lit(1))).scalar()
    counted = mentions.groupBy("ent").agg(_count("_n"))
    return counted.select("ent", (F.col("_n") / total).alias("share")).where(F.col("share") > above)


def frequent_by_documents(
    rows: DataFrame,
    n_docs: Column | int,
    already: DataFrame | None = None,
    top: int | None = None,
    above: float = 0.03,
) -> DataFrame:
    """Entities found in more than a share of the documents.

    ``rows`` are distinct (doc, ent). With ``top``, only that many most frequent ones that are not
    excluded already come into question. The exclusion set of several files
    is the union of what each file yields.
    """
    counts = rows.groupBy("ent").agg(_count("_n"))
    if already is not None:
        counts = counts.join(already.select(F.col(already.columns[0]).alias("ent")), "ent", "left_anti")
    if top is not None:
        counts = counts.orderBy(F.desc("_n"), "ent").limit(top)
    n_docs = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return counts.select("ent", (F.col("_n") / n_docs).alias("share")).where(F.col("share") > above)


# ---- lists per document ---------------------------------------------------------------------------
# A list is for what one key holds by its nature, such as the sentences of a document. One beyond ``list_bytes`` is an error.
def _packed(
    df: DataFrame, keys: list[str], order: str, columns: Sequence[str], list_bytes: int
) -> DataFrame:
    item = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    return df.groupBy(*keys).agg(whole_list(item, bytes_of(df, [order, *columns]), list_bytes).alias("_s"))


def ordered_lists(
    df: DataFrame, key: str | Sequence[str], order: str, *columns: str, list_bytes: int = LIST_BYTES
) -> DataFrame:
    """Columns of a document's rows as parallel lists in sentence order."""
    keys = [key] if isinstance(key, str) else list(key)
    packed = _packed(df, keys, order, columns, list_bytes)
    return packed.select(*keys, *[F.col("_s").getField(f"_v{i}").alias(c) for i, c in enumerate(columns)])


def collect_by_key(df: DataFrame, key: str, value: str, list_bytes: int = LIST_BYTES) -> DataFrame:
    """List of a key's non-null values, sorted."""
    return ordered_lists(df.where(F.col(value).isNotNull()), key, value, value, list_bytes=list_bytes)


def union_lists(df: DataFrame, key: str, lists: str, list_bytes: int = LIST_BYTES) -> DataFrame:
    """Distinct union of a list column per key, made distinct before anything is collected."""
    return collect_by_key(unpack(df, [key], F.col(lists), lists).distinct(), key, lists, list_bytes)


def concat_by_key(
    df: DataFrame, key: str | Sequence[str], value: str, order: str, separator: str = ",", name: str | None = None,
    list_bytes: int = LIST_BYTES,
) -> DataFrame:
    """Values of a key as one string, in a given order."""
    keys = [key] if isinstance(key, str) else list(key)
    packed = _packed(df.where(F.col(value).isNotNull()), keys, order, [value], list_bytes)
    strings = F.col("_s").getField("_v0").cast("array<string>")
    return packed.select(*keys, F.array_join(strings, separator).alias(name or value))


def passages_by_label(df: DataFrame, doc: str, label: str, sentence: str, order: str) -> DataFrame:
    """The sentences of each discourse label of a document as one passage."""
    return concat_by_key(df, [doc, label], sentence, order, " ", "passage")


def sentence_referenced(df: DataFrame, keys: Sequence[str], matched: Column) -> DataFrame:
    """Was a sentence matched in any of its comparisons?"""
    return df.groupBy(*keys).agg(F.max(F.coalesce(matched, F.lit(False)).cast("int")).alias("referenced"))


# ---- distributions -----------------------------------------------------------------------------------
def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins on [low, high]; the last bin includes ``high``, outsiders are dropped."""
    x = F.col(column)
    bin_ = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return df.where(x.between(low, high)).groupBy(bin_.alias("bin")).agg(_count("n"))


def exact_percentiles(
    df: DataFrame, key: str | Sequence[str] | None, value: str, points: Mapping[str, float]
) -> DataFrame:
    """Interpolated percentiles per group, exact at any group size.

    Equal values are counted together first; a running total over the distinct values (cut for
    hot groups) tells which value covers which position, and only the values next to a wanted
    position are aggregated. No task holds the values of a group.
    """
    keys = [key] if isinstance(key, str) else list(key or ())
    known = df.na.drop(subset=[*keys, value])
    counts = known.groupBy(*keys, F.col(value).alias("_x")).agg(_count("_c"))
    upto = running_sum(counts, keys, ["_x"], F.col("_c"), "_upto")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        placed = upto.join(totals, keys)
    else:
        placed = upto.withColumn("_n", counts.select(F.sum("_c")).scalar())
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1  # positions from 0 this value covers
    out = []
    for name, p in points.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        below = F.max(F.when((first <= low) & (low <= last), F.col("_x")))
        above = F.max(F.when((first <= high) & (high <= last), F.col("_x")))
        out.append((below + (above - below) * F.max(at - low)).cast("double").alias(name))
    return placed.groupBy(*keys).agg(*out)


def box_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Five-number summary per group."""
    return exact_percentiles(df, key, value, {"min": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1})


def year_stats(df: DataFrame, key: str, time: str) -> DataFrame:
    """Mean and median year per group."""
    years = df.select(key, F.year(time).alias("_year"))
    mean = years.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("_year").alias("mean_year"))
    return mean.join(exact_percentiles(years, key, "_year", {"median_year": 0.5}), key)


# ---- two-level roll-up of pair scores ------------------------------------------------------------------
# fixed values: methods per score and level
LEVEL_1 = {
    "contradiction": ("top_k_mean", 3), "entailment": ("top_k_mean", 3), "neutral": ("bottom_k_mean", 3),
}
LEVEL_2 = {"contradiction": ("top_k_mean", 8), "entailment": ("top_k_mean", 8), "neutral": ("median", None)}
METHODS = ("top_k_mean", "bottom_k_mean", "mean", "median")


def _rank_order(methods: Mapping[str, tuple[str, int | None]]) -> Column:
    """Sort value that puts what a k-mean keeps first."""
    lowest = [s for s, (m, _) in methods.items() if m == "bottom_k_mean"]
    return F.when(F.col("score").isin(lowest), F.col("value")).otherwise(-F.col("value")) if lowest else -F.col("value")


def _k_of(methods: Mapping[str, tuple[str, int | None]]) -> Column:
    out = F.lit(None).cast("int")
    for score, (_, k) in methods.items():
        out = F.when(F.col("score") == score, F.lit(k)).otherwise(out)
    return out


def _named(methods, *kinds: str) -> list[str]:
    return [s for s, (m, _) in methods.items() if m in kinds]


def _reduce_large(scores: DataFrame, keys: list[str], methods: Mapping[str, tuple[str, int | None]]) -> DataFrame:
    """One value per (keys, score) out of long rows (keys, score, value), many rows per key.

    The rows of a k-mean are first cut to the k best of their group and score. Spark does that
    per map task before the shuffle, so no more than k rows per group and task travel. Means
    are partial sums and medians partial value counts; they read the rows again only if used.
    """
    parts = []
    cut = _named(methods, "top_k_mean", "bottom_k_mean")
    if cut:
        chosen = scores.where(F.col("score").isin(cut) & F.col("value").isNotNull())
        most = max(methods[s][1] for s in cut)
        ranked = top_rows(chosen.withColumn("_o", _rank_order(methods)), [*keys, "score"], ["_o"], most, "_rn")
        kept = ranked.where(F.col("_rn") <= _k_of(methods))
        parts.append(kept.groupBy(*keys, "score").agg(F.avg("value").alias("value")))
    if _named(methods, "mean"):
        plain = scores.where(F.col("score").isin(_named(methods, "mean")))
        parts.append(plain.groupBy(*keys, "score").agg(F.avg("value").alias("value")))
    if _named(methods, "median"):
        plain = scores.where(F.col("score").isin(_named(methods, "median")))
        parts.append(exact_percentiles(plain, [*keys, "score"], "value", {"value": 0.5}))
    return reduce(DataFrame.unionByName, parts)


def _reduce_small(scores: DataFrame, keys: list[str], methods: Mapping[str, tuple[str, int | None]]) -> DataFrame:
    """The same in one pass whatever the methods, for groups of the size of a document."""
    window = Window.partitionBy(*keys, "score").orderBy("_o")
    known = scores.where(F.col("value").isNotNull()).withColumn("_o", _rank_order(methods))
    ranked = known.withColumn("_rn", F.row_number().over(window))
    at = lambda *kinds: F.col("score").isin(_named(methods, *kinds))
    best = F.avg(F.when(at("top_k_mean", "bottom_k_mean") & (F.col("_rn") <= _k_of(methods)), F.col("value")))
    mean = F.avg(F.when(at("mean"), F.col("value")))
    middle = [F.median(F.when(at("median"), F.col("value")))] if _named(methods, "median") else []
    return ranked.groupBy(*keys, "score").agg(F.coalesce(best, mean, *middle).alias("value"))


def _reduce_runs(values: np.ndarray, size: np.ndarray, method: str, k: int | None) -> np.ndarray:
    """One value for each run of ``values``, nan for an empty one."""
    run, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    if method != "mean":
        values = values[np.lexsort((-values if method == "top_k_mean" else values, run))]
    if method == "median":
        there = size > 0
        low, high = first[there] + (size[there] - 1) // 2, first[there] + size[there] // 2
        out = np.full(len(size), np.nan)
        out[there] = (values[low] + values[high]) / 2
        return out
    if method != "mean":
        best = np.arange(len(values)) - first[run] < k
        values, run, size = values[best], run[best], np.minimum(size, k)
    with np.errstate(invalid="ignore"):
        return np.bincount(run, values, len(size)) / np.where(size > 0, size, np.nan)


def _two_levels_of_lists(n_keys: int, level_1: Mapping, level_2: Mapping, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = lambda lists: lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in batches:
            out = batch.columns[:n_keys]
            for name in schema.names[n_keys:]:
                lists = batch.column(name)
                inner = lists.flatten()
                per_sentence = _reduce_runs(inner.flatten().to_numpy(), sizes(inner), *level_1[name])
                known = ~np.isnan(per_sentence)
                size = np.bincount(np.repeat(np.arange(len(lists)), sizes(lists))[known], minlength=len(lists))
                out.append(pa.array(_reduce_runs(per_sentence[known], size, *level_2[name]), from_pandas=True))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def two_level_scores(
    pairs: DataFrame,
    document_keys: Sequence[str] = ("article_url", "press_release_url"),
    sentence_key: str = "press_release_idx",
    level_1: Mapping[str, tuple[str, int | None]] = LEVEL_1,
    level_2: Mapping[str, tuple[str, int | None]] = LEVEL_2,
) -> DataFrame:
    """Document-pair scores out of sentence-pair scores.

    Level 1 reduces the scores of each release sentence, level 2 those of each document pair.
    A method is (``top_k_mean`` | ``bottom_k_mean`` | ``mean`` | ``median``, k).
    Where a row is a whole document pair, with a list for each release sentence as its scores, nothing is shuffled.
    """
    for method, _ in [*level_1.values(), *level_2.values()]:
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
    docs, names = list(document_keys), list(level_1)
    if all(isinstance(pairs.schema[s].dataType, T.ArrayType) for s in names):
        schema = T.StructType([*[pairs.schema[c] for c in docs], *[T.StructField(s, T.DoubleType()) for s in names]])
        return pairs.select(*docs, *names).mapInArrow(_two_levels_of_lists(len(docs), level_1, level_2, to_arrow_schema(schema)), schema)
    long = pairs.select(
        *docs, sentence_key,
        F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in names]))
        .alias("_s"),
    ).select(*docs, sentence_key, "_s.score", "_s.value")
    per_sentence = _reduce_large(long, [*docs, sentence_key], level_1)
    per_pair = _reduce_small(per_sentence, docs, level_2)
    return per_pair.groupBy(*docs).agg(*[F.max(F.when(F.col("score") == s, F.col("value"))).alias(s) for s in names])


# ---- evaluation ---------------------------------------------------------------------------------------------
def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(_count("n"))


def f1_by_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """F1 of every class that occurs in truth or prediction."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                         F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return sums.select("label", (2 * F.col("hit") / (F.col("t") + F.col("p"))).alias("f1"))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return f1_by_class(df, truth, predicted).agg(F.avg("f1").alias("macro_f1"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve of a 0/1 truth, ties counting half.

    Counts positives and negatives per distinct score and adds up how many negatives lie below.
    """
    by_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(
        F.count(F.when(F.col(truth) == 1, 1)).alias("_pos"), F.count(F.when(F.col(truth) == 0, 1)).alias("_neg")
    )
    below = running_sum(by_score, [], ["_s"], F.col("_neg"), "_upto")
    wins = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    return below.agg((wins / (F.sum("_pos") * F.sum("_neg"))).alias("auc"))


def split_rows(df: DataFrame, key: str, seed: int = 0, test_percent: int = 20, name: str = "split") -> DataFrame:
    """Mark rows as train or test by a hash of their id: the same split in every run."""
    return df.withColumn(name, F.when(draw(seed, key) % 100 < test_percent, "test").otherwise("train"))


def split_by_prefix(df: DataFrame, path: str, train: Sequence[str] = ("train", "test")) -> DataFrame:
    head = F.substring_index(F.col(path), "/", 1)
    return df.withColumn("split", F.when(head.isin(list(train)), "train").otherwise("test"))


def balance_classes(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Resample every class with replacement to the size of the largest one.

    Rows are numbered per class; draw number j of a class takes row hash(j) mod its size. Draws
    come from a range of the majority size, made in parallel, and meet the rows in a join.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(_count("_n"))
    largest = counts.select(F.max("_n")).scalar()
    numbered = row_numbers(df.where(F.col(label).isNotNull()), [key], keys=[label], name="_rn").withColumn(
        "_rn", F.col("_rn") - 1
    )
    chunk = 10_000
    draws = (
        counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((largest - 1) / chunk))))
        .withColumn(
            "draw",
            F.explode(
                F.sequence(F.col("_chunk") * chunk, F.least((F.col("_chunk") + 1) * chunk, largest) - 1)
            ),
        )
        .select(label, "draw", (draw(seed, "draw") % F.col("_n")).alias("_rn"))
    )
    return draws.join(numbered, [label, "_rn"]).drop("_rn").select(*df.columns, "draw")
