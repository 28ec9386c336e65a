"""Ranking: BM25 with filters, TF-IDF similarity, dense vectors, hard negatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings.functions.draws import draw
from tidings import lexicon
from tidings.functions import text
from tidings.functions.dates import parse_interval
from tidings.operators import postings as packed
from tidings.plans.shape import unpack
from tidings.plans.skew import HOT_ROWS, salted_join, top_rows
from tidings.plans.storage import materialize

K1, B = 1.2, 0.75
IDF_TERMS = 1_000_000  # terms of a broadcast idf table
ASKED_TERMS = 1_000_000  # terms of queries that a broadcast table has a row for
PAIRS_PER_PIECE = 50_000  # pairs of documents that meet in one group


def by_document(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    """(doc, body) with the rows of a document in one partition."""
    return docs.select(F.col(doc_id).alias("doc"), F.col(body).alias("body")).repartition("doc")


def term_counts(docs: DataFrame, doc_id: str, body: str, stop_words: list[str] | None = None) -> DataFrame:
    """(doc, term, tf): texts are dealt by document, once, and what follows by document needs no further shuffle.

    A text is smaller than its (doc, term) rows.
    """
    rows = unpack(by_document(docs, doc_id, body), ["doc"], text.tokens(F.col("body")), "term")
    if stop_words:
        rows = rows.where(~F.col("term").isin(stop_words))
    return rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Index:
    """Inverted index: postings (term, doc, tf, rel_len) with term df, and the collection size.

    ``texts`` (doc, body) is what it is made of, unless it was loaded: a search that asks for few terms counts only these.
    """

    postings: DataFrame
    frequencies: DataFrame
    n_docs: Column
    texts: DataFrame | None = None

    def save(self, path: str, buckets: int | None = None) -> None:
        """Write the index; ``n_docs`` becomes a one-row table."""
        postings = self.postings.repartition(buckets, "term") if buckets else self.postings
        postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
        self.frequencies.sparkSession.range(1).select(self.n_docs.alias("n")).write.mode("overwrite").parquet(
            f"{path}/size"
        )

    @staticmethod
    def load(spark, path: str) -> Index:
        size = spark.read.parquet(f"{path}/size")
        return Index(
            spark.read.parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/frequencies"),
            size.select("n").scalar(),
        )


def build_index(docs: DataFrame, doc_id: str, body: str) -> Index:
    """Postings, document frequencies and relative document lengths of a collection.

    Documents without a token still count towards the collection size and the mean length.
    """
    counts = term_counts(docs, doc_id, body)
    length = F.size(text.tokens(F.col(body))).alias("len")
    mean_len = docs.select(length).select(F.avg("len")).scalar()
    lengths = by_document(docs, doc_id, body).select("doc", F.size(text.tokens(F.col("body"))).alias("len"))
    rel = lengths.select("doc", (F.col("len") / mean_len).alias("rel_len"))
    frequencies = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(body).alias("body"))
    return Index(counts.join(rel, "doc"), frequencies, docs.select(F.count(F.lit(1))).scalar(), texts)


def _query_terms(queries: DataFrame, query_id: str, body: str) -> DataFrame:
    """(query, term, qtf), stored."""
    terms = term_counts(queries, query_id, body).select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"))
    return materialize(terms, "query-terms")


def _weighted_terms(index: Index, terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(query, term, weight, df): times in the query times idf; unknown terms drop out."""
    n, df = index.n_docs, F.col("df")
    known = terms.join(frequencies, "term")
    return known.select("query", "term", (F.col("qtf") * F.log(1.0 + (n - df + 0.5) / (df + 0.5))).alias("weight"), "df")


def _gain(k1: float, b: float) -> Column:
    return F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("rel_len")))


def _hot_terms(frequencies: DataFrame, hot_rows: int) -> DataFrame:
    shares = F.ceil(F.col("df") / hot_rows).cast("int")
    return frequencies.where(F.col("df") > hot_rows).select("term", shares.alias("_shares"))


def bm25_scores(
    index: Index,
    queries: DataFrame,
    query_id: str,
    body: str,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(query, doc, score) for every document that holds a query term.

    ``include`` / ``exclude`` are (query, doc) tables; they decide which documents are scored
    while document frequencies and collection size stay those of the whole index. A term that
    repeats in a query counts each time. Unknown terms match no posting.
    """
    terms = materialize(_weighted_terms(index, _query_terms(queries, query_id, body), index.frequencies).drop("df"), "query-weights")
    # only postings of query terms are read on from here
    postings = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    if include is not None:
        # pairs pick up the query's terms, then meet postings on (doc, term), a key without hot values
        allowed = include.select("query", "doc").distinct()
        matched = salted_join(allowed, terms, ["query"], hot_rows=hot_rows).join(postings, ["doc", "term"])
    else:
        matched = salted_join(postings, terms, ["term"], hot=_hot_terms(index.frequencies, hot_rows))
    if exclude is not None:
        matched = matched.join(exclude.select("query", "doc").distinct(), ["query", "doc"], "left_anti")
    return matched.groupBy("query", "doc").agg(F.sum(F.col("weight") * _gain(k1, b)).alias("score"))


@dataclass
class Bounds:
    """What lets a search leave documents out.

    ``gains``: postings of the query terms (``term``, ``doc``, ``gain``). ``terms``: query terms with their ``weight``, whether they
    are ``essential``, and per query the score ``wanted`` at least and the most that the terms that are not can add (``rest``).
    ``frequencies``: their documents (``term``, ``df``). Where the terms are few, ``scores`` gives (query, doc, score) of all documents that
    reach what their query wants.
    """

    gains: DataFrame
    terms: DataFrame
    frequencies: DataFrame
    scores: Callable[[], DataFrame] | None = None


def _asked_postings(index: Index, terms: DataFrame, cutoff: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame, Callable | None]:
    """Gains of the postings of query terms, the ``cutoff`` best of each term (some tasks' best at least), frequencies, and how to score.

    Texts are read once, for the terms that are asked for, and shuffled as counts of these. An index without texts, or very many terms, go by rows of postings.
    """
    wanted = terms.select("term").distinct()
    if index.texts is None or terms.count() > ASKED_TERMS:
        gains = materialize(index.postings.join(wanted, "term", "left_semi").select("term", "doc", _gain(k1, b).alias("gain")), "gains")
        frequencies = materialize(index.frequencies.join(wanted, "term", "left_semi"), "frequencies")
        return gains, gains, frequencies, None
    names = sorted(r["term"] for r in wanted.collect())
    spark = terms.sparkSession
    codes = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "code": pa.array(range(len(names)), pa.int64())}))
    counts = packed.asked_counts(index.texts, names)
    mean = packed.mean_length(counts)
    best = packed.best_postings(counts, len(names), mean, cutoff, k1, b)
    frequencies = materialize(best.groupBy("code").agg(F.sum("n").alias("df")).join(codes, "code").select("term", "df"), "frequencies")

    def scores(weighted: DataFrame) -> DataFrame:
        return packed.scores_above(counts, weighted.join(codes, "term"), mean, k1, b)

    named = best.where("doc is not null").join(codes, "code").select("term", "doc", "gain")
    return packed.gain_rows(counts, codes, mean, k1, b), named, frequencies, scores


def score_bounds(
    index: Index, queries: DataFrame, query_id: str, body: str, cutoff: int, exclude: DataFrame | None = None,
    slack: float = 1e-9, k1: float = K1, b: float = B,
) -> Bounds:
    """Thresholds and bounds of each query.

    Every term's ``cutoff`` best postings add up to scores that some documents have at least; the ``cutoff``-th of them is what a
    document has to reach. A term adds at most its weight times its best gain. Taken from the smallest, the terms whose bounds together
    stay below the threshold are not essential: a document without any other term is not among the best. A query for which the best
    postings hold fewer than ``cutoff`` documents (some may be excluded) has no threshold, and all its terms are essential.
    """
    terms = _query_terms(queries, query_id, body)
    gains, good, frequencies, scores = _asked_postings(index, terms, cutoff, k1, b)
    weighted = materialize(_weighted_terms(index, terms, frequencies), "query-weights")
    best = materialize(top_rows(good, ["term"], [F.desc("gain"), "doc"], cutoff, "_rn"), "best")
    known = best.join(weighted, "term").select("query", "doc", (F.col("weight") * F.col("gain")).alias("part"))
    if exclude is not None:
        known = known.join(exclude.select("query", "doc").distinct(), ["query", "doc"], "left_anti")
    least = top_rows(known.groupBy("query", "doc").agg(F.sum("part").alias("part")), ["query"], [F.desc("part"), "doc"], cutoff, "_rn")
    least = least.where(F.col("_rn") == cutoff).select("query", (F.col("part") - slack).alias("wanted"))
    most = weighted.join(best.where("_rn = 1").select("term", "gain"), "term").withColumn("most", F.col("weight") * F.col("gain"))
    # the terms of one query
    upward = Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    marked = most.join(least, "query", "left").withColumn("essential", F.col("wanted").isNull() | (F.sum("most").over(upward) >= F.col("wanted")))
    rest = F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("query"))
    terms = marked.select("query", "term", "weight", "essential", F.coalesce("wanted", F.lit(float("-inf"))).alias("wanted"), rest.alias("rest"))
    terms = materialize(terms, "bounds")
    return Bounds(gains, terms, frequencies, None if scores is None else lambda: scores(terms.select("query", "term", "weight", "wanted")))


def candidate_scores(bounds: Bounds, index: Index, exclude: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query, doc, part, rest): documents that can reach their query's threshold, with what their essential terms add up to.

    Postings are kept together by document, so sums need no second shuffle.
    """
    essential = bounds.terms.where("essential").select("query", "term", "weight", "wanted", "rest")
    matched = salted_join(bounds.gains, essential, ["term"], hot=_hot_terms(bounds.frequencies, hot_rows))
    if exclude is not None:
        matched = matched.join(exclude.select("query", "doc").distinct(), ["query", "doc"], "left_anti")
    sums = matched.groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("gain")).alias("part"), F.first("wanted").alias("wanted"), F.first("rest").alias("rest"))
    return sums.where(F.col("part") + F.col("rest") >= F.col("wanted")).select("query", "doc", "part", "rest")


def pruned_scores(
    index: Index, queries: DataFrame, query_id: str, body: str, cutoff: int, exclude: DataFrame | None = None,
    slack: float = 1e-9, k1: float = K1, b: float = B, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(query, doc, score) of documents among which the best ``cutoff`` of each query are.

    Documents of few terms are scored inside tasks, and those that reach their query's threshold go on. Otherwise candidates
    come from essential terms alone; what the other terms add is looked up for the candidates only.
    """
    bounds = score_bounds(index, queries, query_id, body, cutoff, exclude, slack, k1, b)
    if bounds.scores is not None:
        found = bounds.scores()
        return found if exclude is None else found.join(exclude.select("query", "doc").distinct(), ["query", "doc"], "left_anti")
    found = materialize(candidate_scores(bounds, index, exclude, hot_rows), "candidates")
    others = bounds.terms.where("NOT essential").select("query", "term", "weight")
    asked = found.where("rest > 0").select("query", "doc").join(others, "query")
    added = asked.join(bounds.gains, ["doc", "term"]).groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("gain")).alias("added"))
    return found.join(added, ["query", "doc"], "left").select("query", "doc", (F.col("part") + F.coalesce("added", F.lit(0.0))).alias("score"))


def search(
    index: Index,
    queries: DataFrame,
    query_id: str,
    body: str,
    cutoff: int = 100,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    digits: int | None = None,
    **weights,
) -> DataFrame:
    """The best ``cutoff`` documents of each query, best first (smaller id on a tie).

    ``digits`` rounds scores before ranking, which makes ties independent of the order in
    which partial sums were added. Without ``include`` documents that can't be among the best are left out early.
    """
    if include is None:
        slack = 1e-9 if digits is None else 10.0**-digits
        if exclude is not None:  # asked for thresholds and for candidates
            exclude = materialize(exclude.select("query", "doc").distinct(), "excluded")
        scores = pruned_scores(index, queries, query_id, body, cutoff, exclude, slack, **weights)
    else:
        scores = bm25_scores(index, queries, query_id, body, include, exclude, **weights)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return top_rows(scores, ["query"], [F.desc("score"), "doc"], cutoff, "rank")


def retrieve_archive(
    index: Index,
    candidates: DataFrame,
    releases: DataFrame,
    release_id: str,
    body: str,
    until: str = "12h",
    since: str | None = "6 weeks",
    cutoff: int = 10,
    digits: int | None = None,
) -> DataFrame:
    """Background reading for each release: candidates in its time window, ranked by BM25.

    ``candidates`` holds (query, doc, query_time, doc_time), one row per release and document
    that share an entity. Kept are those dated strictly before ``query_time - until`` and
    strictly after ``query_time - since``; a null date drops out. All releases run in one job.
    """
    keep = F.col("doc_time") < F.col("query_time") - F.lit(parse_interval(until))
    if since is not None:
        keep = keep & (F.col("doc_time") > F.col("query_time") - F.lit(parse_interval(since)))
    allowed = candidates.where(keep)
    found = search(index, releases, release_id, body, cutoff, include=allowed, digits=digits)
    return found.join(allowed.select("query", "doc", "doc_time").distinct(), ["query", "doc"])


# ---- TF-IDF ---------------------------------------------------------------------------------------
def tfidf_weights(
    docs: DataFrame,
    doc_id: str,
    body: str,
    min_df: float = 0.001,
    max_df: float = 0.5,
    stop_words: list[str] | None = None,
    fit_docs: DataFrame | None = None,
    fit_id: str | None = None,
) -> DataFrame:
    """(doc, term, weight): L2-normalised TF-IDF with smooth idf.

    Terms in less than ``min_df`` or more than ``max_df`` of the fitted documents drop out, as
    do stop words and one-letter tokens. Fitting uses ``fit_docs`` where given.
    """
    stops = lexicon.STOP_WORDS if stop_words is None else stop_words
    counts = term_counts(docs, doc_id, body, stops).where(F.length("term") > 1)
    fitted = counts if fit_docs is None else term_counts(fit_docs, fit_id or doc_id, body, stops).where(F.length("term") > 1)
    n = (docs if fit_docs is None else fit_docs).select(F.count(F.lit(1))).scalar()
    df = fitted.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).where(
        (F.col("_df") >= n * min_df) & (F.col("_df") <= n * max_df)
    )
    idf = df.select("term", (F.log((1.0 + n) / (1.0 + F.col("_df"))) + 1.0).alias("_idf"))
    idf = materialize(idf, "idf")
    if idf.count() <= IDF_TERMS:
        idf = F.broadcast(idf)  # counts stay where their documents are
    raw = counts.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("_idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc")))  # the terms of one document
    return raw.where(F.col("doc").isNotNull()).select("doc", "term", (F.col("_w") / norm).alias("weight"))


def packed_vectors(weights: DataFrame) -> DataFrame:
    """(doc, terms, weights): one row per vector."""
    known = weights.where(F.col("term").isNotNull() & F.col("weight").isNotNull())
    # the terms of one document
    return known.groupBy("doc").agg(F.collect_list(F.struct("term", "weight")).alias("_v")).select(
        "doc", F.col("_v.term").alias("terms"), F.col("_v.weight").alias("weights")
    )


def _dots(a: str, b: str, name: str):
    """Group function: products of the vectors of each pair, one target's candidates at a time."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        total = np.zeros(len(pairs))
        if len(pairs) and len(vectors):
            code = pc.list_flatten(vectors["terms"]).combine_chunks().dictionary_encode().indices.to_numpy()
            weight = pc.list_flatten(vectors["weights"]).combine_chunks().to_numpy()
            end = np.cumsum(pc.list_value_length(vectors["terms"]).to_numpy())
            start = np.append(0, end[:-1])
            side = vectors["side"].to_numpy()
            of = {}
            for column, ids, sides in ((a, "left", (0, 2)), (b, "right", (1, 2))):
                mine = np.flatnonzero(np.isin(side, sides))
                found = pc.index_in(pairs[column], vectors[ids].take(pa.array(mine)).combine_chunks()).combine_chunks()
                known = found.is_valid().to_numpy(zero_copy_only=False)
                of[column] = np.where(known, mine[found.fill_null(0).to_numpy()] if len(mine) else -1, -1)
            both = np.flatnonzero((of[a] >= 0) & (of[b] >= 0))
            both = both[np.argsort(of[a][both], kind="stable")]
            edges = np.flatnonzero(np.diff(of[a][both], prepend=-1, append=-1))
            dense = np.zeros(int(code.max(initial=0)) + 1)
            for i, j in zip(edges[:-1], edges[1:]):
                left, rows = of[a][both[i]], both[i:j]
                span = slice(start[left], end[left])
                np.add.at(dense, code[span], weight[span])
                for k in range(0, len(rows), 1_000):
                    some = rows[k : k + 1_000]
                    first, n = start[of[b][some]], end[of[b][some]] - start[of[b][some]]
                    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    total[some] = np.bincount(np.repeat(np.arange(len(some)), n), dense[code[at]] * weight[at], len(some))
                dense[code[span]] = 0.0
        return pa.table({a: pairs[a], b: pairs[b], name: pa.array(total)})

    return run


def pair_cosines(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, name: str = "cosine") -> DataFrame:
    """Cosine of two weight vectors for every given pair; 0 when they share no term.

    The pairs lead: sorted by their documents they are cut into pieces of about ``PAIRS_PER_PIECE``, so that a document in very
    many pairs has many pieces. Each piece gets every vector that it needs once, however many of its pairs need it, and no two
    documents are compared that nobody asked for. Terms of pairs never become rows. Both vector tables are
    read several times: store them first.
    """
    keys = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    keys = materialize(keys, "pairs")
    n = max(1, -(-keys.count() // PAIRS_PER_PIECE), keys.sparkSession.sparkContext.defaultParallelism)
    # stored: both readers have to see the same pieces
    keys = materialize(keys.repartitionByRange(n, a, b).withColumn("_piece", F.spark_partition_id()), "pieces")
    asked = lambda c: keys.select(F.col("_piece").alias("_for"), F.col(c).alias("doc"))
    kinds = [keys.schema[c].dataType for c in (a, b)]

    def sent(weights: DataFrame, wanted: DataFrame, side: int) -> DataFrame:
        met = packed_vectors(weights).join(wanted.distinct(), "doc")
        ids = [F.col("doc").try_cast(t) if side in (i, 2) else F.lit(None).cast(t) for i, t in enumerate(kinds)]
        return met.select("_for", F.lit(side).alias("side"), ids[0].alias("left"), ids[1].alias("right"), "terms", "weights")

    if left is right and kinds[0] == kinds[1]:
        vectors = sent(left, asked(a).union(asked(b)), 2)
    else:
        vectors = sent(left, asked(a), 0).unionByName(sent(right, asked(b), 1))
    schema = T.StructType([*keys.select(a, b).schema.fields, T.StructField(name, T.DoubleType())])
    dots = keys.groupBy("_piece").cogroup(vectors.groupBy("_for")).applyInArrow(_dots(a, b, name), schema)
    return pairs.join(dots, [a, b], "left").na.fill(0.0, [name])


def similar_top_k(
    candidates: DataFrame,
    weights: DataFrame,
    target: str,
    candidate: str,
    given_order: str,
    k: int = 10,
    digits: int | None = None,
) -> DataFrame:
    """Best ``k`` candidates of each target by cosine.

    Targets with at most ``k`` candidates keep them all, unknown targets keep the first ``k`` as
    given, and for the others candidates without a vector drop out.
    """
    sizes = candidates.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    known = weights.select(F.col("doc").alias(target)).distinct().withColumn("_known", F.lit(True))
    known_c = weights.select(F.col("doc").alias(candidate)).distinct().withColumn("_known_c", F.lit(True))
    marked = (
        candidates.join(sizes, target).join(known, target, "left").join(known_c, candidate, "left")
        .withColumn("_ranked", F.col("_known").isNotNull() & (F.col("_n") > k))
    )
    as_given = top_rows(marked.where(~F.col("_ranked")), [target], [given_order], k, "rank").select(
        target, candidate, "rank", F.lit(None).cast("double").alias("cosine")
    )
    to_rank = marked.where(F.col("_ranked") & F.col("_known_c").isNotNull()).select(target, candidate)
    scored = pair_cosines(to_rank, weights, weights, target, candidate)
    if digits is not None:
        scored = scored.withColumn("cosine", F.round("cosine", digits))
    best = top_rows(scored, [target], [F.desc("cosine"), candidate], k, "rank")
    return best.select(target, candidate, "rank", "cosine").unionByName(as_given)


# ---- dense vectors -----------------------------------------------------------------------------------
QUERIES_PER_BLOCK = 2_048
VECTORS_PER_BLOCK = 32_768
PRODUCT = 1 << 20  # scores that a task holds at once
KEPT = 4_000_000  # results that the queries of one group keep, unless one block of queries keeps more
QUERIES_PER_GROUP = 65_536


def unit_rows(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows scaled to length 1; a null or zero vector stays zero. ``width`` is needed where all could be null."""
    width = width or max((len(v) for v in vectors if v is not None), default=0)
    rows = np.array([np.zeros(width) if v is None else np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), width)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row, best first, the first of equals first."""
    n = scores.shape[1]
    if k >= n:
        return np.argsort(-scores, axis=1, kind="stable")
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    # what reaches the cut is k columns and those equal to the last of them
    top = np.empty((len(scores), k), np.int64)
    for row, (values, at_least) in enumerate(zip(scores, scores >= cut)):
        columns = np.flatnonzero(at_least)
        top[row] = columns[np.argsort(-values[columns], kind="stable")[:k]]
    return top


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray, k: int, digits: int
) -> pd.DataFrame:
    """Best k of one block of vectors for each query, ties at the cut by smaller id."""
    by_id = np.argsort(doc_ids, kind="stable")
    doc_ids, docs = doc_ids[by_id], docs[by_id]
    width, step = min(k, len(docs)), max(1, PRODUCT // max(1, len(docs)))
    found, values = np.empty((len(queries), width), np.int64), np.empty((len(queries), width))
    for a in range(0, len(queries), step):
        scores = np.round(queries[a : a + step] @ docs.T, digits)
        found[a : a + step] = _best(scores, k)
        values[a : a + step] = np.take_along_axis(scores, found[a : a + step], axis=1)
    return pd.DataFrame({"query": np.repeat(query_ids, width), "doc": doc_ids[found].ravel(), "score": values.ravel()})


def _better(kept: pd.DataFrame | None, new: pd.DataFrame, n_queries: int, k: int) -> pd.DataFrame:
    """Best k per query of two results of ``best_of_block`` for the same queries."""
    if kept is None:
        return new
    wide = lambda c: np.hstack([kept[c].to_numpy().reshape(n_queries, -1), new[c].to_numpy().reshape(n_queries, -1)])
    docs, scores = wide("doc"), wide("score")
    order = np.lexsort((docs, -scores), axis=1)[:, :k]
    return pd.DataFrame(
        {
            "query": np.repeat(kept["query"].to_numpy().reshape(n_queries, -1)[:, 0], order.shape[1]),
            "doc": np.take_along_axis(docs, order, axis=1).ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel(),
        }
    )


def unit_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """``unit_rows`` of an Arrow list column."""
    lengths = pc.list_value_length(vectors)
    rows = np.zeros((len(vectors), width or pc.max(lengths).as_py() or 0))
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    if there.any():
        if pc.min(lengths).as_py() != rows.shape[1] or pc.max(lengths).as_py() != rows.shape[1]:
            raise ValueError("vectors of different lengths")
        rows[there] = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, rows.shape[1])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class Best:
    """The best ``k`` of the vectors that have come by, for a block of queries.

    Vectors come in the order that decides ties, so a later one has to be better than the worst that is kept. What waits to be
    settled is no more than what is kept and one product, so that a group of many blocks holds little besides its results.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self.queries, self.k, self.digits = queries, k, digits
        self.rough = queries.astype(np.float32)
        self.cut = np.full(len(queries), -np.inf)
        self.parts, self.waiting = [], 0  # (row, score, place, id); the first are what was kept last

    def meet(self, vectors: np.ndarray, place: int, ids: np.ndarray, rough: np.ndarray | None = None) -> None:
        """``rough``: the same vectors in single precision, which settles what can't be among the best."""
        rough = vectors.astype(np.float32) if rough is None else rough
        step, a = max(1, PRODUCT // len(self.queries)), 0
        off = (vectors.shape[1] + 4) * 2.0**-23  # twice what a product of unit vectors can be off by in single precision
        while a < len(vectors):
            # thresholds come from few vectors first
            b = min(len(vectors), a + min(step, max(self.k, 64, place + a)))
            least = (self.cut + 0.49 * 10.0**-self.digits)[:, None]
            if np.isfinite(self.cut).all():
                row, column = np.divmod(np.flatnonzero(self.rough @ rough[a:b].T > (least - off).astype(np.float32)), b - a)
                raw = np.concatenate([np.einsum("ij,ij->i", self.queries[row[i : i + 4_096]], vectors[a + column[i : i + 4_096]]) for i in range(0, max(1, len(row)), 4_096)])
                near = raw > least[row, 0]
                row, column, raw = row[near], column[near], raw[near]
            else:
                raw = self.queries @ vectors[a:b].T
                row, column = np.nonzero(raw > least)
                raw = raw[row, column]
            score = np.round(raw, self.digits)
            better = score > self.cut[row]
            row, column, score = row[better], column[better] + a, score[better]
            self.parts.append((row, score, column + place, ids[column]))
            self.waiting += len(row)
            if self.waiting > 2 * len(self.queries) * self.k:
                self.settle()
            a = b

    def settle(self) -> tuple[np.ndarray, ...]:
        """What is kept, by query, best first."""
        row, score, place, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, row))  # stable: equal scores stay as they came
        counts = np.bincount(row, minlength=len(self.queries))
        first = np.cumsum(counts) - counts
        order = order[np.arange(len(row)) - first[row[order]] < self.k]
        kept = row[order], score[order], place[order], ids[order]
        full = counts >= self.k
        ends = np.cumsum(np.minimum(counts, self.k)) - 1
        self.cut[full] = kept[1][ends[full]]
        self.parts, self.waiting = [kept], 0
        return kept


def _plain(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist(), dtype=object) if ids.null_count or not pa.types.is_integer(ids.type) else ids.to_numpy()


def _ranked(ids: pa.Array, blocks: list[Best], size: int, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Result rows of a group of queries; rows of one query id are one query."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    repeated = np.bincount(codes) > 1
    several = []

    def rows(at, score, doc):
        new = np.append(True, codes[at[1:]] != codes[at[:-1]])
        start = np.flatnonzero(new)
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        keep = rank < k
        columns = ids.take(pa.array(at[keep])), pa.array(doc[keep], schema.field("doc").type), score[keep], (rank[keep] + 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    for b, block in enumerate(blocks):
        row, score, place, doc = block.settle()
        block.parts = []
        at = row + b * size
        again = repeated[codes[at]]
        if again.any():
            several.append((at[again], score[again], place[again], doc[again]))
        if not again.all():
            yield rows(at[~again], score[~again], doc[~again])
    if several:
        at, score, place, doc = (np.concatenate(x) for x in zip(*several, strict=True))
        order = np.lexsort((place, -score, codes[at]))
        yield rows(at[order], score[order], doc[order])


def nearest_in_groups(k: int, digits: int, queries_per_block: int, vectors_per_block: int, schema: pa.Schema):
    """Task function over rows sorted by group, queries before vectors, vectors by id."""
    size = min(queries_per_block, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, ids, blocks, place = None, [], None, None, 0
        for batch in batches:
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if g[a] != group:
                    if blocks:
                        yield from _ranked(ids, blocks, size, k, schema)
                    group, asked, ids, blocks, place = g[a], [], None, None, 0
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    asked.append((rows.column(2), rows.column(4)))
                    continue
                if not asked and blocks is None:
                    continue  # nobody asks in this group
                if blocks is None:
                    ids = pa.concat_arrays([x[0] for x in asked])
                    given = pa.concat_arrays([x[1] for x in asked])
                    matrix = unit_matrix(given, pc.max(pc.list_value_length(rows.column(4))).as_py() or 0)
                    blocks, asked = [Best(matrix[i : i + size], k, digits) for i in range(0, len(ids), size)], []
                    width = matrix.shape[1]
                for c in range(0, b - a, vectors_per_block):
                    part = rows.slice(c, vectors_per_block)
                    vectors, doc = unit_matrix(part.column(4), width), _plain(part.column(3))
                    rough, width = vectors.astype(np.float32), vectors.shape[1]
                    for block in blocks:
                        if not block.queries.shape[1]:  # nulls only, so far on both sides
                            block.queries, block.rough = (np.zeros((len(block.queries), width), t) for t in (np.float64, np.float32))
                        block.meet(vectors, place, doc, rough)
                    place += len(doc)
        if blocks:
            yield from _ranked(ids, blocks, size, k, schema)

    return run


def dense_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    query_id: str,
    vector_id: str,
    vector: str,
    k: int = 1_000,
    digits: int = 6,
    queries_per_block: int = QUERIES_PER_BLOCK,
    vectors_per_block: int = VECTORS_PER_BLOCK,
) -> DataFrame:
    """The ``k`` nearest vectors of each query by cosine, exactly.

    Up to ``queries_per_block`` queries (the count is checked) travel to the tasks as one small matrix, the vectors stay
    where they are, and a task hands on its best ``k`` per query. More queries are dealt into groups, as many as there are
    cores or as bounded results call for. All vectors stream past each group in order of their id, at most
    ``vectors_per_block`` at a time, so a task holds the best so far and one product of at most ``PRODUCT`` scores, and no scores are shuffled.
    """
    q = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("vector"))
    v = vectors.select(F.col(vector_id).alias("doc"), F.col(vector).alias("vector"))
    out = T.StructType(
        [
            T.StructField("query", q.schema["query"].dataType),
            T.StructField("doc", v.schema["doc"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    n_queries = q.count()
    if n_queries <= queries_per_block:
        table = q.toPandas()
        ids, matrix = table["query"].to_numpy(), unit_rows(table["vector"])
        sent = q.sparkSession.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (ids, matrix), best = sent.value, None
            for docs in batches:
                if len(docs) and len(ids):
                    found = best_of_block(ids, matrix, docs["doc"].to_numpy(), unit_rows(docs["vector"], matrix.shape[1]), k, digits)
                    best = _better(best, found, len(ids), k)
            if best is not None:
                yield best

        best = v.mapInPandas(score, out)
    else:
        per_group = min(QUERIES_PER_GROUP, max(queries_per_block, KEPT // k))
        n = max(q.sparkSession.sparkContext.defaultParallelism, -(-n_queries // per_group))
        kinds = {c: d.schema[c].dataType for c, d in (("query", q), ("doc", v))}
        row = lambda df, kind, g: df.select(
            g.alias("_g"), F.lit(kind).alias("_kind"),
            *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()], "vector",
        )
        asked = row(q, 0, F.pmod(F.xxhash64("query"), F.lit(n)).cast("int"))
        met = row(v, 1, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        dealt = asked.unionByName(met).repartitionById(n, F.col("_g")).sortWithinPartitions("_g", "_kind", "doc")
        ranked = T.StructType([*out.fields, T.StructField("rank", T.IntegerType())])
        return dealt.mapInArrow(nearest_in_groups(k, digits, queries_per_block, vectors_per_block, to_arrow_schema(ranked)), ranked)
    return top_rows(best, ["query"], [F.desc("score"), "doc"], k, "rank")


def hard_negatives(
    retrieved: DataFrame,
    query_times: DataFrame,
    doc_times: DataFrame,
    days: int = 60,
    first: int = 10,
    seed: int = 0,
) -> DataFrame:
    """One wrong but plausible document per query.

    ``retrieved`` is (query, doc, rank), the two time tables are (query, query_time) and
    (doc, doc_time). From what is not the query itself and dated in (t - days, t], the first
    ten by rank qualify; one is picked by a seeded hash. A query without any is skipped.
    """
    since = F.col("query_time") - F.make_dt_interval(F.lit(days))
    dated = (
        retrieved.where(F.col("doc") != F.col("query")).join(query_times, "query").join(doc_times, "doc")
        .where((F.col("doc_time") <= F.col("query_time")) & (F.col("doc_time") > since))
    )
    near = top_rows(dated, ["query"], ["rank"], first, "_rn")
    return top_rows(near.withColumn("_draw", draw(seed, "query", "doc")), ["query"], ["_draw", "doc"], 1, "_pick").select(
        "query", "doc", "rank"
    )


def row_pair_cosines(df: DataFrame, row_id: str, a: str, b: str, name: str = "cosine", **fit) -> DataFrame:
    """Cosine of two texts of the same row under one TF-IDF fitted on both columns' distinct texts."""
    both = F.explode(F.array(F.col(a), F.col(b)))
    texts = df.select(both.alias("_body")).where(F.col("_body").isNotNull()).distinct()
    fitted = texts.withColumn("_id", F.xxhash64("_body"))
    side = lambda c: tfidf_weights(
        df.select(row_id, F.coalesce(F.col(c), F.lit("")).alias(c)), row_id, c,
        fit_docs=fitted.select("_id", F.col("_body").alias(c)), **{"fit_id": "_id", **fit},
    )
    left, right = side(a), side(b)
    dots = left.alias("l").join(right.alias("r"), ["doc", "term"]).groupBy("doc").agg(
        F.sum(F.col("l.weight") * F.col("r.weight")).alias(name)
    )
    return df.join(dots.withColumnRenamed("doc", row_id), row_id, "left").na.fill(0.0, [name])
