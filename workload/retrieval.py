"""Ranking and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions.text import sentences
from tidings.operators import evaluate, halving, joins, retrieval, vector_index
from tidings.plans.shape import unpack
from tidings.plans.storage import materialize
from workload.registry import query, words_sql

BM25_SQL = f"""
tok AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT doc_id, len({words_sql('text')}) AS l FROM documents),
rel AS (SELECT doc_id, l / (SELECT avg(l) FROM len) AS rl FROM len),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)"""
GAIN_SQL = "sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * rl)))"


def _index(t):
    return retrieval.build_index(t.spread("documents", "doc_id"), "doc_id", "text")


@query(f"""
WITH {BM25_SQL} SELECT term, doc_id AS doc, tf, round(rl, 6) AS rel_len, df FROM tf JOIN rel USING (doc_id) JOIN df USING (term)""")
def inverted_index(t):
    index = _index(t)
    return index.postings.join(index.frequencies, "term").withColumn("rel_len", F.round("rel_len", 6))


@query(f"""
WITH {BM25_SQL}, s AS (SELECT item_id, doc_id, round({GAIN_SQL}, 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN rel USING (doc_id), n GROUP BY item_id, doc_id)
SELECT item_id AS "query", doc_id AS doc, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 10""")
def bm25_top10(t):
    return retrieval.search(_index(t), t.benchmark, "item_id", "text", cutoff=10, digits=6)


def _long_word_pairs(t):
    """(query, doc) pairs that share a word of ten letters or more."""
    from tidings.functions import text

    long_words = F.filter(text.tokens(F.col("text")), lambda w: F.length(w) > 9)
    # stored: long words are counted and joined
    rows = materialize(joins.entity_rows(t.spread("documents", "doc_id"), "doc_id", long_words, one_row_per_doc=True), "long-words")
    return joins.entity_overlap(joins.entity_rows(t.benchmark, "item_id", long_words, one_row_per_doc=True), rows).select(
        F.col("target").alias("query"), F.col("archive").alias("doc")
    )


FILTERED_SQL = f"""
WITH {BM25_SQL}, long AS (SELECT DISTINCT q.item_id, tf.doc_id FROM q JOIN tf USING (term) WHERE length(term) > 9),
s AS (SELECT item_id, doc_id, round({GAIN_SQL}, 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN rel USING (doc_id) JOIN documents d USING (doc_id), n
  WHERE {{where}} GROUP BY item_id, doc_id)
SELECT item_id AS "query", doc_id AS doc, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 10"""


@query(FILTERED_SQL.replace("{where}", "(item_id, doc_id) IN (FROM long) AND lang <> 'de'"))
def bm25_filtered(t):
    allowed = materialize(_long_word_pairs(t), "allowed")
    german = allowed.join(t.documents.where("lang = 'de'").select(F.col("doc_id").alias("doc")), "doc")
    return retrieval.search(
        _index(t), t.benchmark, "item_id", "text", cutoff=10, digits=6, include=allowed, exclude=german
    )


@query(FILTERED_SQL.replace("{where}", "(item_id, doc_id) NOT IN (FROM long)"))
def bm25_excluding(t):
    return retrieval.search(
        _index(t), t.benchmark, "item_id", "text", cutoff=10, digits=6, exclude=_long_word_pairs(t)
    )


@query(f"""
WITH {BM25_SQL}, ent AS (SELECT DISTINCT doc_id, term FROM tok WHERE length(term) > 9), 
d AS (SELECT doc_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id * 37 % 2400) AS ts FROM documents),
rq AS (SELECT item_id, TIMESTAMP '2024-03-01' + INTERVAL 1 HOUR * (item_id * 7) AS ts FROM benchmark),
c AS (SELECT DISTINCT q.item_id, ent.doc_id FROM q JOIN ent USING (term) JOIN d USING (doc_id) JOIN rq ON rq.item_id = q.item_id
      WHERE d.ts < rq.ts - INTERVAL 12 HOURS AND d.ts > rq.ts - INTERVAL 42 DAYS),
s AS (SELECT item_id, doc_id, round({GAIN_SQL}, 6) AS score
  FROM c JOIN q USING (item_id) JOIN tf USING (doc_id, term) JOIN df USING (term) JOIN rel USING (doc_id), n GROUP BY item_id, doc_id)
SELECT item_id AS "query", doc_id AS doc, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       strftime(d.ts, '%Y-%m-%d %H') AS doc_time FROM s JOIN d USING (doc_id) QUALIFY rank <= 10""")
def retrieve_archive(t):
    """Candidates share a long word with the release and lie in its time window; dates come from the ids."""
    at = lambda start, hours: F.lit(start).cast("timestamp") + F.make_dt_interval(hours=hours.cast("int"))
    releases = t.benchmark.select(F.col("item_id").alias("query"), at("2024-03-01", F.col("item_id") * 7).alias("query_time"))
    dated = t.documents.select(F.col("doc_id").alias("doc"), at("2024-01-01", F.col("doc_id") * 37 % 2400).alias("doc_time"))
    shared = _long_word_pairs(t)
    candidates = shared.join(releases, "query").join(dated, "doc")
    out = retrieval.retrieve_archive(_index(t), candidates, t.benchmark, "item_id", "text", digits=6)
    return out.withColumn("doc_time", F.date_format("doc_time", "yyyy-MM-dd HH"))


STOPS = ["the", "of", "and", "in", "de", "la"]
TFIDF_SQL = f"""
tok AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) > 1 AND term NOT IN ('the', 'of', 'and', 'in', 'de', 'la') GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 0.002 * (SELECT n FROM n) AND count(*) <= 0.5 * (SELECT n FROM n)),
raw AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


def _tfidf(t):
    return retrieval.tfidf_weights(t.spread("documents", "doc_id"), "doc_id", "text", min_df=0.002, stop_words=STOPS)


@query(f"WITH {TFIDF_SQL} SELECT doc_id AS doc, term, round(w, 6) AS weight FROM tfidf")
def tfidf_weights(t):
    return _tfidf(t).withColumn("weight", F.round("weight", 6))


CANDIDATES_SQL = """
c AS (SELECT a.doc_id AS target, b.doc_id AS candidate FROM documents a JOIN documents b
      ON a.source = b.source AND a.lang = b.lang AND abs(a.doc_id - b.doc_id) <= 400 AND a.doc_id <> b.doc_id)"""


def _candidates(t):
    """Documents of the same source and language whose ids lie near, matched through id buckets."""
    docs = t.documents.select("source", "lang", "doc_id", F.floor(F.col("doc_id") / 400).alias("b"))
    near = docs.select("source", "lang", F.col("doc_id").alias("candidate"), F.explode(F.array(*[F.col("b") + i for i in (-1, 0, 1)])).alias("b"))
    gap = F.abs(F.col("doc_id") - F.col("candidate"))
    return docs.join(near, ["source", "lang", "b"]).where((gap <= 400) & (gap > 0)).select(
        F.col("doc_id").alias("target"), "candidate"
    )


@query(f"""
WITH {TFIDF_SQL}, {CANDIDATES_SQL}
SELECT target, candidate, round(coalesce(sum(x.w * y.w), 0), 6) AS cosine FROM c
LEFT JOIN tfidf x ON x.doc_id = target LEFT JOIN tfidf y ON y.doc_id = candidate AND y.term = x.term GROUP BY target, candidate""")
def pair_cosines(t):
    weights = materialize(_tfidf(t), "vectors")
    out = retrieval.pair_cosines(_candidates(t), weights, weights, "target", "candidate")
    return out.withColumn("cosine", F.round("cosine", 6))


@query(f"""
WITH {TFIDF_SQL}, {CANDIDATES_SQL}, many AS (SELECT target FROM c GROUP BY target HAVING count(*) > 10),
vec AS (SELECT DISTINCT doc_id FROM tfidf),
s AS (SELECT target, candidate, round(coalesce(sum(x.w * y.w), 0), 6) AS cosine FROM c
  LEFT JOIN tfidf x ON x.doc_id = target LEFT JOIN tfidf y ON y.doc_id = candidate AND y.term = x.term
  WHERE target IN (FROM many) AND target IN (FROM vec) AND candidate IN (FROM vec) GROUP BY target, candidate)
SELECT target, candidate, cosine, CAST(row_number() OVER (PARTITION BY target ORDER BY cosine DESC, candidate) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
UNION ALL
SELECT target, candidate, -1, CAST(row_number() OVER (PARTITION BY target ORDER BY candidate) AS INTEGER) AS rank FROM c
WHERE NOT (target IN (FROM many) AND target IN (FROM vec)) QUALIFY rank <= 10""")
def similar_top_k(t):
    given = _candidates(t).withColumn("position", F.col("candidate"))
    out = retrieval.similar_top_k(given, materialize(_tfidf(t), "vectors"), "target", "candidate", "position", digits=6)
    return out.withColumn("cosine", F.coalesce("cosine", F.lit(-1.0)))


@query(f"""
WITH p AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS a,
                  string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id),
fit AS (SELECT a AS body FROM p WHERE a IS NOT NULL UNION SELECT b FROM p WHERE b IS NOT NULL),
fterm AS (SELECT DISTINCT body, unnest({words_sql('body')}) AS term FROM fit),
n AS (SELECT count(*) AS n FROM fit),
df AS (SELECT term, count(*) AS df FROM fterm WHERE length(term) > 1 GROUP BY term HAVING count(*) >= 0.001 * (SELECT n FROM n) AND count(*) <= 0.5 * (SELECT n FROM n)),
ta AS (SELECT conv_id, term, count(*) AS tf FROM (SELECT conv_id, unnest({words_sql('a')}) AS term FROM p) GROUP BY ALL),
tb AS (SELECT conv_id, term, count(*) AS tf FROM (SELECT conv_id, unnest({words_sql('b')}) AS term FROM p) GROUP BY ALL),
wa AS (SELECT conv_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM ta JOIN df USING (term), n),
wb AS (SELECT conv_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tb JOIN df USING (term), n),
na AS (SELECT conv_id, sqrt(sum(w * w)) AS l FROM wa GROUP BY conv_id), nb AS (SELECT conv_id, sqrt(sum(w * w)) AS l FROM wb GROUP BY conv_id),
dot AS (SELECT conv_id, sum(wa.w * wb.w) AS d FROM wa JOIN wb USING (conv_id, term) GROUP BY conv_id)
SELECT conv_id, round(coalesce(d / (na.l * nb.l), 0), 6) AS cosine FROM p LEFT JOIN dot USING (conv_id) LEFT JOIN na USING (conv_id) LEFT JOIN nb USING (conv_id)""")
def row_pair_cosines(t):
    from tidings.operators.aggregates import passages_by_label

    passages = passages_by_label(t.conversations, "conv_id", "role", "text", "turn")
    wide = passages.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("passage"))).alias("a"),
        F.max(F.when(F.col("role") == "assistant", F.col("passage"))).alias("b"),
    )
    out = retrieval.row_pair_cosines(wide, "conv_id", "a", "b", stop_words=[])
    return out.select("conv_id", F.round("cosine", 6).alias("cosine"))


DENSE_SQL = """
s AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a, embeddings b),
top AS (SELECT q, d, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS INTEGER) AS rank FROM s QUALIFY rank <= {k})"""


@query(f"""WITH {DENSE_SQL.format(k=20)} SELECT q AS "query", d AS doc, score, rank FROM top""")
def dense_top_k(t):
    return retrieval.dense_top_k(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", k=20)


@query(f"""WITH {DENSE_SQL.format(k=20)} SELECT q AS "query", d AS doc, score, rank FROM top""")
def dense_top_k_blocks(t):
    """The same with more queries than one block holds."""
    return retrieval.dense_top_k(
        t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", k=20, queries_per_block=400, vectors_per_block=1500
    )


@query()
def vector_index_top20(t):
    """Every hundredth vector against all, through cells; as many are probed as 95 % of the true neighbours take."""
    index = vector_index.build_vector_index(t.embeddings, "vec_id", "embedding")
    probes = vector_index.probes_for(index, 20, recall=0.95)
    return vector_index.search_vectors(index, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 20, probes)


@query(f"""WITH {DENSE_SQL.format(k=1000)},
tm AS (SELECT vec_id, TIMESTAMP '2024-01-01' + to_days(CAST(vec_id * 13 % 365 AS INTEGER)) AS at FROM embeddings),
ok AS (SELECT q, d, rank, row_number() OVER (PARTITION BY q ORDER BY rank) AS rn FROM top JOIN tm a ON a.vec_id = q JOIN tm b ON b.vec_id = d
       WHERE d <> q AND b.at <= a.at AND b.at > a.at - INTERVAL 60 DAY),
pick AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CAST('0x' || substr(md5('5:' || q || ':' || d), 1, 13) AS BIGINT), d) AS k FROM ok WHERE rn <= 10)
SELECT q AS "query", d AS doc, rank FROM pick WHERE k = 1""")
def hard_negatives(t):
    times = t.embeddings.select(
        "vec_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("vec_id") * 13 % 365).cast("int"))).alias("at")
    )
    found = retrieval.dense_top_k(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", k=1000)
    return retrieval.hard_negatives(
        found, times.select(F.col("vec_id").alias("query"), F.col("at").alias("query_time")),
        times.select(F.col("vec_id").alias("doc"), F.col("at").alias("doc_time")), seed=5,
    )


# ---- classification -----------------------------------------------------------------------------------------
@query()
def text_classifier(t):
    from tidings.operators.aggregates import split_rows

    rows = t.spread("documents", "doc_id").select("doc_id", "text", "lang")
    marked = split_rows(rows, "doc_id", seed=1)
    return evaluate.evaluate_text_classifier(
        marked.where("split = 'train'"), marked.where("split = 'test'"), "text", "lang"
    )


def _label_features(t):
    """Labelled documents with three numbers to judge them by."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars", "text"), "doc_id")
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / F.greatest(F.col("n_chars"), F.lit(1))
    return rows.select(
        F.col("doc_id").alias("article_url"), (F.col("doc_id") % 10).alias("press_release_url"),
        F.log1p("n_chars").alias("contradiction"), share(r"[^\p{L}\s]").alias("entailment"), share(r"\s").alias("neutral"),
        F.col("quality").alias("y_true_q1"), F.col("toxic").alias("y_true_q2"),
        ((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("int").alias("y_true_both"),
    )


@query()
def verdict_classifier(t):
    return evaluate.verdict_classifier(materialize(_label_features(t)), "article_url", splits=2)


def _sentence_scores(t):
    """Three numbers for every sentence of the labelled documents, five sentences to a passage."""
    rows = unpack(t.labels.select("doc_id").join(t.documents.select("doc_id", "text"), "doc_id"), ["doc_id"], sentences(F.col("text")), "s", "at")
    share = lambda pattern: F.regexp_count("s", F.lit(pattern)) / F.length("s")
    return rows.select(
        F.col("doc_id").alias("article_url"), (F.col("doc_id") % 10).alias("press_release_url"), F.floor(F.col("at") / 5).alias("press_release_idx"),
        share(r"[^\p{L}\s]").alias("contradiction"), share(r"\s").alias("entailment"), F.log1p(F.length("s")).alias("neutral"),
    )


@query()
def parameter_halving(t):
    """All 216 settings of the k values over all labelled documents."""
    out = halving.halving_search(materialize(_sentence_scores(t), "pairs"), _label_features(t), "article_url", inner=(1, 3), outer=(1, 5, 25))
    return out.withColumns({"f1": F.round("f1", 6), "log_loss": F.round("log_loss", 6)})
