"""Counts, shares, distributions, lists and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import arrays, text
from tidings.operators import aggregates as agg
from tidings.operators import reports
from tidings.plans.shape import hold
from workload.registry import query, words_sql

LANGS = ["en", "fr", "de", "es"]


@query("""
SELECT (SELECT count(*) FROM documents) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_distinct""")
def row_counts(t):
    cols = t.documents.select("text", "lang", "source")
    distinct = agg.count_rows(cols, distinct=True).scalar()
    return agg.count_rows(cols).select(F.col("n").alias("n_rows"), distinct.alias("n_distinct"))


@query("SELECT CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels")
def flag_sums(t):
    return agg.sum_flags(t.labels, "quality", "toxic")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def source_lang_counts(t):
    return agg.group_count(t.documents, "source", "lang")


@query("""
SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr,
       count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es
FROM documents GROUP BY source""")
def source_lang_pivot(t):
    return agg.pivot_counts(t.documents, "source", "lang", LANGS)


@query("""
SELECT source, round(avg(quality), 6) AS quality_rate FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def flag_rates(t):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return agg.rate_by_group(rows, "source", "quality").select("source", F.round("rate", 6).alias("quality_rate"))


@query("""
SELECT o_orderpriority, round(avg(year(o_orderdate)), 6) AS mean_year, median(year(o_orderdate)) AS median_year
FROM orders GROUP BY o_orderpriority""")
def year_stats(t):
    return agg.year_stats(t.orders, "o_orderpriority", "o_orderdate").select(
        "o_orderpriority", F.round("mean_year", 6).alias("mean_year"), "median_year"
    )


@query("""
SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 25""")
def value_counts_top(t):
    return agg.value_counts(t.events, "user_id", 25)


@query("SELECT lang, round(count(*) / (SELECT count(*) FROM documents), 8) AS share FROM documents GROUP BY lang")
def lang_shares(t):
    return agg.value_shares(t.documents, "lang").select("lang", F.round("share", 8).alias("share"))


@query(f"""
WITH tok AS (SELECT unnest({words_sql('text')}) AS ent FROM documents)
SELECT ent, round(count(*) / (SELECT count(*) FROM tok), 8) AS share FROM tok
GROUP BY ent HAVING count(*) / (SELECT count(*) FROM tok) > 0.01""")
def frequent_terms_by_mention(t):
    docs = t.spread("documents", "doc_id").select(text.tokens(F.col("text")).alias("terms"))
    return agg.frequent_by_mentions(docs, "terms").select("ent", F.round("share", 8).alias("share"))


@query(f"""
WITH tok AS (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS ent FROM documents),
shares AS (SELECT ent, count(*) / (SELECT count(*) FROM documents) AS share FROM tok WHERE ent NOT IN ('the', 'of')
           GROUP BY ent)
SELECT ent, round(share, 8) AS share FROM shares WHERE share > 0.03""")
def frequent_terms_by_document(t):
    from tidings.operators.joins import entity_rows

    docs = t.spread("documents", "doc_id")
    rows = entity_rows(docs, "doc_id", text.tokens(F.col("text")), one_row_per_doc=True)
    known = rows.sparkSession.createDataFrame([("the",), ("of",)], "ent string")
    n = t.documents.select(F.count(F.lit(1))).scalar()
    return agg.frequent_by_documents(rows, n, known).select("ent", F.round("share", 8).alias("share"))


@query(f"""
SELECT term, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS term FROM documents)
GROUP BY term ORDER BY n DESC, term LIMIT 3""")
def top_terms(t):
    return agg.value_counts(t.spread("documents", "doc_id").select(F.explode_outer(text.tokens(F.col("text"))).alias("term")), "term", 3)


@query("""
SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS texts
FROM conversations GROUP BY conv_id""")
def ordered_lists(t):
    return agg.ordered_lists(t.conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", F.array_join("role", "|").alias("roles"), F.md5(F.array_join("text", "|")).alias("texts")
    )


@query("""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys
FROM orders GROUP BY o_custkey""")
def collected_lists(t):
    return agg.collect_by_key(t.orders, "o_custkey", "o_orderkey").select(
        "o_custkey", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("order_keys")
    )


@query(f"""
WITH tok AS (SELECT DISTINCT lang, unnest({words_sql('text')}) AS term FROM documents)
SELECT lang, count(*) AS n_terms, md5(string_agg(term, ' ' ORDER BY term)) AS terms FROM tok GROUP BY lang""")
def list_union(t):
    docs = t.spread("documents", "doc_id").select("lang", text.tokens(F.col("text")).alias("terms"))
    return agg.union_lists(docs, "lang", "terms").select(
        "lang", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms")
    )


@query("""
SELECT size, count(*) AS n FROM
  (SELECT o_custkey, count(DISTINCT o_orderpriority) AS size FROM orders GROUP BY o_custkey) GROUP BY size""")
def set_size_distribution(t):
    return agg.set_size_distribution(t.orders, "o_custkey", "o_orderpriority")


@query("""
WITH s AS (SELECT conv_id, nullif(role, 'system') AS role FROM conversations)
SELECT conv_id, coalesce(count(DISTINCT role), 0) AS n_sources,
       (SELECT count(*) FROM (SELECT DISTINCT role FROM s x WHERE x.conv_id = s.conv_id)) - 1 AS n_with_null
FROM s GROUP BY conv_id HAVING count(DISTINCT role) > 0""")
def sources_per_document(t):
    rows = t.conversations.withColumn("role", F.nullif("role", F.lit("system")))
    plain = agg.sources_per_document(rows, "conv_id", "role")
    with_null = agg.sources_per_document(rows, "conv_id", "role", count_null=True)
    return plain.join(with_null.withColumnRenamed("n_sources", "n_with_null"), "conv_id")


@query("SELECT count(DISTINCT text) AS n FROM documents")
def distinct_texts(t):
    return agg.n_unique(t.documents, "text")


@query("""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|||' ORDER BY o_orderdate, o_orderkey) AS keys
FROM orders GROUP BY o_custkey""")
def group_concat(t):
    ordered = t.orders.select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("o"))
    return agg.concat_by_key(ordered, "o_custkey", "o_orderkey", "o", "|||", "keys")


@query("""
SELECT conv_id, role, md5(string_agg(text, ' ' ORDER BY turn)) AS passage FROM conversations GROUP BY conv_id, role""")
def passages_by_label(t):
    out = agg.passages_by_label(t.conversations, "conv_id", "role", "text", "turn")
    return out.select("conv_id", "role", F.md5("passage").alias("passage"))


@query("""
SELECT l_orderkey, CAST(max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS INTEGER) AS referenced
FROM lineitem GROUP BY l_orderkey""")
def sentence_referenced(t):
    return agg.sentence_referenced(t.lineitem, ["l_orderkey"], F.col("l_discount") > 0.08)


@query("""
WITH s AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 400 THEN 1 ELSE 0 END AS hit FROM conversations)
SELECT role, round(avg(hit), 6) AS rate FROM s GROUP BY role""")
def referenced_by_label(t):
    out = reports.referenced_by_label(t.conversations, ["conv_id", "turn"], "role", F.length("text") > 400)
    return out.select("role", F.round("rate", 6).alias("rate"))


ROLL_UP_SQL = """
WITH long AS (
  SELECT l_suppkey, l_returnflag, l_linenumber, 'contradiction' AS score, l_discount AS v FROM lineitem UNION ALL
  SELECT l_suppkey, l_returnflag, l_linenumber, 'entailment', l_tax FROM lineitem UNION ALL
  SELECT l_suppkey, l_returnflag, l_linenumber, 'neutral', l_quantity FROM lineitem),
r1 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber, score
         ORDER BY CASE WHEN score = 'neutral' THEN v ELSE -v END) AS rn FROM long),
l1 AS (SELECT l_suppkey, l_returnflag, l_linenumber, score, avg(v) AS v FROM r1 WHERE rn <= 3
       GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, score ORDER BY v DESC) AS rn FROM l1)
SELECT l_suppkey, l_returnflag,
       round(avg(v) FILTER (score = 'contradiction' AND rn <= 8), 6) AS contradiction,
       round(avg(v) FILTER (score = 'entailment' AND rn <= 8), 6) AS entailment,
       round(median(v) FILTER (score = 'neutral'), 6) AS neutral
FROM r2 GROUP BY l_suppkey, l_returnflag"""


def _scores(t):
    return t.lineitem.select(
        "l_suppkey", "l_returnflag", "l_linenumber", F.col("l_discount").alias("contradiction"),
        F.col("l_tax").alias("entailment"), F.col("l_quantity").alias("neutral"),
    )


@query(ROLL_UP_SQL)
def two_level_scores(t):
    out = agg.two_level_scores(_scores(t), ["l_suppkey", "l_returnflag"], "l_linenumber")
    return out.select(
        "l_suppkey", "l_returnflag", *[F.round(c, 6).alias(c) for c in ("contradiction", "entailment", "neutral")]
    )


@query("""
WITH l1 AS (SELECT l_suppkey, l_returnflag, l_linenumber, avg(l_discount) AS c, median(l_tax) AS e
            FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, round(avg(c), 6) AS contradiction, round(median(e), 6) AS entailment
FROM l1 GROUP BY ALL""")
def two_level_means(t):
    methods = {"contradiction": ("mean", None), "entailment": ("median", None)}
    out = agg.two_level_scores(_scores(t), ["l_suppkey", "l_returnflag"], "l_linenumber", methods, methods)
    return out.select("l_suppkey", "l_returnflag", *[F.round(c, 6).alias(c) for c in methods])


@query("""
WITH long AS (
  SELECT l_suppkey, l_returnflag, l_linenumber, 'contradiction' AS score, -l_discount AS o, l_discount AS v FROM lineitem
  UNION ALL SELECT l_suppkey, l_returnflag, l_linenumber, 'entailment', -l_tax, l_tax FROM lineitem
  UNION ALL SELECT l_suppkey, l_returnflag, l_linenumber, 'neutral', l_quantity, l_quantity FROM lineitem),
r1 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber, score ORDER BY o) AS rn FROM long),
ks AS (SELECT unnest([2, 5]) AS inner_k), os AS (SELECT unnest([3, 10]) AS outer_k),
l1 AS (SELECT l_suppkey, l_returnflag, l_linenumber, score, inner_k, avg(v) AS v FROM r1 JOIN ks ON rn <= inner_k GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, score, inner_k ORDER BY v DESC) AS rn FROM l1)
SELECT l_suppkey, l_returnflag, score, inner_k, outer_k,
       round(CASE WHEN score = 'neutral' THEN median(v) ELSE avg(v) FILTER (rn <= outer_k) END, 6) AS value
FROM r2 CROSS JOIN os GROUP BY l_suppkey, l_returnflag, score, inner_k, outer_k""")
def roll_up_grid(t):
    from tidings.operators.evaluate import roll_up_grid as grid

    out = grid(_scores(t), [2, 5], [3, 10], ["l_suppkey", "l_returnflag"], "l_linenumber")
    return out.withColumn("value", F.round("value", 6))


@query("""
SELECT CAST(least(floor(n_chars * 50.0 / 2000), 49) AS INTEGER) AS bin, count(*) AS n
FROM documents WHERE n_chars BETWEEN 0 AND 2000 GROUP BY bin""")
def length_histogram(t):
    return agg.histogram(t.documents, "n_chars", 0, 2000, 50)


@query("""
SELECT lang, CAST(min(n_chars) AS DOUBLE) AS "min", quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median,
       quantile_cont(n_chars, 0.75) AS q3, CAST(max(n_chars) AS DOUBLE) AS "max" FROM documents GROUP BY lang""")
def box_summary(t):
    return agg.box_summary(t.documents, "lang", "n_chars")


@query("""
SELECT round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem""")
def price_percentiles(t):
    out = agg.exact_percentiles(t.lineitem, None, "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select(*[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")])


@query("""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a,
                  count(*) FILTER (role = 'system') AS s FROM conversations GROUP BY conv_id)
SELECT round(avg(u), 6) AS "user", round(avg(a), 6) AS assistant, round(avg(s), 6) AS system FROM c""")
def label_profile(t):
    roles = ["user", "assistant", "system"]
    out = agg.mean_label_profile(t.conversations, "conv_id", "role", roles)
    return out.select(*[F.round(r, 6).alias(r) for r in roles])


@query("SELECT round(avg(n), 6) AS mean_size FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def mean_group_size(t):
    return agg.mean_group_size(t.conversations, "conv_id").select(F.round("mean_size", 6).alias("mean_size"))


@query("SELECT min(o_totalprice) AS \"min\", max(o_totalprice) AS \"max\" FROM orders")
def price_range(t):
    return agg.min_max(t.orders, "o_totalprice")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def having_count(t):
    return agg.having_count(t.orders, "o_custkey", 2)


@query("""
WITH want AS (SELECT DISTINCT event_type AS outlet, user_id AS url FROM events),
have AS (SELECT event_type AS outlet, user_id AS url FROM events WHERE value > 60),
missing AS (SELECT * FROM want WHERE (outlet, url) NOT IN (SELECT outlet, url FROM have))
SELECT outlet, n_to_fetch, coalesce(n_fetched, 0) AS n_fetched, coalesce(n_outstanding, 0) AS n_outstanding
FROM (SELECT outlet, count(*) AS n_to_fetch FROM want GROUP BY outlet)
LEFT JOIN (SELECT outlet, count(*) AS n_fetched FROM have GROUP BY outlet) USING (outlet)
LEFT JOIN (SELECT outlet, count(*) AS n_outstanding FROM missing GROUP BY outlet) USING (outlet)""")
def fetch_audit(t):
    rows = t.events.select(F.col("event_type").alias("outlet"), F.col("user_id").alias("url"), "value")
    return agg.fetch_audit(rows, rows.where("value > 60"))


@query(f"""
WITH tok AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents),
rep AS (SELECT doc_id, term FROM tok GROUP BY doc_id, term HAVING count(*) > 1)
SELECT doc_id, count(*) AS n, md5(string_agg(term, ' ' ORDER BY term)) AS terms FROM rep GROUP BY doc_id""")
def repeated_terms(t):
    tokens = hold(t.spread("documents", "doc_id").select("doc_id", "text"), w=text.tokens(F.col("text")))
    rep = hold(tokens, r=arrays.repeated_elements(F.col("w")))
    return rep.where(F.size("r") > 0).select(
        "doc_id", F.size("r").cast("long").alias("n"), F.md5(F.array_join("r", " ")).alias("terms")
    )


LABELLED_SQL = """lab AS (SELECT quality AS truth, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS predicted, n_chars AS score
FROM labels JOIN documents USING (doc_id))"""


def _labelled(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("predicted"),
        F.col("n_chars").alias("score"),
    )


@query(f"""
WITH {LABELLED_SQL}, classes AS (SELECT truth AS label FROM lab UNION SELECT predicted FROM lab),
f AS (SELECT label, 2.0 * count(*) FILTER (truth = label AND predicted = label)
        / (count(*) FILTER (truth = label) + count(*) FILTER (predicted = label)) AS f1
      FROM lab, classes GROUP BY label)
SELECT round(avg(f1), 6) AS macro_f1 FROM f""")
def macro_f1(t):
    return agg.macro_f1(_labelled(t), "truth", "predicted").select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""
WITH {LABELLED_SQL}, n AS (SELECT count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS q FROM lab)
SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / min(p * q), 6) AS auc
FROM lab a, lab b, n WHERE a.truth = 1 AND b.truth = 0""")
def roc_auc(t):
    return agg.roc_auc(_labelled(t), "truth", "score").select(F.round("auc", 6).alias("auc"))


@query(f"SELECT CAST(sum(len({words_sql('text')})) AS BIGINT) AS n FROM documents")
def total_list_size(t):
    return agg.total_list_size(t.spread("documents", "doc_id").select(text.tokens(F.col("text")).alias("w")), "w")


@query("""
WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality),
numbered AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS rn FROM labels),
draws AS (SELECT quality, i AS draw, CAST('0x' || substr(md5('0:' || i), 1, 13) AS BIGINT) % n AS rn
          FROM c, LATERAL (SELECT unnest(range(0, (SELECT max(n) FROM c))) AS i))
SELECT quality, doc_id, draw FROM draws JOIN numbered USING (quality, rn)""")
def balanced_classes(t):
    return agg.balance_classes(t.labels.select("doc_id", "quality"), "quality", "doc_id")


@query("""
SELECT doc_id, lang, CASE WHEN CAST('0x' || substr(md5('7:' || doc_id), 1, 13) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split
FROM documents""")
def train_test_split(t):
    return agg.split_rows(t.documents.select("doc_id", "lang"), "doc_id", seed=7)


@query("""
SELECT url, CASE WHEN lang IN ('en', 'fr') THEN 'train' ELSE 'test' END AS split
FROM (SELECT url, split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', 1) AS lang FROM pages)""")
def split_by_path_prefix(t):
    path = t.pages.select("url", F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("path"))
    return agg.split_by_prefix(path, "path", ["en", "fr"]).select("url", "split")
