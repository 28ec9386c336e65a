"""Operators that no other query goes through: readers of linked articles and stored sets, array functions, source spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings import lexicon
from tidings.functions import arrays
from tidings.operators import joins, scoring
from tidings.operators.aggregates import ordered_lists
from tidings.plans.combine import explode_links
from tidings.plans.storage import new_path
from tidings.sources import readers, writers
from workload.registry import query


@query("SELECT CAST(p_partkey AS VARCHAR) AS article_url, p_brand AS href, p_type AS link_text FROM part WHERE p_size % 3 <> 0")
def article_links(t):
    """Parsed articles with links, written as JSON, read back and exploded."""
    path = new_path(t._spark, "linked")
    link = F.array(F.struct(F.col("p_brand").alias("href"), F.col("p_type").alias("link_text")))
    none = F.array().cast("array<struct<href:string,link_text:string>>")
    rows = t.part.select(F.col("p_partkey").cast("string").alias("article_url"), F.when(F.col("p_size") % 3 != 0, link).otherwise(none).alias("links"))
    writers.append_jsonl(rows.union(rows.where("p_size < 10")), path)
    schema = "article_url string, links array<struct<href:string,link_text:string>>"
    return explode_links(readers.read_linked_articles(t._spark, path, schema))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def languages_by_pattern(t):
    root = new_path(t._spark, "by-language")
    t.documents.select("doc_id", "lang", F.col("lang").alias("folder")).write.partitionBy("folder").json(root)
    return readers.read_many(t._spark, f"{root}/folder={{en,de}}", "json", "doc_id long, lang string", name_parts=["part-"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def stored_datasets(t):
    """Two stored sets read as one."""
    paths = [new_path(t._spark, f"half-{i}") for i in (0, 1)]
    for i, path in enumerate(paths):
        t.orders.where(F.col("o_orderkey") % 2 == i).select("o_orderkey", "o_custkey").write.parquet(path)
    return readers.read_dataset(t._spark, paths)


@query("SELECT r_regionkey, r_name, weight FROM region JOIN (VALUES (0, 0.5), (2, 1.5), (9, 3.0)) w(k, weight) ON r_regionkey = k")
def local_weights(t):
    weights = readers.from_local(t._spark, [(0, 0.5), (2, 1.5), (9, 3.0)], "r_regionkey long, weight double")
    region = t.region.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    return region.join(weights, "r_regionkey")


@query("""
SELECT a.doc_id AS article_url, b.doc_id AS press_release_url, md5(a.text) AS article_sents, md5(b.text) AS press_release_sents
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def mapping_twice(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("h"))
    mapping = t.documents.select(F.col("doc_id").alias("article_url"), (F.col("doc_id") + 1).alias("press_release_url"))
    return joins.join_mapping_twice(mapping, docs, "doc_id", "h").select("article_url", "press_release_url", "article_sents", "press_release_sents")


_LABELS = sorted(lexicon.DISCOURSE_IDS)[:2]


@query(f"""
SELECT p_partkey, p_brand || '|' || p_type AS fields,
  array_to_string(list_transform(list_filter([{{'a': p_size, 'b': p_brand}}, {{'a': p_size % 7, 'b': p_type}}, {{'a': 3, 'b': p_name}}],
                                             lambda x: x.a > 3), lambda x: x.b), '|') AS kept,
  coalesce(CASE p_size % 3 WHEN 0 THEN {lexicon.DISCOURSE_IDS[_LABELS[0]]} WHEN 1 THEN {lexicon.DISCOURSE_IDS[_LABELS[1]]} END, -1) AS label_id,
  p_size % 2 = 1 AS ambiguous FROM part""")
def parallel_arrays(t):
    both = F.array(F.struct(F.col("p_brand").alias("v")), F.struct(F.col("p_type").alias("v")))
    kept = arrays.filter_parallel(
        lambda x: x["a"] > 3, a=F.array(F.col("p_size"), F.col("p_size") % 7, F.lit(3)), b=F.array("p_brand", "p_type", "p_name")
    )
    label = F.when(F.col("p_size") % 3 == 0, _LABELS[0]).when(F.col("p_size") % 3 == 1, _LABELS[1]).otherwise("no such label")
    heads = F.array(F.lit("plain"), F.lit(None), F.when(F.col("p_size") % 2 == 1, "name-1").otherwise("name"))
    return t.part.select(
        "p_partkey", F.array_join(arrays.struct_field(both, "v"), "|").alias("fields"), F.array_join(F.transform(kept, lambda x: x["b"]), "|").alias("kept"),
        F.coalesce(arrays.discourse_id(label), F.lit(-1)).alias("label_id"), arrays.has_ambiguous_source(heads).alias("ambiguous"),
    )


@query(f"""
WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i,
                  role || ' said ' || turn || '.' AS plain FROM conversations),
c AS (SELECT *, CASE WHEN i = 0 THEN '{lexicon.ATTRIBUTION_PREFIX}' || plain ELSE plain END AS sent FROM s),
d AS (SELECT conv_id, string_agg(sent, ' ' ORDER BY i) AS whole FROM c GROUP BY conv_id)
SELECT conv_id, role AS source, CAST(instr(whole, role) - 1 AS INTEGER) AS "start", CAST(instr(whole, role) + length(role) - 2 AS INTEGER) AS "end",
       CAST(i AS INTEGER) AS sent_idx, sent AS sentence, 'DIRECT QUOTE' AS quote_type FROM c JOIN d USING (conv_id)""")
def source_spans(t):
    item = F.struct(
        F.col("role").alias("head"), F.concat("role", F.lit(" said "), F.col("turn").cast("string"), F.lit(".")).alias("sent"), F.lit("QUOTE").alias("quote_type")
    )
    rows = t.conversations.select("conv_id", F.struct("turn", "role").alias("o"), item.alias("doc"))
    return scoring.source_spans(ordered_lists(rows, "conv_id", "o", "doc"), "conv_id")
