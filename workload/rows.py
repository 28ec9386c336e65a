"""Row choice, ranks, sorts, set operations, filters and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import arrays, dates, text
from tidings.operators import predicates as pred
from tidings.operators import windows as win
from tidings.operators.aggregates import ordered_lists
from workload.registry import query, sentences_sql, words_sql


# ---- one row per key, ranks ----------------------------------------------------------------------
@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedupe_headline(t):
    return win.first_per_key(t.documents.select("doc_id", "text"), ["text"], ["doc_id"])


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number
FROM orders""")
def version_numbers(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return win.version_numbers(rows, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number
FROM orders""")
def version_numbers_split(t):
    """The same with every key treated as hot, which goes through the split running total."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return win.version_numbers(rows, "o_custkey", "o_orderdate", "o_orderkey", hot_rows=5).drop("o_orderdate")


@query("""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders)
SELECT f.o_custkey, f.o_orderkey AS first_version_o_orderkey, l.o_orderkey AS last_version_o_orderkey,
       f.o_totalprice AS first_version_o_totalprice, l.o_totalprice AS last_version_o_totalprice
FROM v f JOIN v l ON f.o_custkey = l.o_custkey AND f.a = 1 AND l.z = 1 AND l.a <> 1""")
def version_first_last(t):
    from tidings.operators.reports import version_table

    return version_table(t.orders, "o_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1""")
def argmax_group(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = win.argmax_per_group(t.lineitem.select(*cols), ["l_orderkey"], "l_extendedprice",
                               ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.drop("l_suppkey")


@query("""
SELECT user_id, event_id, rank FROM (
  SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS rank
  FROM events) WHERE rank <= 5""")
def newest_per_user(t):
    rows = t.events.select("user_id", "event_id", "ts")
    return win.top_k_per_group(rows, ["user_id"], [F.desc("ts"), "event_id"], 5).drop("ts")


@query(f"""
WITH s AS (SELECT doc_id, {sentences_sql('text')} AS l FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, l[i] AS sentence FROM s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""")
def sentence_positions(t):
    rows = t.documents.select("doc_id", text.sentences(F.col("text")).alias("s"))
    return win.with_position(rows, "s", "sent_idx", "sentence")


@query(f"""
WITH n AS (SELECT conv_id, turn, len({words_sql('text')}) AS n FROM conversations),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM n)
SELECT conv_id, turn FROM c WHERE upto <= 300 AND rn <= 4""")
def token_budget(t):
    n = F.size(text.tokens(F.col("text")))
    rows = t.conversations.select("conv_id", "turn", n.alias("n"))
    return win.within_token_budget(rows, "conv_id", "turn", F.col("n"), 300, 4).select("conv_id", "turn")


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations""")
def chunk_offsets(t):
    out = win.chunk_offsets(t.conversations, "conv_id", "turn", F.length("text"))
    return out.select("conv_id", "turn", "char_start")


@query(f"""
SELECT doc_id, array_to_string({sentences_sql('text')}[1:5], ' ') AS lead FROM documents""")
def first_sentences(t):
    lead = text.first_sentences(text.sentences(F.col("text")), 5)
    return t.documents.select("doc_id", F.array_join(lead, " ").alias("lead"))


@query("""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 12 AS INTEGER) AS worker FROM orders""")
def round_robin(t):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return win.round_robin(rows, ["o_orderdate", "o_orderkey"], 12).select("o_orderkey", "worker")


@query("""
SELECT o_orderkey, CAST(CAST('0x' || substr(md5('3:' || o_orderkey), 1, 13) AS BIGINT) % 12 AS INTEGER) AS worker FROM orders""")
def random_worker(t):
    return win.random_worker(t.orders.select("o_orderkey"), "o_orderkey", 12, seed=3)


# ---- sorts, limits, set operations --------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(t):
    return win.top_n(t.orders.select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY lang NULLS FIRST, n_chars DESC NULLS LAST, doc_id) AS position FROM documents")
def multi_sort(t):
    return win.stand_numbers(win.multi_sort(t.documents.select("doc_id", "lang", "n_chars"), "lang", F.desc("n_chars"), "doc_id"))


@query("""
SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1
         ELSE 2147483647 END, turn) AS turns FROM conversations GROUP BY conv_id""")
def custom_order(t):
    pairs = t.conversations.select("conv_id", "turn", F.struct("turn", "role").alias("turns"))
    packed = ordered_lists(pairs, "conv_id", "turn", "turns")
    out = win.sort_list_by_label(packed, "turns", "role", {"system": 0, "assistant": 1})
    return out.select("conv_id", F.array_join(F.col("turns").getField("turn").cast("array<string>"), ",").alias("turns"))


@query(f"""
SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS position FROM (SELECT doc_id, len({words_sql('text')}) AS n FROM documents)""")
def longest_documents(t):
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    out = win.sort_by_length(rows, "w", "doc_id")
    return win.stand_numbers(out.select("doc_id", F.size("w").cast("long").alias("n")))


@query("""
SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= CASE source WHEN 'src1' THEN 10 ELSE 20 END""")
def limit_per_split(t):
    return win.limit_per_split(t.documents.select("doc_id", "source"), "source", "doc_id", {"src1": 10, "src2": 20})


@query("""
SELECT o_custkey AS k, 'orders' AS split FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer""")
def labelled_union(t):
    return win.labelled_union(
        {"orders": t.orders.select(F.col("o_custkey").alias("k")), "customer": t.customer.select(F.col("c_custkey").alias("k"))}
    )


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def union_distinct(t):
    return win.union_distinct(t.lineitem, "l_partkey", "l_suppkey", "k")


@query("SELECT count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def customers_without_orders(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return win.difference_size(t.customer, orders, "c_custkey")


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def shared_nations(t):
    return win.intersection(
        t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")), "k"
    )


@query("SELECT l_orderkey AS url FROM lineitem UNION SELECT l_partkey FROM lineitem")
def unpivot_distinct(t):
    return win.unpivot_distinct(t.lineitem, ["l_orderkey", "l_partkey"])


# ---- filters --------------------------------------------------------------------------------------------
@query("""
SELECT doc_id AS article_id, lang AS article_lang, source AS article_source FROM documents
WHERE lang = 'en' AND source NOT IN ('src1', 'src3') AND length(text) >= 1""")
def select_rename_filter(t):
    rows = pred.select_columns(t.documents, drop=["n_chars"])
    rows = pred.language_filter(pred.text_length_between(rows, "text"))
    rows = pred.value_filter(rows, "source", ["src1", "src3"], keep=False).withColumnRenamed("doc_id", "id").drop("text")
    return pred.rename_columns(rows, lambda c: f"article_{c}")


@query(f"""
SELECT doc_id FROM documents WHERE len({words_sql('text')}) > 100""")
def nonempty_arrays(t):
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    return pred.nonempty(rows, "w", 100).select("doc_id")


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM o WHERE rn > CAST(floor(0.35 * n) AS BIGINT) AND rn <= CAST(floor(0.4 * n) AS BIGINT)""")
def percent_slice(t):
    return pred.percent_slice(t.orders.select("o_orderkey"), ["o_orderkey"], 0.35, 0.4)


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 101 AND 900")
def index_slice(t):
    return pred.index_slice(t.orders.select("o_orderkey"), ["o_orderkey"], 100, 900)


@query("""
SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('11:' || doc_id), 1, 13) AS BIGINT), doc_id) AS position FROM documents""")
def seeded_order(t):
    return win.stand_numbers(pred.seeded_order(t.documents.select("doc_id"), "doc_id", seed=11))


@query("SELECT doc_id FROM labels WHERE quality + toxic = 1")
def exactly_one_flag(t):
    return pred.exactly_one(t.labels, "quality", "toxic").select("doc_id")


@query("""
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'Both' WHEN quality = 1 THEN 'Press Release'
                    WHEN toxic = 1 THEN 'Archive' ELSE 'Unmatched' END AS kind FROM labels""")
def two_flag_type(t):
    return t.labels.select("doc_id", arrays.two_flag_type(F.col("quality"), F.col("toxic")).alias("kind"))


@query("""
WITH codes AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS c FROM orders GROUP BY o_custkey)
SELECT o_custkey FROM codes WHERE NOT list_has_any(c, ['1-URGENT']) AND list_has_any(c, ['2-HIGH', '5-LOW'])""")
def code_overlap_filter(t):
    codes = t.orders.groupBy("o_custkey").agg(
        F.collect_set(F.struct(F.col("o_orderpriority").alias("code"))).alias("codes")
    )
    values = F.transform("codes", lambda x: x["code"])
    return pred.code_filter(codes, values, ["1-URGENT"], ["2-HIGH", "5-LOW"]).select("o_custkey")


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM s)
SELECT doc_id, line FROM w WHERE length(line) < 1000 AND len(w) > 4""")
def sentence_heuristics(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(text.readable_sentence(F.col("line")))


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
c AS (SELECT conv_id, turn, len(list_filter(w, lambda x: lower(x) NOT IN ('the', 'of', 'and', 'in', 'de', 'la'))) AS n FROM w)
SELECT conv_id, turn FROM c WHERE n > 3 AND n < 50""")
def acceptable_sentences(t):
    keep = text.acceptable_sentence(F.col("text"), 3, 50, ["the", "of", "and", "in", "de", "la"])
    return t.conversations.where(keep).select("conv_id", "turn")


@query("""
WITH d AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_discount < 0.05) AS kept
           FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(kept, ',') AS kept FROM d WHERE len(kept) > 0""")
def error_sentence_filter(t):
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), "l_partkey", "l_discount")
    docs = ordered_lists(rows, "l_orderkey", "o", "l_partkey", "l_discount")
    out = pred.drop_error_sentences(docs, "l_discount", ["l_partkey"], limit=0.05)
    return out.select("l_orderkey", F.array_join(F.col("l_partkey").cast("array<string>"), ",").alias("kept"))


@query("SELECT url FROM pages WHERE url NOT LIKE '%/en%' AND url NOT LIKE '%/de%'")
def path_exclusion(t):
    return pred.drop_paths(t.pages.select("url"), "url", ["/en", "/de"])


@query("SELECT url, CAST(regexp_matches(url, '(?i)PAGE=|ref|TOP') AS INTEGER) AS flagged FROM pages")
def contains_any_flag(t):
    return t.pages.select("url", pred.contains_any(F.col("url"), ["PAGE=", "ref", "TOP"]).cast("int").alias("flagged"))


@query("SELECT url FROM pages WHERE url NOT LIKE '%.org%'")
def tld_exclusion(t):
    return pred.drop_tld(t.pages.select("url"), "url", ".org")


@query("""
SELECT doc_id, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
WHERE contains(l, 'the') AND NOT contains(l, 'and')""")
def line_phrase_filter(t):
    rows = t.documents.select("doc_id", F.explode(text.lines_with_phrase(F.col("text"), "the", "and")).alias("line"))
    return rows


@query("""
SELECT o_orderkey, coalesce(map {'1-URGENT': 'now', '2-HIGH': 'soon'}[o_orderpriority], o_orderpriority) AS mapped,
       coalesce(map {'1-URGENT': 1, '2-HIGH': 2}[o_orderpriority], -1) AS mapped_or_null FROM orders""")
def map_values(t):
    p = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", arrays.map_values(p, {"1-URGENT": "now", "2-HIGH": "soon"}).alias("mapped"),
        F.coalesce(arrays.map_values_or_null(p, {"1-URGENT": 1, "2-HIGH": 2}), F.lit(-1)).alias("mapped_or_null"),
    )


@query("""
SELECT doc_id, lang, CAST(n_chars > 1000 AS INTEGER) AS is_match FROM documents
WHERE trim(coalesce(text, '')) <> '' AND lang = 'de' AND source = 'src2'""")
def criteria_and_threshold(t):
    rows = pred.drop_nulls(pred.nonblank(t.documents, "text"), ["lang"])
    rows = pred.match_criteria(rows, lang="de", source="src2")
    return pred.flag_above(rows, "n_chars", 1000).select("doc_id", "lang", F.col("is_match").cast("int").alias("is_match"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def label_filter(t):
    return pred.label_filter(t.conversations, "role", ["system"]).select("conv_id", "turn")


@query(f"""
SELECT doc_id FROM documents WHERE list_has_any({words_sql('text')}, ['acher', 'achlich', 'achzu', 'adoado'])""")
def shares_any(t):
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    return pred.documents_sharing(rows, "w", ["acher", "achlich", "achzu", "adoado"]).select("doc_id")


# ---- dates -------------------------------------------------------------------------------------------------
@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'None' ELSE strftime(ts, '%Y-%m-%d') END AS published,
                  CASE WHEN event_id % 5 = 0 THEN 'Not Found' ELSE strftime(ts, '%Y%m%d%H%M%S') END AS captured FROM events)
SELECT event_id, coalesce(CASE WHEN published <> 'None' THEN published || ' 00:00:00'
  WHEN captured <> 'Not Found' THEN strftime(strptime(captured, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') END, 'null') AS at
FROM e""")
def date_coalesce(t):
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, "None").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("published"),
        F.when(F.col("event_id") % 5 == 0, "Not Found").otherwise(F.date_format("ts", "yyyyMMddHHmmss")).alias("captured"),
    )
    at = dates.canonical_timestamp(F.col("published"), F.col("captured"))
    return rows.select("event_id", F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("null")).alias("at"))


@query("""
SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') :: BIGINT AS stamp, CAST(year(ts) AS INTEGER) AS year,
       'https://web.archive.org/web/' || strftime(ts, '%Y%m%d%H%M%S') || '/http://a.org/' || user_id AS capture
FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-10'""")
def capture_stamps(t):
    from tidings.functions import urls

    rows = t.events.where(F.to_date("ts") > F.lit("2024-01-10").cast("date"))
    stamp = dates.capture_stamp(F.col("ts"))
    url = F.concat(F.lit("http://a.org/"), F.col("user_id").cast("string"), F.lit("?q=1#f"))
    return rows.select("event_id", stamp.alias("stamp"), F.year("ts").alias("year"), urls.capture_url(stamp, url).alias("capture"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def compact_dates(t):
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    return t.orders.select("o_orderkey", F.date_format(dates.parse_compact_date(number), "yyyy-MM-dd").alias("day"))


@query("""
WITH e AS (SELECT event_id, ts, max(ts) OVER () AS m FROM events)
SELECT event_id FROM e WHERE ts > m - INTERVAL 12 HOURS - INTERVAL 7 DAYS""")
def parsed_intervals(t):
    newest = t.events.select(F.max("ts")).scalar()
    return t.events.where(F.col("ts") > newest - dates.interval("12h") - dates.interval("1 week")).select("event_id")
