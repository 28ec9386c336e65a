"""Sources, sinks and incremental runs: what is written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators.aggregates import concat_by_key, ordered_lists
from tidings.operators.predicates import code_filter
from tidings.plans import combine
from tidings.plans.storage import new_path
from tidings.sources import readers, writers
from tidings.streaming import ingest
from workload.registry import query

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _path(t, label: str) -> str:
    return new_path(t._spark, label)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(t):
    """Appended gzip JSON lines, with a malformed line in between, read tolerantly."""
    path = _path(t, "jsonl")
    writers.append_jsonl(t.documents.where("doc_id % 2 = 0"), path)
    writers.append_jsonl(t.documents.where("doc_id % 2 = 1"), path)
    t.documents.limit(1).select(F.lit("{not json").alias("value")).write.mode("append").text(path)
    return readers.read_jsonl(t._spark, path, DOCUMENT)


@query("SELECT doc_id, lang, n_chars FROM documents")
def csv_round_trip(t):
    """CSV with quotes and line ends in a field; columns chosen on reading."""
    path = _path(t, "csv")
    writers.write_csv(t.documents.withColumn("index", F.col("doc_id")), path, "gzip")
    return readers.read_csv(t._spark, path, f"{DOCUMENT}, index long", ["doc_id", "lang", "n_chars"], drop=["index"], multi_line=True)


@query("""
SELECT event_id AS url, coalesce(strftime(ts, '%Y-%m-%d'), 'x') AS timestamp FROM events WHERE event_type <> 'error'""")
def headerless_csv(t):
    """Two columns without a header; lines with three are dropped."""
    path = _path(t, "captures")
    extra = F.when(F.col("event_type") == "error", F.lit(",surplus")).otherwise("")
    line = F.concat(F.col("event_id").cast("string"), F.lit(","), F.date_format("ts", "yyyy-MM-dd"), extra)
    t.events.select(line).write.text(path)
    return readers.read_csv_headerless(t._spark, path, "url long, timestamp string")


@query("""
SELECT 'com,' || event_type || ')/' || user_id AS url, strftime(ts, '%Y%m%d%H%M%S') AS ts, '200' AS status, event_id FROM events""")
def crawl_file(t):
    """A crawl index as a text file with blank lines in it."""
    path = _path(t, "crawl")
    line = F.format_string(
        'com,%s)/%d %s {"url": "u", "status": "200", "event": "%d"}', "event_type", "user_id",
        F.date_format("ts", "yyyyMMddHHmmss"), "event_id",
    )
    t.events.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    parsed = readers.parse_crawl_index(readers.read_crawl_index(t._spark, path), "status string, event string")
    return parsed.select("url", "ts", "packet.status", F.col("packet.event").cast("long").alias("event_id"))


@query("SELECT conv_id AS doc_id, turn AS sent_idx, role AS label, text AS sentence FROM conversations")
def document_lists(t):
    """One line per conversation holding a list of records."""
    path = _path(t, "lists")
    record = F.struct(
        F.col("turn").alias("sent_idx"), F.col("conv_id").alias("doc_id"), F.col("role").alias("label"), F.col("text").alias("sentence")
    )
    docs = ordered_lists(t.conversations.select("conv_id", "turn", record.alias("r")), "conv_id", "turn", "r")
    docs.select(F.to_json("r")).write.text(path)
    fields = "doc_id long, sent_idx long, label string, sentence string"
    return readers.read_document_lists(t._spark, path, fields).select("doc_id", "sent_idx", "label", "sentence")


@query("SELECT turn AS sent_idx, role AS label FROM conversations")
def document_columns(t):
    """One line per conversation holding a record of lists."""
    path = _path(t, "columns")
    docs = ordered_lists(t.conversations, "conv_id", "turn", "turn", "role")
    docs.select(F.to_json(F.struct(F.col("turn").alias("sent_idx"), F.col("role").alias("label")))).write.text(path)
    return readers.read_document_lists(t._spark, path, "sent_idx long, label string", columns=True)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value > 10 GROUP BY event_type")
def sql_over_views(t):
    sql = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM tidings_events WHERE value > 10 GROUP BY event_type"
    return readers.read_sql(t._spark, sql, tidings_events=t.events)


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20'")
def newer_than_cutoff(t):
    return readers.newer_than(t.events, "ts", "2024-01-20").select("event_id")


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND event_type = 'view'")
def date_partitions(t):
    """An archive by day; only the days asked for are read."""
    path = _path(t, "archive")
    writers.write_by_date(t.events, path, "ts")
    return readers.read_date_partitions(t._spark, path, "2024-01-05", "2024-01-09", language=("event_type", "view")).select(
        "event_id", "event_type"
    )


@query("SELECT doc_id, lang AS source FROM documents WHERE lang IN ('en', 'fr')")
def files_by_pattern(t):
    """One folder per outlet, matched by pattern, the outlet taken from the name."""
    root = _path(t, "outlets")
    for lang in ("en", "fr", "de"):
        rows = t.documents.where(F.col("lang") == lang).select("doc_id")
        writers.append_jsonl(rows, f"{root}/{lang}-articles-parsed")
    df = t._spark.read.schema("doc_id long").option("recursiveFileLookup", True).json(f"{root}/*-articles-parsed")
    named = df.withColumn("_folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
    from tidings.functions import urls

    out = named.select("doc_id", urls.outlet_from_filename(F.col("_folder")).alias("source"))
    return out.where(F.col("source").isin("en", "fr"))


@query("SELECT doc_id, source FROM documents")
def stored_dataset(t):
    """A stage computed on the first call and read on the second."""
    path = _path(t, "stage")
    writers.cached_stage(t._spark, path, lambda: t.documents.select("doc_id", "source"))
    return writers.cached_stage(t._spark, path, lambda: t.documents.limit(0).select("doc_id", "source"))


@query("""
SELECT conv_id, sent_id, label, sentence FROM (
  SELECT conv_id, 'S' || (turn + 1) AS sent_id, role AS label,
         trim(regexp_replace(text, '\\s+', ' ', 'g')) AS sentence FROM conversations) WHERE label <> 'system'""")
def annotation_pairs(t):
    """Text and annotation files per conversation, paired by the key in their paths.

    Blank space at the head of a line would hide its marker, so texts are put on one line.
    """
    root = _path(t, "annotated")
    sent = F.concat(F.lit("S"), (F.col("turn") + 1).cast("string"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    label = F.when(F.col("role") == "system", "Speech x").otherwise(F.concat("role", F.lit(" extra")))
    lines = t.conversations.select(
        "conv_id", "turn", F.concat(sent, F.lit(" "), flat).alias("t"), F.concat(F.lit("T1\t"), label, F.lit("\t"), sent).alias("a")
    )
    for kind, column, head in (("txt", "t", "URL http://a.org\nH head\n"), ("ann", "a", "")):
        bodies = concat_by_key(lines, "conv_id", column, "turn", "\n", "body")
        files = bodies.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("name"), F.concat(F.lit(head), "body").alias("value"))
        writers.write_named_texts(files, f"{root}/validation/{kind}", "name", "value", f".{kind}")
    pairs = readers.read_annotation_pairs(t._spark, f"{root}/validation/txt/*", f"{root}/validation/ann/*")
    out = pairs.where("url = 'http://a.org' AND headline = 'head'")
    conv_id = F.substring_index("key", "/", -1).try_cast("long").alias("conv_id")
    return out.select(conv_id, "sent_id", "label", "sentence")


@query("SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '') AS host FROM pages")
def rule_lists(t):
    """Block rules among other lines."""
    from tidings.functions import urls

    path = _path(t, "rules")
    host = urls.url_host(F.col("url"))
    rule = F.explode(F.array(F.concat(F.lit("||"), host, F.lit("^")), F.lit("! comment"), F.concat(F.lit("@@"), host)))
    t.pages.select(rule.alias("value")).distinct().write.text(path)
    return readers.read_rule_lists(t._spark, path)


@query("SELECT count(*) * 2 AS n FROM orders")
def concatenated_lines(t):
    """Two line files put together and counted."""
    a, b, both = _path(t, "lines"), _path(t, "lines"), _path(t, "lines")
    for path, column in ((a, "o_orderkey"), (b, "o_orderkey")):
        writers.write_lines(t.orders, column, path)
    writers.concat_text(t._spark, [a, b], both)
    return readers.count_readable_lines(t._spark, both)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(t):
    return readers.read_first(t.documents.select("doc_id"), 100, "doc_id")


@query("""
SELECT 'all' AS output, doc_id, lang FROM documents UNION ALL SELECT 'subset', doc_id, lang FROM documents WHERE lang = 'fr'""")
def two_way_write(t):
    everything, subset = _path(t, "all"), _path(t, "subset")
    writers.write_two_way(t.documents.select("doc_id", "lang"), everything, subset, lambda d: d.where("lang = 'fr'"))
    rows = lambda path, name: readers.read_jsonl(t._spark, path, "doc_id long, lang string").select(F.lit(name).alias("output"), "doc_id", "lang")
    return rows(everything, "all").unionByName(rows(subset, "subset"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def compacted_files(t):
    """Many files rewritten as fewer of bounded length."""
    small, large, single = _path(t, "small"), _path(t, "large"), _path(t, "single")
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    rows.repartition(16).write.parquet(small)
    writers.compact(t._spark.read.parquet(small), large, "parquet", 20_000)
    writers.write_single_json(t._spark.read.parquet(large), single, rows_per_file=40_000)
    return readers.read_jsonl(t._spark, single, "l_orderkey long, l_linenumber int")


@query("""
SELECT 'article_data' AS name, count(DISTINCT user_id) AS n FROM events UNION ALL
SELECT 'article_ents', (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) UNION ALL
SELECT 'article_map', (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)) UNION ALL
SELECT 'article_to_href', (SELECT count(*) FROM events)""")
def combined_tables(t):
    """The four tables out of articles made from events, written and counted."""
    key = F.format_string("com,site)/%d", "user_id")
    link = F.struct(F.format_string("https://a.org/%d", "event_id").alias("href"), F.col("event_type").alias("text"))
    links = ordered_lists(t.events.select("user_id", "event_id", link.alias("links")), "user_id", "event_id", "links")
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("ents"))
    articles = links.join(kinds, "user_id").select(
        key.alias("article_url"), "ents", "links", F.array(F.lit("A"), F.lit("B")).alias("article_authors"), F.lit("site").alias("source")
    )
    captures = t.events.select(
        F.format_string("https://site.com/%d", "user_id").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp")
    )
    pairs = t.events.where("user_id % 2 = 0").select(
        key.alias("target_article_url"), F.format_string("com,site)/%d", F.col("user_id") + 1).alias("archival_url")
    ).distinct()
    tables = combine.combined_tables(articles, captures, pairs, {"com,site": "https://site.com"})
    root = _path(t, "combined")
    writers.write_tables(root, {"article_map": tables.pop("article_map")}, tables)
    out = [
        t._spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name in ("article_data", "article_ents", "article_map", "article_to_href")
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT DISTINCT o_custkey AS article_url FROM orders")
def incremental_ingest(t):
    """Landed files, each new key once; a second run adds the second half and no doubles."""
    landing, out, state = _path(t, "landing"), _path(t, "ingested"), _path(t, "state")
    rows = t.orders.select(F.col("o_custkey").alias("article_url"), "o_orderkey")
    for half in (0, 1):
        rows.where(F.col("o_orderkey") % 2 == half).write.mode("append").json(landing)
        stream = ingest.stream_files(t._spark, landing, "article_url long, o_orderkey long")
        ingest.incremental_ingest(ingest.new_articles(stream).select("article_url"), out, state).awaitTermination()
    return t._spark.read.parquet(out)


@query("""
SELECT 'all' AS output, url AS article_url FROM pages UNION ALL SELECT 'subset', url FROM pages WHERE contains(url, '/en')""")
def stream_extract(t):
    """Pages parsed per micro-batch into two tables."""
    landing, every, some, state = (_path(t, x) for x in ("pages", "parsed", "chosen", "state"))
    t.pages.select(F.col("url").alias("article_url"), "html").repartition(4).write.json(landing)
    stream = ingest.stream_files(t._spark, landing, "article_url string, html string", files_per_trigger=2)
    ingest.stream_two_way(
        stream, combine.extract_articles, lambda d: d.where(F.col("article_url").contains("/en")), every, some, state
    ).awaitTermination()
    rows = lambda path, name: t._spark.read.parquet(path).where("article_text IS NOT NULL").select(F.lit(name).alias("output"), "article_url")
    return rows(every, "all").unionByName(rows(some, "subset"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS a, CAST(year(o_orderdate) AS BIGINT) AS b FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT DISTINCT o_custkey AS a, CAST(year(o_orderdate) AS BIGINT) AS b FROM orders WHERE o_orderkey % 2 = 1)
SELECT a AS article_url, b AS press_release_url FROM a UNION ALL
SELECT a, b FROM b WHERE a NOT IN (SELECT a FROM a) OR b NOT IN (SELECT b FROM a)""")
def stream_new_pairs(t):
    """Pairs in two batches; the second scores only pairs with a side not seen before."""
    landing, out, state = _path(t, "pairs"), _path(t, "scored"), _path(t, "state")
    pairs = t.orders.select(
        F.col("o_custkey").cast("string").alias("article_url"), F.year("o_orderdate").cast("string").alias("press_release_url"), "o_orderkey"
    )
    for half in (0, 1):
        pairs.where(F.col("o_orderkey") % 2 == half).drop("o_orderkey").write.mode("append").json(landing)
        stream = ingest.stream_files(t._spark, landing, "article_url string, press_release_url string")
        score = lambda d: d.withColumn("entailment", F.lit(0.0))
        ingest.stream_new_pairs(stream, score, out, state).awaitTermination()
    scored = t._spark.read.parquet(out)
    return scored.select(F.col("article_url").cast("long").alias("article_url"), F.col("press_release_url").cast("long").alias("press_release_url"))


@query("""
SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderpriority = '1-URGENT') = 0""")
def coded_archive_rows(t):
    """Archive rows with a struct array of codes, some to be left out, none required."""
    rows = t.orders.groupBy("o_custkey").agg(
        F.collect_set(F.struct(F.col("o_orderpriority").alias("code"))).alias("codes")
    )
    return code_filter(rows, F.col("codes.code"), ["1-URGENT"]).select("o_custkey")
