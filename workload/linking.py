"""Joins, shared entities, prior coverage, captures, sentence pairs and the whole linkage chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import text
from tidings.operators import aggregates as agg
from tidings.operators import joins, reports, scoring, similarity
from tidings.operators.windows import first_per_key
from tidings.plans import linkage
from workload.registry import query, sentences_sql, words_sql


# ---- equi-joins ----------------------------------------------------------------------------------
@query("""
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_inner(t):
    rows = joins.join_on(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                         t.customer.select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"])
    return rows.drop("o_custkey")


@query("""
SELECT c_custkey AS o_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey""")
def join_right(t):
    rows = joins.join_on(t.orders.select("o_custkey", "o_orderkey"), t.customer.select("c_custkey"),
                         ["o_custkey"], ["c_custkey"], "right")
    return rows.withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM labels l RIGHT JOIN documents d USING (doc_id)""")
def entities_to_texts(t):
    out = joins.join_entities_to_texts(t.labels.select("doc_id", "quality"), t.documents.select("doc_id"), "doc_id")
    return out.withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(t):
    return joins.keep_matching(t.customer, t.orders.where("o_orderstatus = 'P'"), ["c_custkey"], ["o_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return joins.drop_matching(t.customer, urgent, ["c_custkey"], ["o_custkey"]).select("c_custkey")


@query("""
SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)""")
def fetched_urls_removed(t):
    crawl = t.events.select("event_id", F.format_string("com,a)/%d.html?q=%d", "user_id", "event_id").alias("url"))
    fetched = t.events.where("event_type = 'purchase' AND value > 90").select(
        F.format_string("com,b)/%d.html#x", "user_id").alias("article_url")
    )
    return joins.drop_fetched(crawl, fetched, "url", "article_url").select("event_id")


@query("""
SELECT DISTINCT l_partkey AS article_url, l_suppkey AS press_release_url FROM lineitem
WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-04-01')
   OR l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-04-01')""")
def new_on_either_side(t):
    pairs = t.lineitem.select(
        F.col("l_partkey").alias("article_url"), F.col("l_suppkey").alias("press_release_url"), "l_shipdate"
    )
    seen = pairs.where("l_shipdate < '1995-04-01'")
    return joins.new_on_either_side(pairs.drop("l_shipdate").distinct(), seen)


@query("""
SELECT event_id, user_id FROM events WHERE user_id = (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""")
def largest_group(t):
    return joins.rows_of_largest_group(t.events, "user_id").select("event_id", "user_id")


@query("""
SELECT user_id, min(ts) FILTER (event_type = 'view') IS NULL AS missing,
       coalesce(strftime(min(ts) FILTER (event_type = 'view'), '%Y-%m-%d %H:%M:%S'), 'none') AS first_view
FROM events GROUP BY user_id""")
def earliest_capture(t):
    users = t.events.select("user_id").distinct()
    views = t.events.where("event_type = 'view'").select(F.col("user_id").alias("url"), F.col("ts").alias("timestamp"))
    out = joins.lookup_values(users, joins.earliest_capture(views), "user_id", "url", "timestamp", "first_view")
    shown = F.coalesce(F.date_format("first_view", "yyyy-MM-dd HH:mm:ss"), F.lit("none"))
    return out.select("user_id", F.col("first_view").isNull().alias("missing"), shown.alias("first_view"))


CAPTURE_SQL = """
WITH art AS (SELECT DISTINCT user_id FROM events), cap AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT 'com,site)/' || user_id AS article_url, 'https://site.com/' || user_id AS timestamp_join_key,
       coalesce(strftime(date_trunc('second', ts), '%Y%m%d%H%M%S'), 'none') AS captured,
       CAST(user_id % 2 = 0 AS INTEGER) AS is_target, CAST(user_id % 3 = 0 AS INTEGER) AS is_archive
FROM art LEFT JOIN cap USING (user_id)"""


@query(CAPTURE_SQL)
def capture_times(t):
    key = F.format_string("com,site)/%d", "user_id")
    articles = t.events.select(key.alias("article_url")).distinct()
    stamps = F.date_format("ts", "yyyyMMddHHmmss")
    captures = t.events.where("event_type = 'view'").select(
        F.format_string("https://site.com/%d", "user_id").alias("url"), stamps.alias("timestamp")
    )
    some = lambda n: F.when(F.col("user_id") % n == 0, key)
    article_map = t.events.select(some(2).alias("target_article_url"), some(3).alias("archival_url"))
    out = joins.attach_capture_times(articles, captures, article_map, sites={"com,site": "https://site.com"})
    return out.select(
        "article_url", "timestamp_join_key",
        F.coalesce(F.date_format("timestamp", "yyyyMMddHHmmss"), F.lit("none")).alias("captured"),
        F.col("is_press_release_article").cast("int").alias("is_target"),
        F.col("is_archival_article").cast("int").alias("is_archive"),
    )


@query("""
SELECT o_custkey, string_agg(strftime(o_orderdate, '%Y%m%d'), ',' ORDER BY o_orderkey) AS dates FROM orders GROUP BY o_custkey""")
def list_lookup(t):
    lists = agg.collect_by_key(t.orders, "o_custkey", "o_orderkey")
    days = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    out = joins.lookup_list_values(lists, days, "o_custkey", "o_orderkey", "o_orderkey", "day", "dates")
    return out.select("o_custkey", F.array_join("dates", ",").alias("dates"))


@query("""
SELECT o_orderkey, l_partkey AS story_l_partkey, l_linenumber AS story_l_linenumber, o_totalprice AS release_o_totalprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def bundle_pairs(t):
    """Orders as releases, their lines as stories."""
    stories = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    return joins.bundle_pairs(t.orders.select("o_orderkey", "o_totalprice"), stories, "o_orderkey")


@query("""
WITH tags AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts
              FROM lineitem GROUP BY l_orderkey),
     notes AS (SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, c_mktsegment, n_name, r_name, parts, flags FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN tags ON o_orderkey = tags.l_orderkey JOIN notes ON o_orderkey = notes.l_orderkey
WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderstatus NOT IN ('P')""")
def star_join(t):
    orders = t.orders.where("o_orderdate > '1997-01-01' AND o_orderstatus NOT IN ('P')").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey")
    )
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag",
        F.struct("l_linenumber", "l_partkey").alias("a"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("b"),
    )
    out = reports.star_report(
        orders,
        {"c_custkey": t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")),
         "n_nationkey": t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")),
         "r_regionkey": t.region},
        {"parts": (lines, "o_orderkey", "l_partkey", "a"), "flags": (lines, "o_orderkey", "l_returnflag", "b")},
    )
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name", "parts", "flags")


@query("""
SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY source, text) AS b FROM documents""")
def text_equality_join(t):
    """Every document next to the first one of its source with the same text."""
    left = t.documents.select("source", "text", F.col("doc_id").alias("a"))
    first = first_per_key(t.documents.select("source", "text", F.col("doc_id").alias("b")), ["source", "text"], ["b"])
    return joins.join_on_text(left, first, "source", "text").select("a", "b")


@query("""
SELECT conv_id, a.turn, role FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN conversations USING (conv_id, turn)""")
def shard_join(t):
    key = F.concat_ws("/", "conv_id", "turn").alias("article_url")
    a = t.conversations.select(key, "conv_id", "turn").union(t.conversations.select(key, "conv_id", "turn"))
    return joins.join_shards(a, t.conversations.select(key, "role")).drop("article_url")


@query("SELECT doc_id, l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id)")
def label_join(t):
    from tidings.operators.evaluate import label_scores

    ids = [F.col("doc_id").alias("article_url"), F.col("doc_id").alias("press_release_url")]
    out = label_scores(t.labels.select(*ids, "quality", "toxic"), t.documents.select(*ids, "lang"))
    return out.select(F.col("article_url").alias("doc_id"), "quality", "toxic", "lang")


@query("SELECT vec_id, label, n_chars FROM embeddings JOIN documents ON vec_id = doc_id")
def candidate_times(t):
    return joins.join_candidate_times(t.embeddings.select("vec_id", "label"), t.documents.select("doc_id", "n_chars"), "vec_id", "doc_id")


@query("SELECT doc_id AS position, lang, quality FROM documents JOIN labels USING (doc_id)")
def position_paste(t):
    at = F.col("doc_id").alias("position")
    return joins.paste_columns(t.documents.select(at, "lang"), t.labels.select(at, "quality"))


# ---- shared entities ------------------------------------------------------------------------------------
ENTITY_SQL = f"""
a0 AS (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS ent FROM documents),
general AS (SELECT ent FROM a0 GROUP BY ent HAVING count(*) / (SELECT count(*) FROM documents) > 0.03),
a AS (SELECT * FROM a0 WHERE ent NOT IN (SELECT ent FROM general)),
r AS (SELECT DISTINCT item_id, unnest({words_sql('text')}) AS ent FROM benchmark),
pairs AS (SELECT item_id, doc_id, count(*) AS shared FROM a JOIN r USING (ent) GROUP BY item_id, doc_id)"""


def _entity_rows(t):
    docs = t.spread("documents", "doc_id")
    tokens = text.tokens(F.col("text"))
    rows = joins.entity_rows(docs, "doc_id", tokens, one_row_per_doc=True)
    n = t.documents.select(F.count(F.lit(1))).scalar()
    general = agg.frequent_by_documents(rows, n, top=None).select("ent")
    return joins.entity_rows(t.benchmark, "item_id", tokens, general, one_row_per_doc=True), rows


@query(f"WITH {ENTITY_SQL} SELECT item_id AS target, doc_id AS archive FROM pairs")
def entity_overlap(t):
    return joins.entity_overlap(*_entity_rows(t))


@query(f"WITH {ENTITY_SQL} SELECT item_id AS target, doc_id AS archive FROM pairs")
def entity_overlap_salted(t):
    """The same with keys counted as hot from five rows on, which sends them through salts."""
    items, docs = _entity_rows(t)
    return joins.entity_overlap(items, docs, hot_rows=5)


@query(f"""
WITH {ENTITY_SQL}, na AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id),
nr AS (SELECT item_id, count(*) AS n FROM r WHERE ent NOT IN (SELECT ent FROM general) GROUP BY item_id)
SELECT item_id AS target, doc_id AS archive, round(shared / sqrt(na.n * nr.n), 6) AS cosine
FROM pairs JOIN na USING (doc_id) JOIN nr USING (item_id)""")
def entity_cosine(t):
    items, docs = _entity_rows(t)
    n = t.documents.select(F.count(F.lit(1))).scalar()
    docs = docs.join(agg.frequent_by_documents(docs, n, top=None).select("ent"), "ent", "left_anti")
    return joins.entity_cosine(items, docs).withColumn("cosine", F.round("cosine", 6))


@query(f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS k FROM documents), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (SELECT a.doc_id AS target, b.doc_id AS archive, count(*) AS shared FROM w a JOIN w b ON a.k = b.k AND a.doc_id % 100 = 0 GROUP BY ALL)
SELECT target, archive, round(shared / sqrt(x.n * y.n), 6) AS cosine FROM s JOIN n x ON x.doc_id = target JOIN n y ON y.doc_id = archive
WHERE shared / sqrt(x.n * y.n) >= 0.6 - 1e-9""")
def similar_word_sets(t):
    """Every hundredth document against all, by words: cosines of 0.6 and more."""
    rows = joins.entity_rows(t.spread("documents", "doc_id"), "doc_id", text.tokens(F.col("text")), one_row_per_doc=True)
    found = similarity.similar_sets(rows.where("doc % 100 = 0"), rows, 0.6)
    return found.withColumn("cosine", F.round("cosine", 6))


@query(f"""
WITH {ENTITY_SQL} SELECT item_id AS target, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS archives FROM pairs GROUP BY item_id""")
def entity_archive_lists(t):
    lists = joins.archive_lists(joins.entity_overlap(*_entity_rows(t)))
    return lists.select("target", F.array_join(F.col("archive_list").cast("array<string>"), ",").alias("archives"))


@query(f"""
WITH w AS (SELECT doc_id, source, unnest({words_sql('text')}) AS k FROM documents)
SELECT doc_id, lang FROM documents WHERE doc_id IN
  (SELECT doc_id FROM w WHERE length(k) > 12 AND k IN (SELECT k FROM w WHERE source = 'src1'))""")
def exploded_key_chain(t):
    longer = F.filter(text.tokens(F.col("text")), lambda w: F.length(w) > 12)
    rows = t.spread("documents", "doc_id").select("doc_id", "lang", "source", longer.alias("keys"))
    out = joins.exploded_key_chain(rows.where("source = 'src1'"), rows, F.col("keys"), F.col("keys"), "doc_id")
    return out.select("doc_id", "lang")


# ---- time ---------------------------------------------------------------------------------------------------
@query("""
SELECT event_id, archive_id, rank FROM (
  SELECT a.event_id, b.event_id AS archive_id, CAST(row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id) AS INTEGER) AS rank
  FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts > a.ts - INTERVAL 1 DAY AND a.event_id <> b.event_id)
WHERE rank <= 20""")
def prior_coverage(t):
    rows = t.events.select("event_id", "ts", "user_id")
    return joins.prior_coverage(rows, doc_id="event_id", key="user_id", days=1)


@query("""
SELECT event_id, archive_id, rank FROM (
  SELECT a.event_id, b.event_id AS archive_id, CAST(row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id) AS INTEGER) AS rank
  FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_type = 'purchase' AND b.ts < a.ts AND b.ts > a.ts - INTERVAL 2 DAYS)
WHERE rank <= 20""")
def prior_coverage_hot_key(t):
    """One key holds every row: the sort cuts it into pieces."""
    rows = t.events.where("event_type = 'purchase'").select("event_id", "ts", "event_type")
    return joins.prior_coverage(rows, doc_id="event_id", key="event_type", days=2)


AS_OF_SQL = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_id AS capture FROM events WHERE event_type = 'view'),
c AS (SELECT p.event_id, v.capture, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), v.ts, v.capture) AS rn
      FROM p JOIN v ON p.user_id = v.user_id {where})
SELECT p.event_id, coalesce(c.capture, -1) AS capture FROM p LEFT JOIN c ON p.event_id = c.event_id AND c.rn = 1"""


def _as_of(t, sort_by):
    buys = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("v"))
    out = joins.nearest_capture(buys, views, ["user_id"], "ts", "at", "v", sort_by)
    return out.select("event_id", F.coalesce("capture", F.lit(-1)).alias("capture"))


@query(AS_OF_SQL.format(where="AND v.ts < p.ts"))
def as_of_past(t):
    return _as_of(t, "past")


@query(AS_OF_SQL.format(where="AND v.ts > p.ts"))
def as_of_future(t):
    return _as_of(t, "future")


@query(AS_OF_SQL.format(where=""))
def as_of_nearest(t):
    return _as_of(t, "nearest")


# ---- sentence pairs and the whole chain ------------------------------------------------------------------------
PAIR_SQL = f"""
a1 AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, {sentences_sql('text')} AS l FROM documents)),
r1 AS (SELECT item_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT item_id, {sentences_sql('text')} AS l FROM benchmark)),
asent AS (SELECT doc_id, s, min(i) - 1 AS i, list_distinct({words_sql('s')}) AS w FROM a1 GROUP BY doc_id, s),
rsent AS (SELECT item_id, s, min(i) - 1 AS i, list_distinct({words_sql('s')}) AS w FROM r1 GROUP BY item_id, s),
sp AS (SELECT p.doc_id, p.item_id, asent.i AS ai, rsent.i AS ri, asent.w AS aw, rsent.w AS rw
       FROM pairs p JOIN asent USING (doc_id) JOIN rsent USING (item_id)),
neg AS (SELECT ['no', 'not', 'never', 'none', 'nobody', 'nothing', 'neither', 'nor', 'cannot', 'without', 'denies', 'denied', 'deny', 'refuses', 'refused'] AS n),
sc AS (SELECT doc_id, item_id, ai, ri, CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, rw)) / len(aw) ELSE 0 END AS e,
              list_has_any(aw, n) <> list_has_any(rw, n) AS differ FROM sp, neg)"""


@query(f"""
WITH {ENTITY_SQL}, {PAIR_SQL}
SELECT doc_id AS article_url, item_id AS press_release_url, count(*) AS n, round(sum(e), 4) AS entailment, round(sum(1 - e), 4) AS neutral,
       round(sum(CASE WHEN differ THEN e ELSE 0 END), 4) AS contradiction, CAST(sum(ai) AS BIGINT) AS positions FROM sc GROUP BY ALL""")
def sentence_pairs(t):
    """All scored sentence pairs, summed up per document pair."""
    out = linkage.scored_pairs(t.spread("documents", "doc_id"), t.benchmark, "doc_id", "item_id", "text", texts=False)
    return out.groupBy("article_url", "press_release_url").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(c), 4).alias(c) for c in ("entailment", "neutral", "contradiction")],
        F.sum("article_idx").alias("positions"),
    )


@query(f"""
WITH {ENTITY_SQL}, {PAIR_SQL},
k AS (SELECT doc_id, item_id, ri, e, CASE WHEN differ THEN e ELSE 0 END AS c,
        row_number() OVER (PARTITION BY doc_id, item_id, ri ORDER BY e DESC) AS re,
        row_number() OVER (PARTITION BY doc_id, item_id, ri ORDER BY CASE WHEN differ THEN e ELSE 0 END DESC) AS rc FROM sc),
l1 AS (SELECT doc_id, item_id, ri, avg(e) FILTER (re <= 3) AS e, avg(c) FILTER (rc <= 3) AS c, avg(1 - e) FILTER (re <= 3) AS n
       FROM k GROUP BY doc_id, item_id, ri),
k2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY e DESC) AS re, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c DESC) AS rc FROM l1),
l2 AS (SELECT doc_id, item_id, round(avg(e) FILTER (re <= 8), 6) AS entailment, round(avg(c) FILTER (rc <= 8), 6) AS contradiction, round(median(n), 6) AS neutral
       FROM k2 GROUP BY doc_id, item_id)
SELECT doc_id AS article_url, item_id AS press_release_url, entailment, contradiction, neutral,
       CAST(row_number() OVER (PARTITION BY item_id ORDER BY entailment DESC, doc_id) AS INTEGER) AS rank FROM l2 QUALIFY rank <= 5""")
def release_coverage(t):
    """For each release: the five documents that cover it most strongly."""
    return linkage.coverage(t.spread("documents", "doc_id"), t.benchmark, "doc_id", "item_id")


@query(f"""
SELECT c.conv_id AS doc_idx, c.turn AS article_sent_idx, b.turn AS archive_headline_idx,
  round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x) ELSE 0 END, 6) AS model_prediction
FROM (SELECT conv_id, turn, list_distinct({words_sql('text')}) AS x FROM conversations WHERE role = 'user') c
JOIN (SELECT conv_id, turn, list_distinct({words_sql('text')}) AS y FROM conversations WHERE role = 'assistant') b USING (conv_id)""")
def consistency_scores(t):
    """User turns against all assistant turns of their conversation, scored in batches."""
    side = lambda role, i, s: t.conversations.where(F.col("role") == role).select(
        F.col("conv_id").alias("doc_idx"), F.col("turn").alias(i), F.col("text").alias(s)
    )
    archive = side("assistant", "archive_headline_idx", "archive_headline")
    pairs = joins.pair_with_candidates(side("user", "article_sent_idx", "article_sentence"), archive, "doc_idx")
    out = scoring.score_consistency(pairs)
    return out.select("doc_idx", "article_sent_idx", "archive_headline_idx", F.round("model_prediction", 6).alias("model_prediction"))


@query()
def viewer_graph(t):
    from tidings.sources.writers import viewer_json

    return viewer_json(linkage.document_graphs(t.spread("documents", "doc_id"), t.benchmark, "doc_id", "item_id", "text", 0.3, -1.0))


@query(f"""
WITH m AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS main_event FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
f AS (SELECT conv_id, text FROM conversations WHERE turn = 0)
SELECT conv_id, f.text, main_event FROM f JOIN m USING (conv_id)""")
def main_event_pairs(t):
    releases = t.conversations.where("turn = 0").select("conv_id", "text")
    label = F.when(F.col("role") == "assistant", "Main").otherwise("NA")
    sents = t.conversations.select("conv_id", "turn", F.col("text").alias("sentences"), label.alias("discourse_preds"))
    return reports.main_event_pairs(releases, sents, "conv_id", "text", order="turn")


@query(f"""
WITH v AS (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id) AS a, max(turn) OVER (PARTITION BY conv_id) AS z FROM conversations),
s AS (SELECT conv_id, turn, a, z, unnest(range(1, len(l) + 1)) - 1 AS i, unnest(l) AS sentence
      FROM (SELECT conv_id, turn, a, z, {sentences_sql('text')} AS l FROM v WHERE a <> z)),
f AS (SELECT conv_id, sentence, min(i) AS i FROM s WHERE turn = a GROUP BY ALL), l AS (SELECT conv_id, sentence, min(i) AS i FROM s WHERE turn = z GROUP BY ALL)
SELECT conv_id, 'removed' AS change, CAST(i AS INTEGER) AS sent_idx, sentence FROM f ANTI JOIN l USING (conv_id, sentence)
UNION ALL SELECT conv_id, 'added', CAST(i AS INTEGER), sentence FROM l ANTI JOIN f USING (conv_id, sentence)""")
def version_difference(t):
    rows = t.conversations.withColumn("story", F.col("turn"))
    return reports.version_difference(rows, "conv_id", "turn", "story", "text")


@query("""
WITH v AS (SELECT role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version_number FROM conversations)
SELECT version_number, coalesce(round(avg(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END), 6), -1) AS rate
FROM v GROUP BY version_number""")
def boilerplate_rate(t):
    """A closing line names the role; two of the lines are known."""
    body = F.concat("text", F.lit("\nBy hand, made by x\n made by "), "role", F.lit(" \nend"))
    rows = t.conversations.withColumn("body", body)
    lines = {"made by user": True, "made by assistant": False}
    out = reports.boilerplate_rate(rows, "conv_id", "turn", "role", "body", "made by", "By", lines)
    return out.select("version_number", F.coalesce(F.round("rate", 6), F.lit(-1.0)).alias("rate"))
