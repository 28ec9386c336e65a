"""URLs, crawl lines, HTML, sentences and other text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidings import lexicon
from tidings.functions import arrays, html, text, urls
from tidings.operators import predicates as pred
from tidings.operators import boundaries, coreference, domains, gazetteer, scoring, sequence_labels, summaries
from tidings.operators.aggregates import concat_by_key, ordered_lists
from tidings.operators.windows import keep_first_duplicate, zip_explode
from tidings.plans.combine import extract_articles
from tidings.plans.shape import unpack
from tidings.plans.storage import materialize
from tidings.sources.readers import enrich_packets, parse_crawl_index
from workload.registry import query, sentences_sql, words_sql

HOST_SQL = "regexp_replace(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '')"


# ---- URLs and crawl lines -------------------------------------------------------------------------
SUFFIX_RULES = ["org", "com", "example.org", "*.com", "!www.com"]


@query(rf"""
WITH h AS (SELECT page_id, lower({HOST_SQL.format('url')}) AS host FROM pages),
l AS (SELECT page_id, host, string_split(host, '.') AS l FROM h),
r(rule) AS (VALUES {", ".join(f"('{x}')" for x in SUFFIX_RULES)}),
k AS (SELECT regexp_replace(rule, '^(!|\*\.)', '') AS suffix, starts_with(rule, '!') AS exception,
        len(string_split(regexp_replace(rule, '^(!|\*\.)', ''), '.')) + CASE WHEN rule[1] = '!' THEN -1 WHEN rule[1] = '*' THEN 1 ELSE 0 END AS n FROM r),
f AS (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY exception DESC, n DESC) AS rn FROM l JOIN k ON host = suffix OR ends_with(host, '.' || suffix))
SELECT page_id, host, CASE WHEN len(l) > coalesce(n, 1) AND NOT regexp_full_match(host, '[0-9.]+') THEN array_to_string(l[-(coalesce(n, 1) + 1):], '.') END AS domain
FROM l LEFT JOIN (FROM f WHERE rn = 1) USING (page_id)""")
def registered_domains(t):
    """Domains of the pages by a table of suffix rules with a wildcard and an exception."""
    rules = t._spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    rows = t.pages.select("page_id", F.lower(urls.url_host(F.col("url"))).alias("host"))
    return domains.registered_domains(rows, "host", rules)


@query("""
SELECT url, regexp_replace(url, '[?#].*$', '') AS clean, trim(split_part(url, '?', 1)) AS stripped FROM pages""")
def url_clean(t):
    u = F.col("url")
    return t.pages.select("url", urls.clean_url(u).alias("clean"), urls.strip_url(u).alias("stripped"))


@query(f"""
WITH h AS (SELECT url, string_split(lower({HOST_SQL.format('url')}), '.') AS p FROM pages)
SELECT url, array_to_string(p, '.') AS host,
       CASE WHEN len(p) >= 3 AND array_to_string(p[-2:], '.') IN ('co.uk', 'com.au', 'org.uk', 'co.jp') THEN p[-3]
            WHEN len(p) = 1 THEN p[1] ELSE p[-2] END AS domain FROM h""")
def url_host(t):
    u = F.col("url")
    return t.pages.select("url", urls.url_host(u).alias("host"), urls.registered_domain(u).alias("domain"))


@query("""
SELECT url, split_part(url, '/', 4) AS part, array_to_string(regexp_extract_all(url, '\\d+'), ',') AS numbers FROM pages""")
def url_parts(t):
    u = F.col("url")
    return t.pages.select(
        "url", F.coalesce(urls.path_part(u, 3), F.lit("")).alias("part"), F.array_join(urls.number_tokens(u), ",").alias("numbers")
    )


@query("""
SELECT event_id, map {'com,click': 'https://www.click.com', 'com,view': 'https://view.com'}['com,' || event_type]
       || '/' || user_id || '.html' AS address FROM events WHERE event_type IN ('click', 'view')""")
def surt_addresses(t):
    key = F.concat(F.lit("com,"), "event_type", F.lit(")/"), F.col("user_id").cast("string"), F.lit(".html"))
    sites = {"com,click": "https://www.click.com", "com,view": "https://view.com"}
    rows = t.events.select("event_id", urls.surt_to_url(key, sites).alias("address"))
    return pred.drop_nulls(rows, ["address"])


def _crawl_lines(t):
    """Crawl lines made from events: key with a query part, stamp, JSON body."""
    return t.events.select(
        F.format_string(
            'com,%s)/%d/p.html?x=%d %s {"url": "https://%s.com/%d", "status": "%s"}', "event_type", "user_id", "event_id",
            F.date_format("ts", "yyyyMMddHHmmss"), "event_type", "user_id",
            F.when(F.col("value") > 50, "404").otherwise("200"),
        ).alias("line"),
        "event_id",
    )


@query("""
WITH c AS (SELECT event_id, 'com,' || event_type || ')/' || user_id || '/p.html' AS url,
                  strftime(ts, '%Y%m%d%H%M%S') AS ts, CASE WHEN value > 50 THEN '404' ELSE '200' END AS status FROM events),
f AS (SELECT * FROM c WHERE status = '200' AND ts >= '20240105' AND contains(url, 'click'))
SELECT url, min(ts) AS ts, min(ts) AS date, '200' AS status, arg_min(url, event_id) AS article_url FROM f GROUP BY url""")
def crawl_index(t):
    parsed = parse_crawl_index(_crawl_lines(t).select("line"))
    kept = pred.crawl_filter(
        parsed, F.col("url"), F.col("packet.status"), F.col("date"), url_part="click", statuses=[200], since="20240105"
    )
    first = keep_first_duplicate(kept, ["url"], ["ts", F.to_json("packet")])
    stamp = F.col("scrape_timestamp")
    return enrich_packets(first).select(
        F.col("article_url").alias("url"), stamp.alias("ts"), stamp.alias("date"), "status", "article_url"
    )


@query("""
SELECT event_id, '/' || user_id || '/p.html' AS stripped, '/' || user_id || '/p.html' AS crawl_key FROM events""")
def crawl_keys(t):
    raw = F.get(F.split("line", " "), 0)
    return _crawl_lines(t).select("event_id", urls.strip_url(raw).alias("stripped"), urls.clean_crawl_key(raw).alias("crawl_key"))


# ---- HTML ----------------------------------------------------------------------------------------------
LINKS_SQL = """
SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>[^<]*</a>', 1) AS h,
       regexp_extract_all(html, '<a href="[^"]*"[^>]*>([^<]*)</a>', 1) AS x FROM pages"""


@query(f"""
WITH l AS ({LINKS_SQL}) SELECT page_id, h[i] AS href, x[i] AS text
FROM l, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i) WHERE x[i] <> ''""")
def page_links(t):
    return t.pages.select("page_id", F.inline(html.extract_links("html"))).select("page_id", "href", "text")


@query(f"""
WITH l AS ({LINKS_SQL}) SELECT page_id, h[i] AS href, trim(x[i]) AS text, '' AS title
FROM l, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i) WHERE h[i] <> ''""")
def page_hyperlinks(t):
    rows = t.pages.select("page_id", F.inline(html.hyperlink_attributes("html")))
    return rows.select("page_id", "href", "text", F.coalesce("title", F.lit("")).alias("title"))


@query()
def page_text(t):
    return t.pages.select("page_id", html.html_to_text("html").alias("text"))


@query()
def page_plain_text(t):
    return t.pages.select("page_id", html.html_plain("html").alias("text"))


def _parsed_pages(t):
    return extract_articles(t.spread("pages", "page_id").select(F.col("url").alias("article_url"), "html"))


@query()
def links_with_offsets(t):
    parsed = _parsed_pages(t)
    links = parsed.select("article_url", "article_text", F.explode_outer("links").alias("l"))
    cut = F.expr("substring(article_text, l.char_start_idx + 1, l.char_end_idx - l.char_start_idx)")
    return links.select("article_url", F.length("article_text").alias("n_chars"), "l.*", (cut == F.col("l.text")).alias("fits"))


@query("""
SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'view' AND value > 95) > 0""")
def articles_with_release_link(t):
    """The link rule inside link arrays: users as articles, their events as links."""
    link = F.struct(
        F.format_string("https://%s.com/%d", "event_type", "event_id").alias("href"),
        F.when(F.col("value") > 95, "we announce").otherwise("here").alias("text"),
    )
    articles = ordered_lists(t.events.select("user_id", "event_id", link.alias("links")), "user_id", "event_id", "links")
    return pred.articles_with_release_link(articles, "links", ["view"]).select("user_id").distinct()


@query("""
SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN 0 WHEN user_id % 7 = 0 THEN 1 WHEN user_id % 5 = 0 THEN 1 ELSE 0
END AS INTEGER) AS is_press_release FROM events""")
def link_rule(t):
    """The link rule on addresses made from events, with a table of blocked domains."""
    links = t.events.select(
        "event_id",
        F.when(F.col("user_id") % 5 == 0, F.format_string("https://www.%s.com/press/%d", "event_type", "event_id"))
        .otherwise(F.format_string("https://www.%s.com/about/%d", "event_type", "event_id")).alias("href"),
        F.when(F.col("user_id") % 7 == 0, F.lit("the press release")).otherwise("here").alias("text"),
    )
    blocked = t.events.where("event_type = 'view'").select(F.col("event_type").alias("domain"))
    return pred.flag_release_links(links, blocked).select("event_id", F.col("is_press_release").cast("int").alias("is_press_release"))


@query(f"""
WITH d AS (SELECT event_id, event_type || '.com' AS host FROM events) SELECT event_id FROM d WHERE host <> 'view.com'""")
def blocked_domains(t):
    rows = t.events.select("event_id", F.concat(F.lit("https://www."), "event_type", F.lit(".com/x")).alias("url"))
    blocked = t.events.where("event_type = 'view'").select(F.col("event_type").alias("domain"))
    return pred.drop_blocked_domains(rows, "url", blocked).select("event_id")


@query("""
WITH h AS (SELECT lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '')) AS host FROM pages),
p AS (SELECT host, string_split(host, '.') AS p FROM h)
SELECT CASE WHEN len(p) >= 3 AND array_to_string(p[-2:], '.') IN ('co.uk', 'com.au', 'org.uk', 'co.jp') THEN p[-3]
            WHEN len(p) = 1 THEN p[1] ELSE p[-2] END AS domain FROM p
UNION SELECT unnest(['facebook', 'twitter', 'instagram', 'linkedin', 'youtube', 'tiktok', 'reddit', 'pinterest', 'wire'])""")
def domain_blacklist(t):
    from tidings.operators.reports import domain_blacklist as build

    return build(t.pages, "url", extra=["wire"])


# ---- text functions ------------------------------------------------------------------------------------------
@query(r"""
SELECT doc_id, md5(trim(regexp_replace(text, ' +', ' ', 'g'))) AS collapsed, substring(text, 1, 500) AS head,
       coalesce((list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))[1], '') AS first_token
FROM documents""")
def text_cleaning(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.md5(text.collapse_spaces(x)).alias("collapsed"), text.first_chars(x, 500).alias("head"),
        F.coalesce(text.first_token(x), F.lit("")).alias("first_token"),
    )


@query(r"""
SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(
  regexp_replace(text, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', ' ', 'g'), '\s+'), lambda x: x <> ''), ' ')) AS words
FROM documents""")
def punctuation_split(t):
    return t.documents.select("doc_id", F.md5(F.array_join(text.split_punctuation(F.col("text")), " ")).alias("words"))


@query()
def normalized_text(t):
    return t.spread("documents", "doc_id").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal"))


@query()
def clean_sentences(t):
    return t.spread("documents", "doc_id").select("doc_id", F.posexplode(text.clean_sentences(F.col("text"))).alias("sent_idx", "sentence"))


@query("""
SELECT doc_id, len(string_split(text, ' the ')) AS pieces, trim(replace(text, ' the ', '')) AS rest FROM documents""")
def split_by_part(t):
    part = F.lit(" the ")
    return t.documents.select(
        "doc_id", text.count_pieces(F.col("text"), part).cast("long").alias("pieces"), text.remove_part(F.col("text"), part).alias("rest")
    )


@query("""
WITH m AS (SELECT conv_id, string_agg(text, '<NEW_SENT>' ORDER BY turn) AS docs FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS sent_idx, string_split(docs, '<NEW_SENT>')[i] AS sentence
FROM m, LATERAL (SELECT unnest(range(1, len(string_split(docs, '<NEW_SENT>')) + 1)) AS i)""")
def marked_sentences(t):
    docs = concat_by_key(t.conversations, "conv_id", "text", "turn", "<NEW_SENT>", "docs")
    return docs.select("conv_id", F.posexplode(text.split_marked_sentences(F.col("docs"))).alias("sent_idx", "sentence"))


@query(r"""
WITH m AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string((list_filter(regexp_split_to_array(replace(replace(t, ' .', '.'), chr(10), ' '), '\s+'),
  lambda x: x <> '')), ' ') AS prepared FROM m""")
def prepared_for_resolution(t):
    docs = ordered_lists(t.conversations, "conv_id", "turn", "text")
    return docs.select("conv_id", text.prepare_for_resolution(F.col("text")).alias("prepared"))


@query(f"""
WITH e AS (SELECT doc_id, list_distinct({words_sql('text')}) AS ents FROM documents)
SELECT doc_id, md5(array_to_string(list_sort(list_filter(ents, lambda x: x NOT IN ('the', 'of', 'and'))), ' ')) AS ents FROM e""")
def excluded_entities(t):
    ents = arrays.clean_entities(F.array_distinct(text.tokens(F.upper("text"))))
    rest = arrays.remove_excluded(ents, F.array(F.lit("the"), F.lit("of"), F.lit("and")))
    lists = t.spread("documents", "doc_id").select("doc_id", rest.alias("e"))
    return lists.select("doc_id", F.md5(F.array_join(F.sort_array("e"), " ")).alias("ents"))


@query("""
SELECT o_orderkey, CAST(replace(o_orderpriority, 'X', '')[1] AS INTEGER) AS n,
       coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'Error') AS label,
       o_orderkey || ':::' || o_custkey AS id, CAST(o_custkey AS INTEGER) AS stripped FROM orders""")
def small_text_functions(t):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t.orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("n"),
        F.coalesce(status, F.lit("Error")).alias("label"),
        text.doc_position_id(F.col("o_orderkey"), F.col("o_custkey")).alias("id"),
        urls.strip_prefix_int(F.concat(F.lit("S"), "o_custkey"), "S").alias("stripped"),
    )


@query("""
SELECT p_partkey, replace(p_name, ' ', '')[3] AS third,
       coalesce(CAST(regexp_extract('part-' || p_partkey || '.csv', '-(\\d+)\\.csv', 1) AS INTEGER), -1) AS suffix FROM part""")
def part_names(t):
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".csv"))
    return t.part.select(
        "p_partkey", text.kth_char(F.col("p_name"), F.lit(3)).alias("third"), urls.number_suffix(name).alias("suffix")
    )


@query("""
WITH c AS (SELECT p_partkey, lower(p_brand) || lower(p_type) AS o, string_split(p_name, '') AS a FROM part)
SELECT p_partkey, array_to_string(list_filter(a, lambda x, i: len(list_filter(a[1:i], lambda y: y = x)) > length(o) - length(replace(o, x, ''))), '') AS rest
FROM c""")
def part_name_differences(t):
    """Letters of a part name left once those of its brand and type are struck out."""
    other = F.concat(F.lower("p_brand"), F.lower("p_type"))
    return t.part.select("p_partkey", text.string_difference(F.col("p_name"), other).alias("rest"))


@query("""
SELECT md5(string_agg(p_type, '' ORDER BY p_partkey)) AS joined, count(*) AS n FROM part GROUP BY p_brand""")
def ordered_concat(t):
    joined = concat_by_key(t.part, "p_brand", "p_type", "p_partkey", "", "joined")
    n = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return joined.join(n, "p_brand").select(F.md5("joined").alias("joined"), "n")


@query("""
SELECT conv_id, CASE WHEN role = 'user' THEN 'DIRECT QUOTE' WHEN role = 'assistant' THEN 'SOCIAL MEDIA POST' ELSE role END AS kind,
       count(*) AS n FROM conversations GROUP BY ALL""")
def quote_types(t):
    raw = F.when(F.col("role") == "user", "QUOTE").when(F.col("role") == "assistant", "TWEET").otherwise(F.col("role"))
    sentence = F.regexp_replace("text", '"', "")
    return t.conversations.select("conv_id", arrays.quote_type(raw, sentence).alias("kind")).groupBy("conv_id", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("""
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best,
       round(exp(CAST(list_max(embedding) AS DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS p
FROM embeddings""")
def label_argmax(t):
    probs = arrays.softmax(F.col("embedding"))
    rows = t.embeddings.select("vec_id", arrays.argmax_index(F.col("embedding")).alias("best"), probs.alias("_p"))
    return rows.select("vec_id", "best", F.round(F.array_max("_p"), 6).alias("p"))


@query("""
SELECT conv_id, turn, CAST(i AS INTEGER) AS i, CASE WHEN abs(i - turn) <= 2 THEN pow(0.5, abs(i - turn)) ELSE 0 END AS w
FROM conversations, LATERAL (SELECT unnest(range(0, 6)) AS i)""")
def decay_windows(t):
    weights = arrays.decay_weights(F.lit(6), F.col("turn"), 2, 0.5)
    return t.conversations.select("conv_id", "turn", F.posexplode(weights).alias("i", "w"))


@query("""
WITH d AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS a, list(l_partkey ORDER BY l_linenumber, l_partkey) AS b
           FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a[i] AS l_linenumber, b[i] AS l_partkey FROM d, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)""")
def zipped_lists(t):
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), "l_linenumber", "l_partkey")
    docs = ordered_lists(rows, "l_orderkey", "o", "l_linenumber", "l_partkey")
    return zip_explode(docs, ["l_orderkey"], "l_linenumber", "l_partkey")


@query("""
WITH r AS (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id FROM r WHERE list_contains(roles, 'user') AND list_contains(roles, 'system')""")
def contains_all_labels(t):
    r = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return r.where(arrays.contains_all(F.col("roles"), ["user", "system"])).select("conv_id")


@query("""
SELECT doc_id, lang || '; ' || source AS authors, substring(text, 11, 20) AS span FROM documents""")
def joined_authors_and_spans(t):
    return t.documents.select(
        "doc_id", arrays.join_authors(F.array("lang", "source")).alias("authors"),
        arrays.cut_span(F.col("text"), F.lit(29), F.lit(10)).alias("span"),
    )


# ---- scoring of single sentences -------------------------------------------------------------------------------
@query(f"""
WITH s AS (SELECT doc_id, {sentences_sql('text')} AS l FROM documents),
r AS (SELECT doc_id, i - 1 AS i, len(l) AS n, l[i] AS sentences FROM s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))
SELECT doc_id, CAST(i AS INTEGER) AS sent_idx, md5(sentences) AS sentence, CASE WHEN i = 0 THEN 'Main' WHEN i < n * 0.25 THEN 'Main_Consequence'
  WHEN i < n * 0.5 THEN 'Cause_Specific' WHEN i < n * 0.75 THEN 'Cause_General' ELSE 'Distant_Evaluation' END AS discourse_preds
FROM r""")
def discourse_labels(t):
    docs = t.spread("documents", "doc_id").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return scoring.score_discourse(docs, "doc_id", "s").select(
        "doc_id", "sent_idx", F.md5("sentences").alias("sentence"), "discourse_preds"
    )


@query()
def turn_labels(t):
    """Who speaks in each turn, told from its words and the turns around it; learned from the turns themselves."""
    model = sequence_labels.learn_sequence_model(t.conversations, "conv_id", "turn", "role", "text")
    return sequence_labels.label_sequences(model, t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query()
def learned_sentences(t):
    """Sentences cut by abbreviations and sentence starters that the documents themselves give away."""
    docs = t.spread("documents", "doc_id").select("doc_id", "text")
    known = materialize(boundaries.abbreviations(boundaries.stop_counts(docs, "text")), "abbreviations")
    starters = materialize(boundaries.sentence_starters(docs, "text", known), "starters")
    out = boundaries.split_sentences(docs, ["doc_id"], "text", known, starters)
    return out.select("doc_id", "sent_idx", F.md5("sentence").alias("sentence"))


SHORT_SQL = r"(SELECT DISTINCT lower(k) AS word FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS k FROM documents) WHERE length(k) <= 3)"


@query(rf"""
WITH short AS {SHORT_SQL},
p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents),
c AS (SELECT doc_id, i, l[i] AS piece, lower(regexp_extract(l[i - 1], '(\p{{L}}[\p{{L}}\p{{N}}.&''-]*)\.$', 1)) AS before FROM p, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
m AS (SELECT doc_id, i, piece, sum(CASE WHEN i > 1 AND (word IS NOT NULL OR length(before) = 1) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM c LEFT JOIN short ON before = word)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS sent_idx, md5(string_agg(piece, ' ' ORDER BY i)) AS sentence FROM m GROUP BY doc_id, n""")
def sentences_by_rule(t):
    """The rule with a given table: every word of at most three letters counts as an abbreviation."""
    docs = t.spread("documents", "doc_id").select("doc_id", "text")
    letters = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))
    short = unpack(docs, [], letters, "word").where(F.length("word") <= 3).select(F.lower("word").alias("word")).distinct()
    out = boundaries.split_sentences(docs, ["doc_id"], "text", short)
    return out.select("doc_id", "sent_idx", F.md5("sentence").alias("sentence"))


@query()
def sentence_quote_types(t):
    rows = t.conversations.select("conv_id", "turn", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    return scoring.score_sentences(rows).select("conv_id", "turn", "sentence", "quote_type", F.round(F.element_at("quote_type_probs", F.col("quote_type")), 6).alias("p"))


@query()
def sentence_chain(t):
    out = scoring.sentence_chain(t.spread("documents", "doc_id").select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("sent_lists").alias("n_sentences"), F.size("word_lists").alias("n_words"), F.get("best_class", 0).alias("first_class"))


@query()
def resolved_sentences(t):
    docs = t.spread("documents", "doc_id").select("doc_id", text.sentences(F.col("text")).alias("sent_lists"))
    out = scoring.resolve_coreference(docs)
    return out.select("doc_id", F.posexplode("coref_resolved_sents").alias("sent_idx", "sentence"))


def _listed(words):
    return ", ".join(f"'{w}'" for w in words)


_HE, _SHE, _ANY = (_listed(lexicon.TITLES[k]) for k in ("he", "she", "any"))
_PIECE_SQL = r"\p{Lu}[\p{L}\p{N}\-]*(?: \p{Lu}[\p{L}\p{N}\-]*)*|[\p{L}\p{N}\-]+"
COREFERENCE_SQL = rf"""
WITH s AS (SELECT doc_id, unnest(range(0, len(l))) AS sent_idx, unnest(l) AS sentence FROM (SELECT doc_id, {sentences_sql("text")} AS l FROM documents)),
w AS (SELECT doc_id, sent_idx, sentence, regexp_extract_all(sentence, '{_PIECE_SQL}') AS p FROM s),
m AS (SELECT * FROM (SELECT doc_id, sent_idx, unnest(range(0, len(p))) AS pos, unnest(p) AS mention FROM w)
      WHERE regexp_matches(mention, '^\p{{Lu}}') OR mention IN ({_listed(lexicon.PRONOUN_NAMES)})),
k AS (SELECT *, CASE WHEN lower(mention) IN ({_listed(lexicon.PRONOUN_NAMES)}) THEN lower(mention) END AS pronoun FROM m),
n AS (SELECT doc_id, mention, min((sent_idx, pos)) AS first, string_split(mention, ' ') AS ws, len(string_split(mention, ' ')) AS n FROM k WHERE pronoun IS NULL GROUP BY doc_id, mention),
f AS (SELECT doc_id, array_to_string(ws[-j:], ' ') AS form, 0 AS sieve, n, first, mention FROM n, (SELECT unnest([1, 2, 3]) AS j) WHERE n > j
      UNION ALL SELECT doc_id, array_to_string(ws[1:j], ' '), 1, n, first, mention FROM n, (SELECT unnest([1, 2, 3]) AS j) WHERE n > j
      UNION ALL SELECT doc_id, array_to_string(list_transform(ws, lambda x: x[1]), ''), 2, n, first, mention FROM n WHERE n > 1),
t AS (SELECT doc_id, form, mention AS target, sieve FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, form ORDER BY sieve, n DESC, first, mention) = 1),
r AS (SELECT n.doc_id, n.mention, a.sieve, coalesce(c.target, b.target, a.target, n.mention) AS referent FROM n
      LEFT JOIN t a ON a.doc_id = n.doc_id AND a.form = n.mention LEFT JOIN t b ON b.doc_id = n.doc_id AND b.form = a.target
      LEFT JOIN t c ON c.doc_id = n.doc_id AND c.form = b.target WHERE n.n > 1 OR a.sieve IS NOT NULL),
g AS (SELECT k.*, r.sieve, r.referent, string_split(r.referent, ' ') AS v FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.mention = k.mention AND k.pronoun IS NULL),
h AS (SELECT *, list_has_any(v, [{_listed(lexicon.ORGANISATION_WORDS)}]) AS body, list_has_any(v, [{_HE}]) AS he, list_has_any(v, [{_SHE}]) AS she, list_has_any(v, [{_ANY}]) AS person FROM g),
q AS (SELECT *, CASE pronoun
        WHEN 'he' THEN last_value(CASE WHEN NOT body AND NOT she THEN referent END IGNORE NULLS) OVER so_far
        WHEN 'she' THEN last_value(CASE WHEN NOT body AND NOT he THEN referent END IGNORE NULLS) OVER so_far
        WHEN 'it' THEN last_value(CASE WHEN NOT he AND NOT she AND NOT person THEN referent END IGNORE NULLS) OVER so_far
        WHEN 'they' THEN last_value(referent IGNORE NULLS) OVER so_far END AS meant
      FROM h WINDOW so_far AS (PARTITION BY doc_id ORDER BY sent_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
links AS (SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx, CAST(pos AS INTEGER) AS "at", mention,
            CASE WHEN pronoun IS NOT NULL THEN 'pronoun' ELSE ['suffix', 'prefix', 'acronym'][sieve + 1] END AS sieve, CASE WHEN pronoun IS NULL THEN referent ELSE meant END AS referent
          FROM q WHERE CASE WHEN pronoun IS NULL THEN sieve IS NOT NULL ELSE meant IS NOT NULL END)"""


@query(f"{COREFERENCE_SQL} SELECT * FROM links")
def resolved_mentions(t):
    """Short names, initials and pronouns of whole texts, with the full name that each stands for."""
    rows = coreference.sentence_rows(t.spread("documents", "doc_id"), "doc_id", "text")
    return coreference.resolve_mentions(materialize(rows, "sentences")).withColumnRenamed("doc", "doc_id")


@query(rf"""{COREFERENCE_SQL},
new AS (SELECT doc_id, sent_idx, map_from_entries(list((l."at", l.referent))) AS new FROM links l GROUP BY doc_id, sent_idx)
SELECT doc_id, CAST(w.sent_idx AS INTEGER) AS sent_idx, md5(array_to_string(list_transform(range(1, len(g) + 1), lambda j: g[j] || coalesce(new[CAST(j - 1 AS INTEGER)], p[j], '')), '')) AS sentence
FROM (SELECT *, regexp_split_to_array(sentence, '{_PIECE_SQL}') AS g FROM w) w LEFT JOIN new USING (doc_id, sent_idx)""")
def resolved_full_names(t):
    """All sentences with every reference spelled out."""
    out = coreference.resolved_texts(t.spread("documents", "doc_id"), "doc_id", "text")
    return out.select(F.col("doc").alias("doc_id"), "sent_idx", F.md5("sentence").alias("sentence"))


@query(rf"""
WITH d AS (SELECT doc_id, array_to_string({sentences_sql("replace(text, chr(10), ' ')")}, ' ') AS t FROM documents)
SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '((?:\p{{Lu}}[\p{{L}}\p{{N}}&.\-]*\p{{L}})(?:\s+\p{{Lu}}[\p{{L}}\p{{N}}&.\-]*\p{{L}})*)', 1)) AS entity FROM d""")
def document_entities(t):
    out = scoring.extract_entities(t.spread("documents", "doc_id").select("doc_id", "text"), "text")
    return out.select("doc_id", F.explode("ents").alias("entity"))


@query(f"""
WITH b AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
g AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS k, n, 'opening' AS type FROM b, (SELECT unnest([2, 3, 5]) AS n) WHERE len(w) >= n
      UNION SELECT DISTINCT array_to_string(w[-3:], ' '), 3, 'close' FROM b WHERE len(w) >= 3),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT unnest([2, 3, 5]) AS n) WHERE i + n - 1 <= len(w)),
m AS (SELECT doc_id, i, n, k, type FROM p JOIN g USING (n, k)),
s AS (SELECT *, max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT doc_id, i, n FROM m))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS at, CAST(n AS INTEGER) AS n, k AS entity, type FROM m JOIN s USING (doc_id, i, n) WHERE reach IS NULL OR i + n > reach""")
def typed_entities(t):
    """Openings and closing words of the benchmark items as a typed list of names."""
    words = text.tokens(F.col("text"))
    part = lambda kind, n, cut: t.benchmark.where(F.size(words) >= n).select(F.array_join(cut, " ").alias("name"), F.lit(kind).alias("type"))
    opening = [part("opening", n, F.slice(words, 1, n)) for n in (2, 3, 5)]
    names = reduce(lambda a, b: a.unionByName(b), [*opening, part("close", 3, F.slice(words, -3, 3))])
    out = gazetteer.typed_entities(t.spread("documents", "doc_id"), "doc_id", "text", names)
    return out.withColumnRenamed("doc", "doc_id")


@query()
def attributed_sources(t):
    docs = t.spread("documents", "doc_id").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return scoring.attribute_sources(docs, "doc_id", "s").select("doc_id", "sent_idx", "attribution")


@query(f"""
WITH p AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS passage FROM conversations GROUP BY conv_id, role)
SELECT conv_id, role, coalesce({sentences_sql('passage')}[1], '') AS summary FROM p""")
def group_summaries(t):
    out = scoring.summarise_groups(t.conversations, "conv_id", "role", "text", "turn", first_docs=None)
    return out.select("conv_id", "role", F.coalesce("summary", F.lit("")).alias("summary"))


@query()
def ranked_summaries(t):
    """The sentence of each speaker of each conversation that the others are most like."""
    out = summaries.graph_summaries(t.conversations, ["conv_id", "role"], "turn", "text")
    return out.select("conv_id", "role", "sentence", F.round("rank", 4).alias("rank"))


@query("""
WITH l AS (SELECT conv_id AS url, string_split(string_agg(text, '<NEW_SENT>' ORDER BY turn), '<NEW_SENT>') AS s FROM conversations GROUP BY conv_id),
r AS (SELECT url, i - 1 AS k, len(s) AS n, s[i] AS sentence FROM l, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i))
SELECT url, CAST(k AS INTEGER) AS sent_idx, sentence, CASE WHEN k = 0 THEN 'Main' WHEN k < n * 0.25 THEN 'Main_Consequence'
  WHEN k < n * 0.5 THEN 'Cause_Specific' WHEN k < n * 0.75 THEN 'Cause_General' ELSE 'Distant_Evaluation' END AS discourse_label FROM r""")
def marked_sentence_labels(t):
    turns = t.conversations.withColumnRenamed("conv_id", "url")
    docs = concat_by_key(turns, "url", "text", "turn", "<NEW_SENT>", "docs")
    return scoring.marked_sentences_pipeline().fit(docs).transform(docs)


@query()
def release_prompts(t):
    docs = t.documents.select("doc_id", "text", F.get(text.sentences(F.col("text")), 0).alias("lead"))
    block = scoring.example_block(docs.where("lead is not null"), "doc_id", "text", "lead", first=5)
    return scoring.prompts(t.benchmark, "text", block).select("item_id", "prompt")
