"""One query per operator over the provided tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.debruijn import WINDOW, remove_repeated_passages
from tidings.llm.decontaminate import benchmark_hits
from tidings.llm.filter_audit import audit_filters
from tidings.llm.fingerprints import fingerprints
from tidings.llm.language import identified
from tidings.llm.lm_scores import score_documents
from tidings.llm.manifest import FIELDS, build, leaf_digest, prove
from tidings.llm.mixing import mix
from tidings.llm.near_dedup import near_duplicates
from tidings.llm.repeats import remove_repeats
from tidings.llm.secrets import BASE_RULES, RULES, find_secrets, joined_spans
from tidings.llm.sharding import assign_shards
from tidings.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# fixed values of the task: host, path, verdict
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha256(column: str | Column) -> Column:
    return F.sha2(column, 256)


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    return identified(table(spark, folder).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder)).drop("text_hash")


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op2_near_duplicates"] = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL}, '[^ \x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
),
x AS (SELECT r, len(s) AS n, unnest(s) AS v FROM s),
links AS (
    SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.v = b.v AND a.r <> b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(o.doc_id) AS component_id, s.doc_id = min(o.doc_id) AS kept
FROM s JOIN reach ON s.r = reach.a JOIN s o ON o.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""


@query
def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256("kept_bytes").alias("kept_sha256"))


@query
def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLE["op4_url_rules"] = f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
parts AS (
    SELECT page_id, url, row_number() OVER () AS r,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
    FROM pages
),
fits AS (
    SELECT p.*, rh || rp AS rule, rv,
        row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, rh || rp DESC) AS k
    FROM parts p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE k = 1
"""


@query
def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = score_documents(table(spark, folder))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


ORACLE["op5_lm_scores"] = """
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS words
    FROM documents
),
marked AS (SELECT r, doc_id, len(words) AS n_words, CASE WHEN len(words) > 0 THEN [' begin'] || words || [' end'] ELSE [] END AS m FROM w),
pairs AS (SELECT r, unnest(m[:-2]) AS a, unnest(m[2:]) AS b FROM marked WHERE n_words > 0),
c1 AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
c2 AS (SELECT b, count(*) AS n FROM pairs GROUP BY b),
c12 AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b),
t AS (SELECT count(*) AS n FROM pairs),
s AS (
    SELECT r, sum(ln(CASE WHEN c12.n >= 2 THEN c12.n / c1.n ELSE 0.4 * c2.n / t.n END)) AS score
    FROM pairs JOIN c12 USING (a, b) JOIN c1 USING (a) JOIN c2 USING (b) CROSS JOIN t GROUP BY r
)
SELECT doc_id, n_words, round(coalesce(score, 0.0), 4) AS score,
    CASE WHEN n_words > 0 THEN round(score / (n_words + 1), 6) END AS mean_score
FROM marked LEFT JOIN s USING (r)
"""


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder).select("doc_id", "text"))
    base = {r.kind: f"spans_{r.kind}" for r in BASE_RULES}
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{kind}") for kind, c in base.items()],
        sha256(joined_spans(base)).alias("base_sha256"), joined_spans({r.kind: f"spans_{r.kind}" for r in RULES}).alias("spans"),
    )


def _spans_sql(kinds: list[str]) -> str:
    """Spans as the pieces between matches and the matches add up."""
    one = """SELECT r, {at} AS k, '{kind}' AS kind, i,
        list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a,
        length(m[i]) AS n, length(g[i]) AS g FROM (
        SELECT r, regexp_split_to_array(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d
    ), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)"""
    rules = [(at, r) for at, r in enumerate(RULES) if r.kind in kinds]
    parts = [
        f"SELECT * FROM ({one.format(at=at, kind=r.kind, pattern=r.pattern.replace(chr(39), chr(39) * 2), group=r.group)}) WHERE g >= {r.least}" for at, r in rules
    ]
    return " UNION ALL ".join(parts)


ORACLE["op6_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql([r.kind for r in RULES])}),
j AS (
    SELECT r, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < {len(BASE_RULES)}) AS base,
        {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)}
    FROM s GROUP BY r
)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_hits(table(spark, folder).select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = rf"regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op7_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS k
    FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0
),
g AS (
    SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS k
    FROM d CROSS JOIN (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
),
hit AS (SELECT r, i, n, item FROM g JOIN win USING (n, k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder).select("doc_id", "text"))


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder).select("doc_id", "text"), 16).drop("text")


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder)).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept")


@query
def op11_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeated_passages(table(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


ORACLE["op11_repeated_passages"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
win AS (
    SELECT r, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS k
    FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i) WHERE len(w) >= {WINDOW}
),
hit AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder), table(spark, folder, "labels"))


ORACLE["op12_filter_audit"] = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents
),
f AS (
    SELECT r, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
        coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
),
o AS (
    SELECT '' AS filter_order UNION ALL
    SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)
),
s AS (
    SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS k, list_transform(string_split(left(filter_order, step - 1), ''), lambda x: ascii(x) - 64) AS before
    FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5
),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
hit AS (
    SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS fails_here, len(before) > 0 AND list_bool_or(list_transform(before, lambda b: coalesce(fails[b], false))) AS gone,
        fails[k] AND len(list_filter(fails, lambda x: x)) = 1 AS only_here
    FROM g CROSS JOIN s
),
c AS (
    SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_here), 0) AS removed,
        coalesce(sum(n) FILTER (gone AND fails_here), 0) AS redundant, coalesce(sum(n) FILTER (only_here), 0) AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND fails_here), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_here), 0) AS toxic_lost
    FROM hit GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM c
"""


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder)
    raised = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    made = build(docs, FIELDS, claim=leaf_digest([raised if f == "n_chars" else F.col(f) for f in FIELDS]))
    root = F.lit(made.root)
    in_hex = lambda c: F.lower(F.hex(c))
    return prove(made).select(
        F.col("id").alias("doc_id"), in_hex("leaf").alias("leaf"), in_hex("subroot").alias("subroot"), in_hex(root).alias("root"),
        sha256(in_hex("proof")).alias("proof_sha256"), in_hex("folded_root").alias("folded_root"), (F.col("folded_root") == root).alias("verified"),
    )


_FIELD_SQL = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD_SQL.format(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


def _levels_sql(name: str, leaves: str) -> str:
    """Nodes of all levels over ``leaves`` (tree, idx, d, n)."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, idx, d, n FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, idx // 2, sha256(d || coalesce(next, '')), (n + 1) // 2
    FROM (SELECT *, lead(d) OVER (PARTITION BY tree ORDER BY idx) AS next FROM {name} WHERE n > 1) WHERE idx % 2 = 0
)"""


# CRC-32 bit by bit: of a byte table by the reversed polynomial 0xEDB88320, then over the digits
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE codes AS (
    SELECT b AS c, b, 0 AS k FROM (SELECT unnest(range(256)) AS b)
    UNION ALL SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b, k + 1 FROM codes WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM codes WHERE k = 8),
docs AS (
    SELECT row_number() OVER () AS r, *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc_table
),
h AS (SELECT r, doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS claim FROM docs),
leaves AS (
    SELECT *, leaf AS d, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM h
),
{_levels_sql("nodes", "leaves")},
roots AS (SELECT -1 AS tree, tree AS idx, d, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels_sql("tops", "roots")},
ups AS (SELECT unnest(range(0, 40)) AS up),
steps AS (
    SELECT r, 0 AS part, up, (l.idx >> up) % 2 = 1 AS odd, s.d FROM leaves l JOIN ups ON (l.n - 1) >> up > 0
        LEFT JOIN nodes s ON s.tree = l.tree AND s.level = up AND s.idx = xor(l.idx >> up, 1::BIGINT)
    UNION ALL
    SELECT r, 1, up, (l.tree >> up) % 2 = 1, s.d FROM leaves l JOIN ups ON ((SELECT count(*) FROM roots) - 1) >> up > 0
        LEFT JOIN tops s ON s.level = up AND s.idx = xor(l.tree >> up, 1::BIGINT)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY part, up) AS k FROM steps),
fold AS (
    SELECT r, 0 AS k, claim AS v FROM leaves
    UNION ALL SELECT r, k + 1, sha256(CASE WHEN odd THEN p.d || v ELSE v || coalesce(p.d, '') END) FROM fold JOIN (SELECT r, k - 1 AS k, odd, d FROM placed) p USING (r, k)
),
folded AS (SELECT r, arg_max(v, k) AS v FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(d, '' ORDER BY k), '')) AS proof FROM placed GROUP BY r)
SELECT doc_id, leaf, x.d AS subroot, t.d AS root, coalesce(proof, sha256('')) AS proof_sha256, v AS folded_root, v = t.d AS verified
FROM leaves JOIN (SELECT tree, d FROM nodes WHERE n = 1) x USING (tree) JOIN folded USING (r) LEFT JOIN proofs USING (r) CROSS JOIN (SELECT d FROM tops WHERE n = 1) t
"""
