"""URL rules: a blocked Bloom filter in front of an exact join.

A rule is a canonical URL without a scheme: a host and the beginning of a path. A URL can meet a rule only as
one of its own beginnings: a domain suffix of its host with a beginning of its path, cut to a
length that some rule has. These go through a Bloom filter whose bits for one key lie in one block
of 512; what passes is joined with the rules, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import prepare
from tidings.plans.skew import salted_join

MAX_BLOCKS = 1 << 18  # 16 MB of bits; with more rules the filter lets more pass, and the join stays exact
KEYS_PER_BLOCK = 32  # 16 bits for a key
MAX_BROADCAST_RULES = 100_000  # rules that are sent to every task; more are joined by a shuffle
PROBES = 7  # bits of a key
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(urls: DataFrame, column: str) -> DataFrame:
    """``host`` and ``path`` of a URL; both empty where there is no ``://``."""
    url, shape = F.coalesce(F.col(column), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return urls.withColumn("host", F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, shape, 2))


def _bits(key: str) -> list[str]:
    return [f"shiftright(xxhash64({key}, 1), {9 * i}) & 511" for i in range(PROBES)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as at most ``blocks`` rows: ``block`` and its eight ``words``."""
    marks = keys.select(F.expr(f"pmod(xxhash64(key), {blocks})").alias("block"), F.explode(F.array(*[F.expr(b) for b in _bits("key")])).alias("bit"))
    words = marks.groupBy("block", F.expr("shiftright(bit, 6)").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("mask"))
    masks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    return masks.select("block", F.expr("transform(sequence(0, 7), w -> coalesce(m[w], 0L))").alias("words"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains if the path starts with the
    rule's; the longest wins (then the longer host, then the later text; of equal rules the later
    verdict, so ``block`` beats ``allow``). URLs that no rule fits get ``default``: only listed ones
    are blocked. Null URLs and URLs without ``://`` have an empty host and path. Repeated rows are judged
    alike. Columns of ``pages`` with the names of results are replaced. All columns of ``pages`` go
    through one shuffle: hand over those that are needed.
    """
    prepare(pages.sparkSession)
    old = pages.drop("host", "path", "rule", "verdict")
    listed = rules.select(
        F.coalesce("host", F.lit("")).alias("rule_host"), F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"),
        F.length(F.coalesce("path", F.lit(""))).alias("size"), "verdict",
    ).groupBy("key", "rule_host", "size").agg(F.max("verdict").alias("verdict"))
    n_rules = listed.count()
    lengths = [r["size"] for r in listed.select("size").distinct().orderBy("size").toLocalIterator()]
    blocks = min(MAX_BLOCKS, -(-n_rules // KEYS_PER_BLOCK) or 1)

    urls = url_parts(old.select(F.col(url_column).alias("url")).where(F.col("url").isNotNull()).distinct(), "url")
    labels = F.split("host", r"\.")
    suffixes = urls.select("url", "path", labels.alias("l")).select(
        "url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))).alias("suffix")
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    beginnings = suffixes.select("url", "path", "suffix", F.explode(fitting).alias("n")).select(
        "url", F.expr("concat(suffix, substring(path, 1, n))").alias("key"), F.col("suffix").alias("rule_host")
    )
    # at most MAX_BLOCKS rows of 72 bytes
    filtered = beginnings.withColumn("block", F.expr(f"pmod(xxhash64(key), {blocks})")).join(F.broadcast(bloom_blocks(listed, blocks)), "block").where(
        " AND ".join(f"(shiftright(words[CAST(shiftright({b}, 6) AS INT)], CAST(({b}) & 63 AS INT)) & 1) = 1" for b in _bits("key"))
    ).select("url", "key", "rule_host")
    on = ["key", "rule_host"]
    exact = filtered.join(F.broadcast(listed), on) if n_rules <= MAX_BROADCAST_RULES else salted_join(filtered, listed, on)
    best = exact.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), F.length("rule_host").alias("m"), "key", "verdict")).alias("best"))
    hits = best.select(F.col("url").alias(url_column), F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict"))
    judged = salted_join(old, hits, [url_column], "left")
    return url_parts(judged, url_column).select(
        *[F.col(f"`{c}`") for c in old.columns], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
