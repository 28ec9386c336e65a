"""Joins by meaning: lookups, sentence pairs, shared entities, prior coverage, captures.

Plain equi-joins carry no hint: Spark broadcasts a side when its size at run time is under the
session limit and splits skewed partitions otherwise. Joins on entities, where a few keys
always dominate, are salted by measured key counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions import dates, urls
from tidings.plans.asof import DAY, last_before
from tidings.plans.scan import segmented_scan
from tidings.plans.storage import materialize
from tidings.plans.shape import unpack
from tidings.plans.skew import HOT_ROWS, LIST_BYTES, bytes_of, salted_join, top_rows, whole_list


# ---- lookups -----------------------------------------------------------------------------------
def _on(left_on: Sequence[str], right_on: Sequence[str]) -> list[Column]:
    return [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(left_on, right_on, strict=True)]


def join_on(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on differently named keys; the right keys are dropped."""
    joined = left.alias("l").join(right.alias("r"), _on(left_on, right_on), how)
    keep_left = [c for c in left.columns if how != "right" or c not in left_on]
    keep_right = [c for c in right.columns if c not in right_on]
    if how == "right":
        keys = [F.col(f"r.{b}").alias(a) for a, b in zip(left_on, right_on, strict=True)]
        return joined.select(*keys, *[F.col(f"l.{c}") for c in keep_left], *[F.col(f"r.{c}") for c in keep_right])
    return joined.select(*[F.col(f"l.{c}") for c in keep_left], *[F.col(f"r.{c}") for c in keep_right])


def join_entities_to_texts(ents: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Every text with its entities, null where it has none (a right join)."""
    return ents.join(texts, key, "right")


def earliest_capture(captures: DataFrame, url: str = "url", stamp: str = "timestamp") -> DataFrame:
    """Earliest capture per URL; a sentinel text counts as no capture."""
    ts = F.col(stamp) if captures.schema[stamp].dataType.typeName().startswith("timestamp") else dates.parse_date(F.col(stamp))
    return captures.groupBy(url).agg(F.min(ts).alias(stamp))


def attach_capture_times(
    articles: DataFrame,
    captures: DataFrame,
    article_map: DataFrame,
    key: str = "article_url",
    sites: Mapping[str, str] | None = None,
) -> DataFrame:
    """Articles with their capture time and two membership flags from the article map.

    Captures are reduced to the earliest per URL first, so the join cannot multiply articles.
    """
    one = earliest_capture(captures).withColumnRenamed("url", "timestamp_join_key")
    target = article_map.select(F.col("target_article_url").alias(key)).distinct()
    archive = article_map.select(F.col("archival_url").alias(key)).distinct()
    flagged = (
        articles.withColumn("timestamp_join_key", urls.surt_to_url(F.col(key), sites))
        .join(one, "timestamp_join_key", "left")
        .join(target.withColumn("_t", F.lit(True)), key, "left")
        .join(archive.withColumn("_a", F.lit(True)), key, "left")
    )
    return flagged.withColumns(
        {
            "is_press_release_article": F.coalesce("_t", F.lit(False)),
            "is_archival_article": F.coalesce("_a", F.lit(False)),
        }
    ).drop("_t", "_a")


def unknown_crawl_prefixes(articles: DataFrame, key: str = "article_url", sites=None) -> DataFrame:
    """Reject table: articles whose crawl prefix no site is known for."""
    return articles.where(urls.surt_to_url(F.col(key), sites).isNull())


def lookup_values(df: DataFrame, table: DataFrame, column: str, key: str, value: str, name: str) -> DataFrame:
    """Value of a lookup table for a scalar column; null when the key is absent."""
    return df.join(table.select(F.col(key).alias(column), F.col(value).alias(name)), column, "left")


def lookup_list_values(
    df: DataFrame, table: DataFrame, row_id: str, column: str, key: str, value: str, name: str
) -> DataFrame:
    """Value of a lookup table for every element of a list column, in list order."""
    items = unpack(df, [row_id], F.col(column), "_k", "_i")
    found = salted_join(items, table.select(F.col(key).alias("_k"), F.col(value).alias("_v")), ["_k"], "left")
    lists = found.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_s"))
    return df.join(lists.select(row_id, F.transform("_s", lambda s: s["_v"]).alias(name)), row_id, "left")


# ---- filters by another table ---------------------------------------------------------------------
def keep_matching(df: DataFrame, other: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None):
    """Rows whose key exists in the other table, each once."""
    return df.alias("l").join(other.alias("r"), _on(left_on, right_on or left_on), "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None):
    """Rows whose key is absent from the other table (a null key counts as absent)."""
    return df.alias("l").join(other.alias("r"), _on(left_on, right_on or left_on), "left_anti")


def drop_fetched(df: DataFrame, fetched: DataFrame, url: str, fetched_url: str) -> DataFrame:
    """Crawl rows not fetched yet, by what follows the last ``)`` of the clean URL on both sides."""
    seen = fetched.select(urls.clean_crawl_key(F.col(fetched_url)).alias("_key"))
    return df.withColumn("_key", urls.clean_crawl_key(F.col(url))).join(seen, "_key", "left_anti").drop("_key")


def new_on_either_side(
    pairs: DataFrame, seen: DataFrame, a: str = "article_url", b: str = "press_release_url"
) -> DataFrame:
    """Pairs of which at least one side was never seen."""
    seen_a = seen.select(a).distinct().withColumn("_a", F.lit(1))
    seen_b = seen.select(b).distinct().withColumn("_b", F.lit(1))
    return (
        pairs.join(seen_a, a, "left").join(seen_b, b, "left")
        .where(F.col("_a").isNull() | F.col("_b").isNull()).drop("_a", "_b").select(*pairs.columns)
    )


def rows_of_largest_group(df: DataFrame, key: str) -> DataFrame:
    """Rows of the group with the most rows (smallest key on a tie)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.orderBy(F.desc("_n"), key).limit(1).select(key)
    return df.join(F.broadcast(largest), key, "left_semi")  # one row


PAIRS_PER_TASK = 2_000  # mapped document pairs one task should expand


# ---- mapped sentence pairs ---------------------------------------------------------------------------
def join_mapping_twice(mapping: DataFrame, docs: DataFrame, doc_id: str, value: str) -> DataFrame:
    """Mapping rows with the same document table joined as article and as release."""
    as_article = docs.select(F.col(doc_id).alias("article_url"), F.col(value).alias("article_sents"))
    as_release = docs.select(F.col(doc_id).alias("press_release_url"), F.col(value).alias("press_release_sents"))
    return mapping.join(as_article, "article_url").join(as_release, "press_release_url")


def sentence_rows(docs: DataFrame, doc_id: str, sents: Column, prefix: str) -> DataFrame:
    """One row per distinct sentence of a document, at its first position.

    Distinct per document before pairing: duplicates of either side would multiply pairs that
    the pair table drops again.
    """
    return (
        unpack(docs, [F.col(doc_id).alias(f"{prefix}_url")], sents, f"{prefix}_sents", "_i")
        .groupBy(f"{prefix}_url", f"{prefix}_sents")
        .agg(F.min("_i").alias(f"{prefix}_idx"))
    )


def pair_sentences(
    mapping: DataFrame,
    article_sents: DataFrame,
    release_sents: DataFrame,
    hot_rows: int = HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Article sentences next to the release sentences of every mapped document pair.

    Takes sentence rows (see ``sentence_rows``) with whatever further columns they carry. The
    pair of texts is distinct per document pair and keeps the smallest positions. Both joins
    are salted: a document in very many pairs would otherwise land in one task. How many rows
    an article will meet is counted from the mapping, which is read several times: store it
    first if it is expensive.
    """
    # few mapping rows become very many pairs, which Spark cannot tell from their size: keep them spread
    spark = mapping.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, mapping.count() // PAIRS_PER_TASK + 1)
    pairs = mapping.select("article_url", "press_release_url").repartition(n, "article_url", "press_release_url").distinct()
    n_sents = release_sents.groupBy("press_release_url").agg(F.count(F.lit(1)).alias("_n"))
    load = pairs.join(n_sents, "press_release_url").groupBy("article_url").agg(F.sum("_n").alias("_n"))
    busy = load.where(F.col("_n") > hot_rows).select("article_url", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_shares"))
    with_release = salted_join(pairs, release_sents, ["press_release_url"], hot_rows=hot_rows)
    return salted_join(with_release, article_sents, ["article_url"], hot=busy)


def pair_with_candidates(
    article_sents: DataFrame, candidates: DataFrame, on: str = "doc_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Article sentences x candidate headlines, sentences or label passages of the same document.

    A document counts as hot by its pairs, which neither side shows alone.
    """
    count = lambda df, name: df.groupBy(on).agg(F.count(F.lit(1)).alias(name))
    pairs = count(article_sents, "_a").join(count(candidates, "_c"), on).withColumn("_n", F.col("_a") * F.col("_c"))
    busy = pairs.where(F.col("_n") > hot_rows).select(on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_shares"))
    return salted_join(article_sents, candidates, [on], hot=busy)


def join_on_text(a: DataFrame, b: DataFrame, doc: str = "doc_id", text: str = "sentences") -> DataFrame:
    return a.join(b, [doc, text])


# ---- shared entities ------------------------------------------------------------------------------------
def entity_rows(
    docs: DataFrame, doc_id: str, ents: str | Column, excluded: DataFrame | None = None, one_row_per_doc: bool = False
) -> DataFrame:
    """Distinct (doc, ent) rows without nulls and without excluded entities.

    Where each document is a single row, duplicates go inside the row and nothing is shuffled.
    """
    items = F.array_distinct(F.col(ents) if isinstance(ents, str) else ents)
    rows = unpack(docs, [F.col(doc_id).alias("doc")], items, "ent")
    if not one_row_per_doc:
        rows = rows.distinct()
    if excluded is not None:
        rows = rows.join(excluded.select(F.col(excluded.columns[0]).alias("ent")), "ent", "left_anti")
    return rows


def shared_entity_counts(
    targets: DataFrame, archive: DataFrame, hot_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """(target, archive, shared) for document pairs with at least one entity in common.

    Works on the output of ``entity_rows``: an equi-join per entity followed by a partial
    count. Excluding general entities beforehand is part of the method and what keeps the
    pairs few; the archive rows of what is still frequent are spread over salts. ``hot`` is for
    callers that have counted the archive's entities already (ent, _shares).
    """
    t = targets.select("ent", F.col("doc").alias("target"))
    a = archive.select("ent", F.col("doc").alias("archive"))
    return salted_join(a, t, ["ent"], hot_rows=hot_rows, hot=hot).groupBy("target", "archive").agg(
        F.count(F.lit(1)).alias("shared")
    )


def entity_overlap(
    targets: DataFrame, archive: DataFrame, hot_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """Distinct (target, archive) pairs that share an entity."""
    return shared_entity_counts(targets, archive, hot_rows, hot).select("target", "archive")


def entity_cosine(targets: DataFrame, archive: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cosine of binary entity vectors for the pairs that share an entity."""
    n_t = targets.groupBy(F.col("doc").alias("target")).agg(F.count(F.lit(1)).alias("_nt"))
    n_a = archive.groupBy(F.col("doc").alias("archive")).agg(F.count(F.lit(1)).alias("_na"))
    pairs = shared_entity_counts(targets, archive, hot_rows)
    return pairs.join(n_t, "target").join(n_a, "archive").select(
        "target", "archive", (F.col("shared") / F.sqrt(F.col("_nt") * F.col("_na"))).alias("cosine")
    )


def archive_lists(pairs: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """The pairs of ``entity_overlap`` packed as sorted lists per target; one beyond ``list_bytes`` is an error."""
    return pairs.groupBy("target").agg(whole_list(F.col("archive"), bytes_of(pairs, ["archive"]), list_bytes).alias("archive_list"))


def exploded_key_chain(
    seeds: DataFrame, rows: DataFrame, seed_keys: Column, row_keys: Column, row_id: str
) -> DataFrame:
    """Rows that hold any of the keys found in the seed rows.

    Explode the keys of the seeds, make them distinct, find the ids that hold one, and go back
    to the rows: the last two steps are semi-joins, so nothing multiplies or is collected.
    """
    wanted = unpack(seeds, [], seed_keys, "_key").distinct()
    ids = unpack(rows, [row_id], row_keys, "_key").join(wanted, "_key", "left_semi").select(row_id)
    return rows.join(ids, row_id, "left_semi")


# ---- time --------------------------------------------------------------------------------------------------
def prior_coverage(
    articles: DataFrame,
    archive: DataFrame | None = None,
    doc_id: str = "doc_id",
    time: str = "ts",
    key: str = "key",
    days: float = 30,
    newest: int = 20,
) -> DataFrame:
    """For each article the newest earlier documents that share a key.

    ``articles`` and ``archive`` hold one row per (document, key). A candidate is strictly
    earlier, strictly within ``days``, and not the article itself; the newest ``newest`` are
    kept (smaller id first on a tie) with their rank.

    Nothing is paired up: the archive of each key is numbered along its time line, the article takes the number that
    has been reached before its own time, and looks up the ``newest + 1`` documents up to that number. The best of all keys
    are among the best of each key, so the cut is exact.
    """
    archive = articles if archive is None else archive
    k = newest + 1  # one spare for the article itself
    known = F.col(time).isNotNull() & F.col(key).isNotNull()
    at = F.unix_micros(F.col(time).cast("timestamp"))
    facts = archive.where(known).select(F.col(key).alias("_key"), at.alias("_t"), F.col(doc_id).alias("_d"), F.lit(1).alias("_rank")).distinct()
    # a probe comes before what is dated the same, and of one moment the smallest id counts as the newest
    probes = articles.where(known).select(F.col(key).alias("_key"), at.alias("_t"), F.col(doc_id).alias("_d"), F.lit(0).alias("_rank")).distinct()
    line = segmented_scan(facts.unionByName(probes), ["_key"], ["_t", "_rank", F.desc("_d")], total={"_n": F.col("_rank")})
    line = materialize(line, "numbered")
    reached = F.explode(F.sequence(F.greatest(F.lit(1), F.col("_n") - (k - 1)), F.col("_n"))).alias("_n")
    asked = line.where("_rank = 0 AND _n > 0").select("_key", F.col("_d").alias("_doc"), F.col("_t").alias("_at"), reached)
    earlier = line.where("_rank = 1").select("_key", "_n", F.struct((-F.col("_t")).alias("t"), F.col("_d").alias("d")).alias("_e"))
    since = F.col("_at") - F.lit(int(days * DAY * 1_000_000))
    candidates = (
        asked.join(earlier, ["_key", "_n"])
        .where((F.col("_e.d") != F.col("_doc")) & (-F.col("_e.t") > since))
        .select("_doc", "_at", "_e").distinct()
    )
    return top_rows(candidates, ["_doc"], ["_e"], newest, "rank").select(
        F.col("_doc").alias(doc_id), F.col("_e.d").alias("archive_id"), "rank"
    )


def nearest_capture(
    targets: DataFrame,
    captures: DataFrame,
    on: Sequence[str],
    target_time: str,
    capture_time: str,
    payload: str,
    sort_by: str = "past",
    mode: str = "time",
    status: str | None = None,
    name: str = "capture",
) -> DataFrame:
    """Capture nearest to the target time: strictly before, strictly after, or either side.

    Failed captures (status ``-``) do not count. Either side means the smaller time
    difference, the earlier capture on a tie; ``mode='digits'`` compares the differences of
    ``yyyymmddhhmmss`` numbers instead.
    """
    if status is not None:
        captures = captures.where(F.coalesce(F.col(status), F.lit("")) != "-")
    facts = captures.withColumn("_cap", F.struct(F.col(capture_time).alias("t"), F.col(payload).alias("v")))
    look = lambda df, out, **kw: last_before(
        df, facts, on, target_time, capture_time, "_cap", out, **kw
    )
    if sort_by == "past":
        return look(targets, "_hit").withColumn(name, F.col("_hit.v")).drop("_hit")
    if sort_by == "future":
        return look(targets, "_hit", reverse=True).withColumn(name, F.col("_hit.v")).drop("_hit")
    both = look(look(targets, "_past", inclusive=True), "_next", reverse=True)
    measure = dates.capture_stamp if mode == "digits" else (lambda c: F.unix_micros(c.cast("timestamp")))
    at = F.col(target_time)
    back, ahead = measure(at) - measure(F.col("_past.t")), measure(F.col("_next.t")) - measure(at)
    take_past = F.col("_next").isNull() | (F.col("_past").isNotNull() & (back <= ahead))
    return both.withColumn(name, F.when(take_past, F.col("_past.v")).otherwise(F.col("_next.v"))).drop("_past", "_next")


# ---- named joins of one report each --------------------------------------------------------------------------
def bundle_pairs(releases: DataFrame, stories: DataFrame, on: str = "bundle_id") -> DataFrame:
    """Releases x stories of one bundle, with the columns of both sides prefixed."""
    prefix = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns if c != on})
    return salted_join(prefix(stories, "story"), prefix(releases, "release"), [on])


def join_shards(a: DataFrame, b: DataFrame, key: str = "article_url") -> DataFrame:
    """Two families of result shards brought together by row key, each key once."""
    return a.dropDuplicates([key]).join(b.dropDuplicates([key]), key)


def first_last_versions(first: DataFrame, last: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """First and last version of a release side by side."""
    side = lambda df, p: df.select(on, *[F.col(c).alias(f"{p}_version_{c}") for c in columns])
    return side(first, "first").join(side(last, "last"), on)


def join_candidate_times(candidates: DataFrame, times: DataFrame, candidate_id: str, time_id: str) -> DataFrame:
    return join_on(candidates, times, [candidate_id], [time_id])


def paste_columns(a: DataFrame, b: DataFrame, position: str = "position") -> DataFrame:
    """Column-wise paste of two tables by an explicit position column."""
    return a.join(b, position)
