"""Projections, filters and row flags."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.draws import draw
from tidings import lexicon
from tidings.functions import arrays, text, urls
from tidings.plans.shape import hold
from tidings.plans.skew import row_numbers


def select_columns(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    return (df.select(*keep) if keep else df).drop(*drop)


def rename_columns(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    """Rename every column by a rule on its name."""
    return df.withColumnsRenamed({c: rule(c) for c in df.columns})


def value_filter(df: DataFrame, column: str, values: Sequence | DataFrame, keep: bool = True) -> DataFrame:
    """Keep or drop rows by a value list; a list too long for a literal comes as a table."""
    if isinstance(values, DataFrame):
        table = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.join(table, column, "left_semi" if keep else "left_anti")
    match = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.where(match if keep else ~match)


def nonempty(df: DataFrame, column: str, more_than: int = 0) -> DataFrame:
    return df.where(F.coalesce(F.size(column), F.lit(0)) > more_than)


def text_length_between(df: DataFrame, column: str, low: int = 1, high: int | None = None) -> DataFrame:
    """Keep texts of at least ``low`` and, if ``high`` is given, at most ``high`` characters."""
    size = F.length(column)
    return df.where(size >= low if high is None else size.between(low, high))


def release_link(href: Column, shown: Column, blocked: Column) -> Column:
    """Does a link lead to a press release?

    In this order: no if the address is relative, a fragment, a mail or handle link; no if its
    host cannot be parsed; no if its domain is blocked; yes if the shown text has one of four
    phrases; yes if the address has one of eight parts; otherwise no. Case counts.
    """
    any_of = lambda c, parts: reduce(lambda a, b: a | b, [c.contains(p) for p in parts])
    rejected = reduce(lambda a, b: a | b, [href.startswith(p) for p in lexicon.REJECTED_HREF_PREFIXES])
    return (
        F.when(href.isNull() | rejected | urls.url_host(href).isNull() | blocked, False)
        .when(any_of(F.coalesce(shown, F.lit("")), lexicon.RELEASE_LINK_PHRASES), True)
        .otherwise(any_of(href, lexicon.RELEASE_HREF_PARTS))
    )


def is_release_link(href: Column, shown: Column, blocked_domains: Sequence[str] = ()) -> Column:
    """The link rule with a short literal list of blocked domains, for use inside arrays."""
    domain = urls.registered_domain(href)
    blocked = F.coalesce(domain.isin(list(blocked_domains)), F.lit(False)) if blocked_domains else F.lit(False)
    return release_link(href, shown, blocked)


def flag_release_links(links: DataFrame, blocked_domains: DataFrame, name: str = "is_press_release") -> DataFrame:
    """The link rule over a link table, with the blocked domains as a table (first column).

    The outcome that needs no domain is kept out of the join: its null key matches nothing and
    Spark sizes the domain table itself before it decides to broadcast it.
    """
    blocked = blocked_domains.select(F.col(blocked_domains.columns[0]).alias("_domain")).distinct()
    looked_up = links.withColumn("_domain", urls.registered_domain(F.col("href"))).join(
        blocked.withColumn("_blocked", F.lit(True)), "_domain", "left"
    )
    rule = release_link(F.col("href"), F.col("text"), F.coalesce("_blocked", F.lit(False)))
    return looked_up.withColumn(name, rule).drop("_domain", "_blocked")


def drop_blocked_domains(df: DataFrame, url: str, blocked_domains: DataFrame) -> DataFrame:
    """Rows whose registered domain is not in the table."""
    blocked = blocked_domains.select(F.col(blocked_domains.columns[0]).alias("_domain")).distinct()
    return df.withColumn("_domain", urls.registered_domain(F.col(url))).join(blocked, "_domain", "left_anti").drop(
        "_domain"
    )


def articles_with_release_link(
    df: DataFrame, links: str = "links", blocked_domains: Sequence[str] = ()
) -> DataFrame:
    """Articles of which some link passes the link rule."""
    return df.where(
        F.coalesce(F.exists(links, lambda x: is_release_link(x["href"], x["text"], blocked_domains)), F.lit(False))
    )


def code_filter(
    df: DataFrame, codes: Column, exclude: Sequence[str], include: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose codes miss every excluded one and, unless ``include`` is None, hit an included one."""
    listed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    keep = ~arrays.shares_any(codes, listed(exclude))
    if include is not None:
        keep = keep & arrays.shares_any(codes, listed(include))
    return df.where(keep)


def crawl_filter(
    df: DataFrame,
    url: Column,
    status: Column,
    date: Column,
    url_part: str | None = None,
    statuses: Sequence[str] | None = None,
    since: str | None = None,
) -> DataFrame:
    """Crawl rows by URL substring, listed HTTP status, and date string not before a bound."""
    keep = F.lit(True)
    if url_part is not None:
        keep = keep & url.contains(url_part)
    if statuses is not None:
        keep = keep & status.isin([str(s) for s in statuses])
    if since is not None:
        keep = keep & (date >= since)
    return df.where(keep)


def exactly_one(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).cast("int") + F.col(b).cast("int") == 1)


def drop_error_sentences(df: DataFrame, error_probs: str, arrays_to_cut: Sequence[str], limit: float = 0.1) -> DataFrame:
    """Cut parallel sentence arrays where p(error) reaches the limit; documents left empty go."""
    packed = F.filter(
        F.arrays_zip(*[F.col(c) for c in arrays_to_cut], F.col(error_probs).alias("_p")), lambda x: x["_p"] < limit
    )
    kept = hold(df, _kept=packed).where(F.size("_kept") > 0)
    return kept.withColumns({c: F.col("_kept").getField(c) for c in arrays_to_cut}).drop("_kept")


def label_filter(df: DataFrame, column: str, drop: Sequence[str]) -> DataFrame:
    return value_filter(df, column, drop, keep=False)


def language_filter(df: DataFrame, column: str = "lang", language: str | int = "en") -> DataFrame:
    return df.where(F.col(column) == language)


def drop_paths(df: DataFrame, column: str, parts: Sequence[str] = ("/video", "/slideshow")) -> DataFrame:
    return df.where(~reduce(lambda a, b: a | b, [F.col(column).contains(p) for p in parts]))


def contains_any(column: Column, parts: Sequence[str]) -> Column:
    """Case-insensitive substring flag."""
    lowered = F.lower(column)
    return reduce(lambda a, b: a | b, [lowered.contains(p.lower()) for p in parts])


def percent_slice(df: DataFrame, order: Sequence[str], start: float, end: float) -> DataFrame:
    """Rows ``[int(start * n), int(end * n))`` of the table in a total order; slices partition it."""
    numbered = row_numbers(df, order, name="_rn")
    n = df.select(F.count(F.lit(1))).scalar()
    return numbered.where(
        (F.col("_rn") > F.floor(F.lit(start) * n)) & (F.col("_rn") <= F.floor(F.lit(end) * n))
    ).drop("_rn")


def index_slice(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    return row_numbers(df, order, name="_rn").where(F.col("_rn").between(start + 1, end)).drop("_rn")


def seeded_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Random order that is the same in every run."""
    return df.orderBy(draw(seed, key), F.col(key))


def seeded_pick(df: DataFrame, key: str, seed: int = 0, n: int = 1) -> DataFrame:
    return seeded_order(df, key, seed).limit(n)


def nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")


def match_criteria(df: DataFrame, **criteria) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), criteria.items(), df)


def drop_tld(df: DataFrame, column: str, part: str = ".gov") -> DataFrame:
    return df.where(~F.col(column).contains(part))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def flag_above(df: DataFrame, column: str, bound: float, name: str = "is_match") -> DataFrame:
    return df.withColumn(name, F.col(column) > bound)


def documents_sharing(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Documents whose entity array meets a given set."""
    return df.where(arrays.shares_any(F.col(column), F.array(*[F.lit(w) for w in wanted])))


def acceptable_only(df: DataFrame, sents: str, **bounds) -> DataFrame:
    """Keep acceptable sentences of a sentence array."""
    return df.withColumn(sents, F.filter(sents, lambda s: text.acceptable_sentence(s, **bounds)))
