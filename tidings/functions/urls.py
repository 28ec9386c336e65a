"""URLs, crawl-index lines and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import lexicon


def clean_url(url: Column) -> Column:
    """URL without query and fragment."""
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def clean_crawl_key(url: Column) -> Column:
    """Clean URL, then only what follows the last closing parenthesis."""
    return F.trim(F.substring_index(clean_url(url), ")", -1))


def strip_url(url: Column) -> Column:
    """Part before the first ``?`` and after the last ``)``, trimmed."""
    return F.trim(F.substring_index(F.substring_index(url, "?", 1), ")", -1))


def surt_to_url(key: Column, sites: dict[str, str] | None = None) -> Column:
    """Web address of a crawl key such as ``com,site)/path``; null for an unknown prefix."""
    table = F.create_map(*[F.lit(x) for kv in (sites or lexicon.SURT_SITES).items() for x in kv])
    return F.concat(F.try_element_at(table, F.substring_index(key, ")", 1)), F.substring_index(key, ")", -1))


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; '' without one, null when it cannot be parsed."""
    netloc = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(netloc.contains("[") != netloc.contains("]"), F.lit(None)).otherwise(host)


def domain_of_host(host: Column, two_part_suffixes: list[str] | None = None) -> Column:
    """Registered domain label: ``help.site.co.uk`` gives ``site``."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    tail = F.array_join(F.slice(parts, -2, 2), ".")
    at = F.when(
        (n >= 3) & tail.isin(two_part_suffixes or lexicon.TWO_PART_SUFFIXES), F.element_at(parts, -3)
    ).when(n >= 2, F.element_at(parts, -2))
    return F.when((n == 1) | host.rlike(r"^[0-9.]+$"), host).otherwise(at)


def registered_domain(url: Column, two_part_suffixes: list[str] | None = None) -> Column:
    return domain_of_host(url_host(url), two_part_suffixes)


def crawl_json_text(line: Column) -> Column:
    """Text of the last ``{...}`` of a crawl line, from its last opening brace; null if none."""
    bodies = F.regexp_extract_all(line, F.lit(r"(\{.*?\})"), F.lit(1))
    last = F.when(F.size(bodies) > 0, F.element_at(bodies, -1))
    return F.concat(F.lit("{"), F.substring_index(last, "{", -1))


def crawl_packet(line: Column, schema: str = "url string, status string") -> Column:
    """Parsed JSON body of a crawl line; all fields null when it does not parse."""
    return F.from_json(crawl_json_text(line), schema)


def crawl_date(line: Column) -> Column:
    """First all-digit token of the line, where the line has a body."""
    token = F.regexp_extract(line, r"(?:^|\s)([0-9]+)(?=\s|$)", 1)
    return F.when(crawl_json_text(line).isNotNull() & (token != ""), token)


def crawl_key_parts(line: Column) -> Column:
    """Tokens of the line once the JSON body is taken out."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(line, r"\{.*?\}", ""), r"\s+", " "))
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, " "))


def capture_url(stamp: Column, url: Column, prefix: str = "https://web.archive.org/web/") -> Column:
    """Address of a stored capture."""
    return F.concat(F.lit(prefix), stamp.cast("string"), F.lit("/"), clean_url(url))


def path_part(path: Column, n: int) -> Column:
    """The n-th piece (from 0) between slashes; null beyond the end."""
    return F.get(F.split(path, "/"), n)


def split_key(path: Column) -> Column:
    """``split/dir/file`` key of an annotation file path, without its extension."""
    parts = F.split(F.regexp_replace(path, r"\.(?:ann|txt)$", ""), "/")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return (
        F.when(F.array_contains(parts, "test"), F.concat_ws("/", F.lit("test"), before, last))
        .when(F.array_contains(parts, "train"), F.concat_ws("/", F.lit("train"), before, last))
        .when(F.array_contains(parts, "validation"), F.concat_ws("/", F.lit("validation"), last))
    )


def outlet_from_filename(path: Column) -> Column:
    """Outlet name in front of ``-articles`` (or the first ``-``) of a file name."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("-articles"), F.substring_index(name, "-articles", 1)).otherwise(
        F.substring_index(name, "-", 1)
    )


def number_tokens(text: Column) -> Column:
    """All digit runs of a string, in order, as strings."""
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))


def number_suffix(text: Column) -> Column:
    """Number in front of the extension of names such as ``part-12.csv``."""
    return F.regexp_extract(text, r"-(\d+)\.\w+", 1).try_cast("int")


def strip_prefix_int(text: Column, prefix: str) -> Column:
    return F.replace(text, F.lit(prefix), F.lit("")).try_cast("int")
