"""Secrets in texts, found through a trigram index, in DataFrame operations only.

From each rule's pattern a Boolean query over trigrams is derived: every clause is an alternative of
strings that a match must contain, each string an AND of its trigrams. Postings of the trigrams that
some query names are intersected relationally, and only the documents that satisfy a query are
searched with its pattern. A pattern without mandatory trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as pattern_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import prepare, row_key, without

MAX_STRINGS = 64  # alternatives followed at once while a query is derived
CHUNK = 256  # matches of a text placed by one fold


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of one of its groups (0: the match); shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values of the task
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# what the method adds
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of clauses, each an OR of strings, each an AND of trigrams; lower case; empty: no mandatory trigram."""
    clauses: list[list[list[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append([sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)])

    def exact(item) -> set[str] | None:
        """All strings that one item matches, if they are few."""
        op, value = str(item[0]), item[1]
        if op == "LITERAL":
            return {chr(value).lower()}
        if op == "SUBPATTERN":
            return whole(value[-1])
        if op == "BRANCH":
            parts = [whole(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if op == "MAX_REPEAT" and value[1] == 1:
            inner = whole(value[2])
            return None if inner is None else inner | ({""} if value[0] == 0 else set())
        return None

    def whole(items) -> set[str] | None:
        strings = {""}
        for item in items:
            part = exact(item)
            if part is None or len(part) * len(strings) > MAX_STRINGS:
                return None
            strings = {a + b for a, b in product(strings, part)}
        return strings

    def walk(items) -> None:
        strings = {""}
        for item in items:
            part = exact(item)
            if part is not None and len(part) * len(strings) <= MAX_STRINGS:
                strings = {a + b for a, b in product(strings, part)}
                continue
            close(strings)
            strings = {""}
            if str(item[0]) == "SUBPATTERN":
                walk(item[1][-1])
            elif str(item[0]) == "MAX_REPEAT" and item[1][0] >= 1:
                walk(item[1][2])
        close(strings)

    walk(pattern_parser.parse(pattern))
    return clauses


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_column: str, keys: list[Column]) -> DataFrame:
    """Documents (by row key) that satisfy the trigram queries, with ``_rules``: the kinds to search for."""
    spark = docs.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    terms = [
        (kind, c, o, len(option), t) for kind, clauses in queries.items() for c, clause in enumerate(clauses) for o, option in enumerate(clause) for t in option
    ]
    needed = spark.createDataFrame([(k, len(c)) for k, c in queries.items() if c], "kind string, clauses int")
    wanted = spark.createDataFrame(terms, "kind string, clause int, option int, size int, trigram string")
    all_trigrams = F.array(*[F.lit(t) for t in sorted({t[-1] for t in terms})])
    # the text is put in lower case once, whatever the number of trigrams
    held = F.flatten(F.transform(F.array(F.lower(F.col(text_column))), lambda low: F.filter(all_trigrams, lambda t: F.contains(low, t))))
    postings = docs.where(F.col(text_column).isNotNull()).select(*keys, F.explode(held).alias("trigram")).distinct()
    options = postings.join(F.broadcast(wanted), "trigram").groupBy("_k1", "_k2", "kind", "clause", "option", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    met = options.groupBy("_k1", "_k2", "kind").agg(F.countDistinct("clause").alias("n")).join(F.broadcast(needed), "kind").where("n = clauses")
    return met.groupBy("_k1", "_k2").agg(F.collect_set("kind").alias("_rules"))


def once(value: Column, use) -> Column:
    """``use`` of an expression that is evaluated one time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def match_spans(text: Column, rule: Rule) -> Column:
    """Start and end (code points) of leftmost non-overlapping matches that are long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.split(text, rule.pattern, -1)
    checked = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # lengths of what stands before a match, of the match, and of the group that has to be long enough
    rows = F.zip_with(F.slice(parts, 1, F.size(found)), F.zip_with(found, checked, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))),
                      lambda p, x: F.struct(F.length(p).alias("p"), x["m"].alias("m"), x["g"].alias("g")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    width = lambda x: x["p"] + x["m"]

    def placed_from(chunk: Column, start: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(start.alias("at"), empty.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + width(x)).alias("at"),
                F.when(x["g"] >= rule.least, F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + width(x)).alias("end")))))
                .otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    def in_chunks(rows: Column) -> Column:
        """A growing array is copied at every step, so it grows over one chunk only; chunks start where the ones before end."""
        cuts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(CHUNK))
        sums = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + width(x)))
        starts = lambda chunks: F.aggregate(
            sums(chunks), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)), lambda acc: F.slice(acc, 1, F.size(acc) - 1)
        )
        return once(F.transform(cuts, lambda at: F.slice(rows, at, CHUNK)), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), placed_from)))

    placed = once(rows, in_chunks)
    return F.when(F.coalesce(F.rlike(text, F.lit(rule.pattern)), F.lit(False)), placed).otherwise(empty)


def joined_spans(columns: dict[str, str]) -> Column:
    """``kind:start:end`` of spans (columns by kind), by start, then kind as listed."""
    def tag(at: int, kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("kind"), x["end"].alias("end"), F.lit(kind).alias("name"))

    tagged = [F.transform(c, tag(at, kind)) for at, (kind, c) in enumerate(columns.items())]
    ordered = F.array_sort(F.concat(*tagged))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one column ``spans_<kind>`` per rule: array of ``start`` and ``end``, code points, end exclusive.

    Null texts are empty; repeated rows get equal spans; an empty table stays empty. Columns of ``docs``
    with the names of results are replaced.
    """
    prepare(docs.sparkSession)
    names = [f"spans_{r.kind}" for r in rules]
    old = without(docs, *names)
    keys = row_key(id_column, text_column)
    indexed = [r for r in rules if trigram_query(r.pattern)]
    keyed = old.select("*", *keys)
    if indexed:
        # documents are the larger side by far: the other one is built into hash tables
        keyed = keyed.join(candidates(old, tuple(indexed), text_column, keys).hint("shuffle_hash"), ["_k1", "_k2"], "left")
    text = F.coalesce(F.col(text_column), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = {
        f"spans_{r.kind}": F.when(F.array_contains("_rules", r.kind), match_spans(text, r)).otherwise(none) if r in indexed else match_spans(text, r) for r in rules
    }
    return keyed.select(*[F.col(f"`{c}`") for c in old.columns], *[c.alias(n) for n, c in spans.items()])
