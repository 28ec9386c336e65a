"""Arrays, probability vectors and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import lexicon


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def map_values(value: Column, table: dict) -> Column:
    """Replace by a table; values outside it stay."""
    return F.coalesce(F.try_element_at(_map(table), value), value)


def map_values_or_null(value: Column, table: dict) -> Column:
    return F.try_element_at(_map(table), value)


def clean_entities(ents: Column) -> Column:
    """Lower-case trimmed elements; null array becomes empty."""
    return F.transform(F.coalesce(ents, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))


def remove_excluded(ents: Column, excluded: Column) -> Column:
    """Set difference, nulls dropped."""
    return F.array_except(F.array_compact(ents), excluded)


def shares_any(a: Column, b: Column) -> Column:
    """True when two arrays have a non-null element in common; never null."""
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def struct_field(items: Column, field: str) -> Column:
    """One field of every element; null array becomes empty."""
    return F.coalesce(F.transform(items, lambda x: x[field]), F.array().cast("array<string>"))


def filter_parallel(keep, **columns: Column) -> Column:
    """Filter parallel arrays together; result is one array of structs."""
    return F.filter(F.arrays_zip(*[c.alias(n) for n, c in columns.items()]), keep)


def contains_all(labels: Column, wanted: list[str]) -> Column:
    out = F.lit(True)
    for label in wanted:
        out = out & F.array_contains(labels, label)
    return out


def repeated_elements(items: Column) -> Column:
    """Distinct elements that occur more than once, sorted."""
    ordered = F.sort_array(items)
    n = F.greatest(F.size(items) - 1, F.lit(0))
    neighbours = F.arrays_zip(F.slice(ordered, 1, n).alias("a"), F.slice(ordered, 2, n).alias("b"))
    return F.array_distinct(F.filter(neighbours, lambda p: p["a"] == p["b"]).getField("a"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, for values that a lambda looks at per element."""
    return F.get(F.transform(F.array(value), use), 0)


def softmax(logits: Column) -> Column:
    def powers(top: Column) -> Column:
        return F.transform(logits, lambda x: F.exp((x - top).cast("double")))

    def normalised(p: Column) -> Column:
        return let(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(p, lambda x: x / total))

    return let(let(F.array_max(logits), powers), normalised)


def argmax_index(values: Column) -> Column:
    """Position (from 0) of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_label(probs: Column, labels: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), argmax_index(probs))


def label_probabilities(probs: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probs)


def decay_weights(n: Column, position: Column, window: int, decay: float = 0.5) -> Column:
    """n weights: decay to the power of the distance to a position, 0 beyond the window."""
    def weight(i: Column) -> Column:
        gap = F.abs(i - position)
        return F.when(gap <= window, F.pow(F.lit(decay), gap)).otherwise(0.0)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), weight)).otherwise(F.array().cast("array<double>"))


def cut_span(text: Column, start: Column, end: Column) -> Column:
    """Text between two positions (from 0, both included) given in either order."""
    low, high = F.least(start, end), F.greatest(start, end)
    return F.substring(text, low + 1, high - low + 1)


def join_authors(authors: Column) -> Column:
    return F.array_join(authors, "; ")


def sort_by_priority(items: Column, label_field: str, priority: dict[str, int]) -> Column:
    """Struct elements in the order of a label priority table; equal labels keep their order."""
    keyed = F.transform(
        items,
        lambda x, i: F.struct(
            F.coalesce(map_values_or_null(x[label_field], priority), F.lit(2**31 - 1)).alias("p"),
            i.alias("i"), x.alias("x"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def discourse_id(label: Column) -> Column:
    return map_values_or_null(label, lexicon.DISCOURSE_IDS)


def quote_type(raw: Column, sentence: Column, swap_quotes: bool = False) -> Column:
    """Quote type after the fixed table; a plain quote is told apart by a double quote in it.

    By default a sentence *with* a double quote counts as indirect; ``swap_quotes`` turns that.
    """
    kind = map_values(F.coalesce(raw, F.lit("")), lexicon.QUOTE_TYPES)
    quoted, plain = ("DIRECT QUOTE", "INDIRECT QUOTE") if swap_quotes else ("INDIRECT QUOTE", "DIRECT QUOTE")
    return F.when(kind == "QUOTE", F.when(sentence.contains('"'), quoted).otherwise(plain)).otherwise(kind)


def has_ambiguous_source(heads: Column) -> Column:
    """Some source head looks like ``name-1``."""
    return F.coalesce(F.exists(F.array_compact(heads), lambda h: h.rlike(r"-\d")), F.lit(False))


def two_flag_type(release: Column, archive: Column) -> Column:
    a, b = F.coalesce(release.cast("int"), F.lit(0)) == 1, F.coalesce(archive.cast("int"), F.lit(0)) == 1
    return F.when(a & b, "Both").when(a, "Press Release").when(b, "Archive").otherwise("Unmatched")
