"""Text cleaning, tokens and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import lexicon

WORD = r"([\p{L}\p{N}_]+)"
BREAK = "\u0001"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces become one; ends trimmed."""
    return F.trim(F.regexp_replace(text, " +", " "))


def transliterate(text: Column) -> Column:
    """ASCII form of a text: accents dropped, typographic signs replaced, the rest removed.

    One-to-one forms go through ``translate``, which settles most texts. Only where something
    else is left do the one-to-many replacements run.
    """
    single = lexicon.SINGLE_FORMS
    out = F.translate(text, "".join(single), "".join(single.values()))
    expanded = out
    for sign, form in lexicon.MULTIPLE_FORMS.items():
        expanded = F.replace(expanded, F.lit(sign), F.lit(form))
    other = r"[^\x00-\x7F]"
    return F.when(out.rlike(other), F.regexp_replace(expanded, other, "")).otherwise(out)


def normalize_text(text: Column) -> Column:
    """Null to '', white space to single spaces, ASCII, trimmed, tags stripped."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.regexp_replace(F.trim(transliterate(spaced)), "<.*?>", "")


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def split_punctuation(text: Column) -> Column:
    """Words once every punctuation sign counts as a space."""
    return words(F.regexp_replace(text, r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", " "))


def sentences(text: Column) -> Column:
    """Sentences: a break after ``.``, ``!`` or ``?`` when white space and a capital follow."""
    marked = F.regexp_replace(text, r"([.!?])\s+(\p{Lu})", f"$1{BREAK}$2")
    return F.filter(F.transform(F.split(marked, BREAK), lambda s: F.trim(s)), lambda s: s != "")


def clean_sentences(text: Column) -> Column:
    """Sentences cut again at line ends, in ASCII, trimmed, spaces collapsed, blanks dropped."""
    lines = F.flatten(F.transform(sentences(text), lambda s: F.split(s, "\n")))
    return F.filter(F.transform(lines, lambda s: collapse_spaces(transliterate(s))), lambda s: s != "")


def split_marked_sentences(text: Column, marker: str = "<NEW_SENT>") -> Column:
    """Sentences separated by an explicit marker and nothing else."""
    return F.split(text, r"\Q" + marker + r"\E")


def content_word_count(sentence: Column, stop_words: list[str] | None = None) -> Column:
    """White-space separated words that are not stop words, counted by pattern, without an array."""
    stops = lexicon.STOP_WORDS if stop_words is None else stop_words
    n = F.regexp_count(sentence, F.lit(r"\S+"))
    if not stops:
        return n
    listed = "|".join(rf"\Q{w}\E" for w in stops)
    return n - F.regexp_count(F.lower(sentence), F.lit(rf"(?<!\S)(?:{listed})(?!\S)"))


def acceptable_sentence(sentence: Column, min_words: int = 3, max_words: int = 50, stop_words=None) -> Column:
    """More than ``min_words`` and fewer than ``max_words`` words besides stop words."""
    n = content_word_count(sentence, stop_words)
    return (n > min_words) & (n < max_words)


def readable_sentence(sentence: Column) -> Column:
    """Under 1000 characters, under 10 line ends, more than 4 words per line on average."""
    line_ends = F.length(sentence) - F.length(F.replace(sentence, F.lit("\n"), F.lit("")))
    n_words = F.regexp_count(sentence, F.lit(r"\S+"))
    return (F.length(sentence) < 1000) & (line_ends < 10) & (n_words / (line_ends + 1) > 4)


def prepare_for_resolution(sents: Column, max_words: int | None = None) -> Column:
    """One text out of sentences: joined, ``' .'`` closed up, one line, at most ``max_words`` words if given."""
    text = F.replace(F.replace(F.array_join(sents, " "), F.lit(" ."), F.lit(".")), F.lit("\n"), F.lit(" "))
    found = words(text)
    return F.array_join(found if max_words is None else F.slice(found, 1, max_words), " ")


def count_pieces(text: Column, part: Column) -> Column:
    """Pieces left when ``text`` is cut at every occurrence of ``part``."""
    return F.size(F.split(text, F.concat(F.lit(r"\Q"), part, F.lit(r"\E"))))


def remove_part(text: Column, part: Column) -> Column:
    """Text without the part (a headline, say), trimmed."""
    return F.trim(F.replace(text, F.coalesce(part, F.lit("")), F.lit("")))


def prefixed_lines(text: Column, marker: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.startswith(marker))


def prefixed_value(text: Column, marker: str) -> Column:
    """Value of the one line that starts with the marker; null without one, error with several."""
    found = prefixed_lines(text, marker)
    value = F.trim(F.substring(F.get(found, 0), len(marker) + 1, 2**31 - 1))
    several = F.raise_error(F.lit(f"more than one line starts with {marker!r}")).cast("string")
    return F.when(F.size(found) > 1, several).otherwise(value)


def lines_with_phrase(text: Column, wanted: str, unwanted: str | None = None) -> Column:
    """Lines that hold one phrase and not another."""
    def keep(line: Column) -> Column:
        has = line.contains(wanted)
        return has & ~line.contains(unwanted) if unwanted else has

    return F.filter(F.split(text, "\n"), keep)


def first_token(text: Column) -> Column:
    return F.get(words(text), 0)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def first_sentences(sents: Column, n: int = 5) -> Column:
    return F.slice(sents, 1, n)


def quote_for_viewer(text: Column) -> Column:
    """ASCII, double quotes as two single ones, without paragraph tags."""
    quoted = F.replace(transliterate(text), F.lit('"'), F.lit("''"))
    return F.trim(F.replace(F.replace(quoted, F.lit("<p>"), F.lit("")), F.lit("</p>"), F.lit("")))


def kth_char(text: Column, k: Column) -> Column:
    """k-th character (from 1) of the text without spaces; '' outside."""
    return F.when(k >= 1, F.substring(F.replace(text, F.lit(" "), F.lit("")), k, F.lit(1))).otherwise("")


def string_difference(a: Column, b: Column) -> Column:
    """Characters of ``a`` left after striking out those of ``b`` one for one, first copies first."""
    def strike(rest: Column, char: Column) -> Column:
        at = F.instr(rest, char)
        return F.when(at > 0, F.overlay(rest, F.lit(""), at, F.lit(1))).otherwise(rest)

    return F.aggregate(F.filter(F.split(b, ""), lambda c: c != ""), a, strike)


def doc_position_id(doc: Column, position: Column) -> Column:
    return F.concat_ws(":::", doc.cast("string"), position.cast("string"))


def capitalised_phrases(text: Column) -> Column:
    """Runs of capitalised words, the default stand-in for named entities."""
    phrase = r"((?:\p{Lu}[\p{L}\p{N}&.\-]*\p{L})(?:\s+\p{Lu}[\p{L}\p{N}&.\-]*\p{L})*+)"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(phrase), F.lit(1)))
