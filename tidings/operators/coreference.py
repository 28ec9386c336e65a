"""References inside a text, resolved in sieves: the surest rule speaks first, a later one only where none has spoken.

A mention is a run of capitalised words or a pronoun. Names of one spelling are one (exact). A name of at most ``SHORT`` words
is the short form of a longer name of the same document that ends with it (suffix), starts with it (prefix), or has
its letters as initials (acronym). A pronoun stands for the nearest name before it that agrees with it.

No two mentions are paired: every long name emits its few short forms, and names look themselves up among them, so the
work is linear in the words of a text whatever it holds, and nothing is left out. A pointer goes to a name of more words and
only names of at most ``SHORT`` words have one, so ``SHORT`` look-ups end every chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings import lexicon
from tidings.functions import text
from tidings.plans.shape import hold, unpack
from tidings.plans.storage import materialize

SHORT = 3  # words of a short form, at most
# runs of capitalised words, or any other single word; the possessive forms keep a run of any length off the stack
PIECE = r"\p{Lu}[\p{L}\p{N}\-]*+(?: \p{Lu}[\p{L}\p{N}\-]*+)*+|[\p{L}\p{N}\-]++"
SIEVES = ("suffix", "prefix", "acronym", "pronoun")


def sentence_rows(docs: DataFrame, doc: str, body: str) -> DataFrame:
    """(doc, sent_idx, sentence) of whole texts; null and blank texts have no sentences."""
    return unpack(docs, [F.col(doc).alias("doc")], text.sentences(F.col(body)), "sentence", "sent_idx")


def mentions(sentences: DataFrame) -> DataFrame:
    """(doc, sent_idx, at, mention, pronoun): names and pronouns with their place among the pieces of the sentence."""
    pieces = F.regexp_extract_all("sentence", F.lit(PIECE), F.lit(0))
    low = F.lower("mention")
    rows = unpack(sentences, ["doc", "sent_idx"], pieces, "mention", "at")
    pronoun = F.when(low.isin(*lexicon.PRONOUN_NAMES), low)
    return rows.withColumn("pronoun", pronoun).where(F.col("pronoun").isNotNull() | F.rlike("mention", F.lit(r"^\p{Lu}")))


def short_forms(name: Column, short: int = SHORT) -> Column:
    """Array of (form, sieve as a number): endings, beginnings and initials of a name of two words or more."""
    words = F.split(name, " ")
    n = F.size(words)
    item = lambda form, sieve: F.struct(form.alias("form"), F.lit(sieve).alias("sieve"))
    ends = ((0, lambda k: F.slice(words, -k, k)), (1, lambda k: F.slice(words, 1, k)))
    cuts = [F.when(n > k, item(F.array_join(cut(k), " "), sieve)) for k in range(1, short + 1) for sieve, cut in ends]
    initials = F.when(n > 1, item(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 2))
    return F.filter(F.array(*cuts, initials), lambda x: x.isNotNull())


def name_table(found: DataFrame, short: int = SHORT) -> DataFrame:
    """(doc, mention, referent, sieve) of every spelling that is a name: two words or more, or a short form of such."""
    names = found.where("pronoun is null").groupBy("doc", "mention").agg(F.min(F.struct("sent_idx", "at")).alias("first"))
    names = materialize(names.withColumn("n", F.size(F.split("mention", " "))), "names")
    long = names.where("n > 1")
    forms = unpack(long, ["doc", F.col("mention").alias("name"), "n", "first"], short_forms(F.col("mention"), short), "f")
    # surest sieve, then most words, then the first to be mentioned
    best = F.min(F.struct("f.sieve", (-F.col("n")).alias("less"), "first", "name"))
    targets = forms.groupBy("doc", F.col("f.form").alias("form")).agg(best.alias("b")).select("doc", "form", F.col("b.name").alias("target"), F.col("b.sieve").alias("by"))
    targets = materialize(targets.withColumnRenamed("doc", "_d"), "short-forms")

    def looked_up(df: DataFrame, column: str) -> DataFrame:
        return df.join(targets, F.col("doc").eqNullSafe(F.col("_d")) & (F.col(column) == F.col("form")), "left").drop("_d", "form")

    out = looked_up(names, "mention").withColumn("referent", F.coalesce("target", "mention")).withColumnRenamed("by", "sieve").drop("target")
    for _ in range(short - 1):
        out = looked_up(out, "referent").withColumn("referent", F.coalesce("target", "referent")).drop("target", "by")
    return out.where("n > 1 or sieve is not null").select("doc", "mention", "referent", "sieve")


def agreement(name: Column) -> dict[str, Column]:
    """Per pronoun: may it stand for this name? Titles and words for organisations decide, an unmarked name goes with all."""
    words = F.split(name, " ")
    has = lambda listed: F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))
    body, he, she = has(lexicon.ORGANISATION_WORDS), has(lexicon.TITLES["he"]), has(lexicon.TITLES["she"])
    person = he | she | has(lexicon.TITLES["any"])
    return {"he": ~body & ~she, "she": ~body & ~he, "it": ~person, "they": F.lit(True)}


def resolve_mentions(sentences: DataFrame, short: int = SHORT) -> DataFrame:
    """(doc, sent_idx, at, mention, sieve, referent): every mention that a sieve points to another name.

    Full names themselves, pronouns without a name before them and capitalised words that are no name are left
    out. Documents with a null id are one document; repeated ids are read as one text, sentence by sentence.
    """
    found = materialize(mentions(sentences), "mentions")
    table = name_table(found, short)
    table = table.withColumnsRenamed({"doc": "_d", "mention": "_m"})
    same = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("mention") == F.col("_m")) & F.col("pronoun").isNull()
    named = found.join(table, same, "left").drop("_d", "_m")
    so_far = Window.partitionBy("doc").orderBy("sent_idx", "at", "mention").rowsBetween(Window.unboundedPreceding, -1)
    fits = agreement(F.col("referent"))
    nearest = {f"_{p}": F.last(F.when(ok, F.col("referent")), ignorenulls=True).over(so_far) for p, ok in fits.items()}
    chosen = F.coalesce(*[F.when(F.col("pronoun") == p, F.col(f"_{p}")) for p in fits])
    out = named.withColumns(nearest).withColumns({"referent": F.coalesce(chosen, "referent"), "sieve": F.when(F.col("pronoun").isNotNull(), 3).otherwise(F.col("sieve"))})
    name = F.get(F.array(*[F.lit(s) for s in SIEVES]), F.col("sieve"))
    return out.where("sieve is not null and referent is not null").select("doc", "sent_idx", "at", "mention", name.alias("sieve"), "referent")


def resolved_texts(docs: DataFrame, doc: str, body: str, sieves: Sequence[str] = SIEVES, short: int = SHORT) -> DataFrame:
    """(doc, sent_idx, sentence): all sentences of whole texts, mentions found by ``sieves`` replaced by the full name."""
    rows = sentence_rows(docs, doc, body)  # texts are cut twice rather than stored as sentences
    links = resolve_mentions(rows, short).where(F.col("sieve").isin(*sieves))
    # repeated documents repeat their links; a text under an id that others have is told apart by its mentions
    spot = lambda at, mention: F.concat(at.cast("string"), F.lit(":"), mention)
    one = links.groupBy(F.col("doc").alias("_d"), F.col("sent_idx").alias("_s"), spot(F.col("at"), F.col("mention")).alias("k")).agg(F.min("referent").alias("v"))
    found = one.groupBy("_d", "_s").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_new"))
    same = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("sent_idx") == F.col("_s"))
    split = hold(
        rows.join(found, same, "left").drop("_d", "_s"),
        _p=F.regexp_extract_all("sentence", F.lit(PIECE), F.lit(0)), _g=F.split("sentence", PIECE, -1),
    )
    named = lambda i: F.coalesce(F.try_element_at("_new", spot(i, F.get("_p", i))), F.get("_p", i), F.lit(""))
    put = F.array_join(F.transform("_g", lambda g, i: F.concat(g, named(i))), "")
    return split.select("doc", "sent_idx", F.when(F.col("_new").isNull(), F.col("sentence")).otherwise(put).alias("sentence"))
