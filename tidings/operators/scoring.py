"""Batch scoring stages with a pluggable scorer.

A scorer is either a column expression builder (stays in the JVM) or a *factory*: a function
without arguments that loads whatever it needs and returns a function from lists to scores. The
factory runs once per task, before the first batch. The scorers shipped here are simple lexical
rules: deterministic, testable, and a stand-in for a model the caller brings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings import lexicon
from tidings.functions import arrays, text
from tidings.operators.aggregates import passages_by_label
from tidings.plans.shape import hold, unpack
from tidings.plans.skew import whole_list

Scorer = Callable[..., list]
ScorerFactory = Callable[[], Scorer]
SCORED_ROWS = 256


# ---- running a scorer ------------------------------------------------------------------------------
def score_batches(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: T.StructType,
    factory: ScorerFactory,
    partitions: int | None = None,
) -> DataFrame:
    """Add the output columns of a scorer to every row, batch by batch.

    The scorer gets one list per input column and returns one tuple per row. ``partitions``
    spreads the rows first, for scoring that is slow next to moving the rows. At most ``SCORED_ROWS`` rows are scored at once, and
    only the inputs become Python values; the other columns pass as they are.
    """
    inputs = list(inputs)
    made = to_arrow_schema(outputs)
    schema = T.StructType([*df.schema.fields, *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                some = batch.slice(start, SCORED_ROWS)
                scores = scorer(*[some.column(c).to_pandas().tolist() for c in inputs])
                columns = [pa.array([s[i] for s in scores], f.type, from_pandas=True) for i, f in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=schema.names)

    source = df.repartition(partitions) if partitions else df
    return source.mapInArrow(run, schema)


# ---- sentence pairs -----------------------------------------------------------------------------------
PAIR_SCORES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("entailment", "neutral", "contradiction")]
)


def token_features(df: DataFrame, sentence: str, prefix: str) -> DataFrame:
    """Token set (64-bit hashes) and negation flag of a sentence, computed once per sentence and not per pair."""
    held = hold(df, _toks=F.array_distinct(text.tokens(F.col(sentence))))
    negated = F.arrays_overlap("_toks", F.array(*[F.lit(w) for w in lexicon.NEGATIONS]))
    hashed = F.transform("_toks", lambda w: F.xxhash64(w))
    return hold(held, **{f"{prefix}_tokens": hashed, f"{prefix}_negated": negated}).drop("_toks")


def lexical_pair_scores(pairs: DataFrame, a: str = "article", r: str = "press_release") -> DataFrame:
    """Lexical scores of sentence pairs that carry the columns of ``token_features``.

    Entailment is the share of the article sentence's words found in the release sentence;
    contradiction equals it when exactly one side is negated and is 0 otherwise.
    """
    n = F.size(f"{a}_tokens")
    shared = F.size(F.array_intersect(f"{a}_tokens", f"{r}_tokens"))
    entail = F.when(n > 0, shared / n).otherwise(0.0)
    differ = F.col(f"{a}_negated") != F.col(f"{r}_negated")
    return (
        pairs.withColumn("entailment", entail)
        .withColumn("neutral", 1.0 - F.col("entailment"))
        .withColumn("contradiction", F.when(differ, F.col("entailment")).otherwise(0.0))
        .drop(f"{a}_tokens", f"{r}_tokens", f"{a}_negated", f"{r}_negated")
    )


def lexical_pair_scorer() -> Scorer:
    """The same scores as a batch scorer, the model for one's own."""
    import regex

    word = regex.compile(r"[\p{L}\p{N}_]+")
    negations = frozenset(lexicon.NEGATIONS)

    def score(article: list[str], release: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for a, r in zip(article, release, strict=True):
            x, y = set(word.findall(a.lower())), set(word.findall(r.lower()))
            entail = len(x & y) / len(x) if x else 0.0
            differ = bool(x & negations) != bool(y & negations)
            out.append((entail, 1.0 - entail, entail if differ else 0.0))
        return out

    return score


def score_pairs(
    pairs: DataFrame,
    factory: ScorerFactory | None = None,
    a: str = "article_sents",
    r: str = "press_release_sents",
    partitions: int | None = None,
) -> DataFrame:
    """Entailment, neutral and contradiction of every pair; stance is the same with another scorer.

    Without a scorer the lexical scores come from column expressions, and no row goes to Python.
    """
    if factory is not None:
        return score_batches(pairs, [a, r], PAIR_SCORES, factory, partitions)
    spread = pairs.repartition(partitions) if partitions else pairs
    return lexical_pair_scores(token_features(token_features(spread, a, "_a"), r, "_r"), "_a", "_r")


def score_consistency(
    pairs: DataFrame,
    scorer: str = "lexical",
    labels: Sequence[str] | None = None,
    factories: dict[str, ScorerFactory] | None = None,
) -> DataFrame:
    """Article sentence against archive headline: a match score, or a label when labels are given.

    Input columns are doc_idx, article_sentence, article_sent_idx, archive_headline and
    archive_headline_idx; the scorer is chosen by name.
    """
    factory = {"lexical": None, **(factories or {})}[scorer]
    scored = score_pairs(pairs, factory, "article_sentence", "archive_headline")
    scores = F.array("entailment", "neutral", "contradiction")
    prediction = arrays.argmax_label(scores, list(labels)) if labels else F.col("entailment")
    return scored.select(
        "doc_idx", "article_sentence", "article_sent_idx", "archive_headline", "archive_headline_idx",
        prediction.alias("model_prediction"),
    )


# ---- sentences --------------------------------------------------------------------------------------------
def quote_features(sentence: Column) -> dict[str, Column]:
    """Evidence for each quote label, before it is turned into probabilities."""
    lowered = F.lower(sentence)
    speech = F.size(F.array_intersect(text.tokens(sentence), F.array(*[F.lit(v) for v in lexicon.SPEECH_VERBS])))
    return {
        "NO QUOTE": F.lit(1.0),
        "QUOTE": F.when(sentence.contains('"'), 3.0).otherwise(0.0) + speech,
        "STATEMENT": F.when(lowered.contains("statement"), 2.0).otherwise(0.0),
        "PUBLISHED WORK": F.when(lowered.rlike("report|study|survey|filing"), 1.5).otherwise(0.0),
    }


def score_sentences(df: DataFrame, sentence: str = "sentence", features=quote_features) -> DataFrame:
    """Label probabilities (label -> p) and the best label of each sentence row."""
    evidence = features(F.col(sentence))
    labels = list(evidence)
    probs = arrays.softmax(F.array(*[e.cast("double") for e in evidence.values()]))
    return (
        hold(df, _p=probs)
        .withColumn("quote_type_probs", arrays.label_probabilities(F.col("_p"), labels))
        .withColumn("quote_type", arrays.argmax_label(F.col("_p"), labels))
        .drop("_p")
    )


def error_probability(sentence: Column) -> Column:
    """Lexical stand-in for p(sentence is junk): the share of characters that are not letters or spaces."""
    letters = F.length(F.regexp_replace(sentence, r"[^\p{L}\s]", ""))
    return F.when(F.length(sentence) > 0, 1.0 - letters / F.length(sentence)).otherwise(1.0)


def position_class(index: Column, n: Column) -> Column:
    """Lexical stand-in for a discourse class: by place in the document."""
    return (
        F.when(index == 0, "Main").when(index < n * 0.25, "Main_Consequence")
        .when(index < n * 0.5, "Cause_Specific").when(index < n * 0.75, "Cause_General")
        .otherwise("Distant_Evaluation")
    )


def filter_errors(
    docs: DataFrame, sents: str = "sent_lists", words: str | None = None, probability=error_probability,
    limit: float = 0.1, best_class: Callable[[Column, Column], Column] = position_class,
) -> DataFrame:
    """Drop junk sentences by shape, then by p(error); keep the best class; empty documents go.

    Sentences and their word lists stay aligned because they are filtered as structs.
    """
    parts = [F.col(sents).alias("s")] + ([F.col(words).alias("w")] if words else [])
    shaped = F.filter(F.arrays_zip(*parts), lambda x: text.readable_sentence(x["s"]))

    def scored(rows: Column) -> Column:
        return arrays.let(
            F.size(rows),
            lambda n: F.transform(
                rows,
                lambda x, i: F.struct(x.alias("x"), probability(x["s"]).alias("p"), best_class(i, n).alias("c")),
            ),
        )

    kept = hold(docs, _k=F.filter(arrays.let(shaped, scored), lambda y: y["p"] < limit)).where(F.size("_k") > 0)
    columns = {sents: F.col("_k").getField("x").getField("s"), "best_class": F.col("_k").getField("c")}
    if words:
        columns[words] = F.col("_k").getField("x").getField("w")
    return kept.withColumns(columns).drop("_k")


def score_discourse(docs: DataFrame, doc_id: str, sents: str, best_class=position_class) -> DataFrame:
    """One row per sentence with its discourse label; the scorer sees place and document length."""
    rows = unpack(
        docs, [F.col(doc_id).alias("doc_id"), F.size(sents).alias("_n")], F.col(sents), "sentences", "sent_idx"
    )
    return rows.withColumn("discourse_preds", best_class(F.col("sent_idx"), F.col("_n"))).drop("_n")


def marked_sentences_pipeline(marker: str = "<NEW_SENT>"):
    """ML pipeline stage list: documents with marked sentences to (url, sent_idx, sentence, label).

    The explode is a SQL statement as a pipeline stage, so the chain can be saved and reused.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    split = SQLTransformer(statement=f"SELECT url, split(docs, '\\\\Q{marker}\\\\E') AS sents FROM __THIS__")
    explode = SQLTransformer(
        statement="SELECT url, size(sents) AS n, posexplode(sents) AS (sent_idx, sentence) FROM __THIS__"
    )
    classify = SQLTransformer(
        statement=(
            "SELECT url, sent_idx, sentence, CASE WHEN sent_idx = 0 THEN 'Main' "
            "WHEN sent_idx < n * 0.25 THEN 'Main_Consequence' WHEN sent_idx < n * 0.5 THEN 'Cause_Specific' "
            "WHEN sent_idx < n * 0.75 THEN 'Cause_General' ELSE 'Distant_Evaluation' END AS discourse_label FROM __THIS__"
        )
    )
    return Pipeline(stages=[split, explode, classify])


# ---- attribution ----------------------------------------------------------------------------------------------
def attribute_sources(docs: DataFrame, doc_id: str, sents: str) -> DataFrame:
    """Source of each sentence: the capitalised phrase next to a speech verb, cut from the full text.

    The full text starts with the fixed attribution phrase. One row per sentence; no source
    gives ''. Start and end come in either order and are put right before the cut.
    """
    clean = hold(docs.select(doc_id, sents), _s=F.transform(sents, text.normalize_text))
    full = F.concat(F.lit(lexicon.ATTRIBUTION_PREFIX), F.array_join("_s", " "))
    name = r"([A-Z][\w.\-]*(?: [A-Z][\w.\-]*)*)"
    verbs = "|".join(lexicon.SPEECH_VERBS)

    def head(sentence: Column) -> Column:
        before = F.regexp_extract(sentence, rf"{name} (?:{verbs})\b", 1)
        return F.when(before != "", before).otherwise(F.regexp_extract(sentence, rf"\b(?:{verbs}) {name}", 1))

    def attribution(whole: Column, sentence: Column) -> Column:
        start = lambda h: F.position(h, whole) - 1
        return arrays.let(head(sentence), lambda h: F.when(h == "", "").otherwise(arrays.cut_span(whole, start(h), start(h) + F.length(h) - 1)))

    # inside the row of the document, so that its text is never copied to its sentences
    found = arrays.let(full, lambda whole: F.transform("_s", lambda s: F.struct(s.alias("sentence"), attribution(whole, s).alias("attribution"))))
    rows = unpack(hold(clean, _found=found), [doc_id], F.col("_found"), "_f", "sent_idx")
    return rows.select(doc_id, "sent_idx", "_f.sentence", "_f.attribution")


def clean_quotes(docs: DataFrame, doc: str, sents: str = "sents") -> DataFrame:
    """Normalise head and text of every sentence struct and settle its quote type."""
    return docs.withColumn(
        doc,
        F.transform(
            doc,
            lambda s, i: F.struct(
                text.normalize_text(s["head"]).alias("head"),
                text.normalize_text(
                    F.when(i == 0, F.concat(F.lit(lexicon.ATTRIBUTION_PREFIX), s["sent"])).otherwise(s["sent"])
                ).alias("sent"),
                arrays.quote_type(s["quote_type"], text.normalize_text(s["sent"])).alias("quote_type"),
            ),
        ),
    )


def source_spans(docs: DataFrame, doc_id: str, doc: str = "doc", include_unsourced: bool = False) -> DataFrame:
    """(document, source, start, end, sentence): each source located in the text, with its sentences.

    Documents with an ambiguous source are left out. Heads are cut at ``;``; the span is the first
    occurrence, end included; a source the text does not hold is dropped.
    """
    usable = docs.where(~arrays.has_ambiguous_source(F.transform(doc, lambda s: s["head"])))
    cleaned = clean_quotes(usable, doc)
    whole = F.array_join(F.transform(doc, lambda s: s["sent"]), " ")

    def located(whole: Column, s: Column, i: Column) -> Column:
        # surrounding spaces of a head piece do not count when it is located
        piece = lambda head: F.struct(
            head.alias("source"), (F.position(F.trim(head), whole) - 1).alias("start"), F.length(F.trim(head)).alias("size"), i.alias("sent_idx"),
            s["sent"].alias("sentence"), s["quote_type"].alias("quote_type"), F.contains(whole, head).alias("held"),
        )
        heads = F.split(s["head"], ";")
        return F.transform(heads if include_unsourced else F.filter(heads, lambda _: s["head"] != ""), piece)

    # inside the row of the document, so that its text is never copied to its sentences
    found = arrays.let(whole, lambda w: F.flatten(F.transform(doc, lambda s, i: located(w, s, i))))
    rows = unpack(hold(hold(cleaned, **{doc: F.col(doc)}), _found=found), [doc_id], F.col("_found"), "_f")
    return rows.where("_f.held").select(
        doc_id, "_f.source", "_f.start", (F.col("_f.start") + F.col("_f.size") - 1).alias("end"), "_f.sent_idx", "_f.sentence", "_f.quote_type"
    )


# ---- documents -----------------------------------------------------------------------------------------------
def pronoun_resolver() -> Scorer:
    """Replace a sentence-initial pronoun by the last capitalised phrase seen before it."""
    import regex

    name = regex.compile(r"\b\p{Lu}[\p{L}\-]+(?: \p{Lu}[\p{L}\-]+)+")
    initial = regex.compile(rf"^(?:{'|'.join(lexicon.PRONOUNS)})\b")
    cut = regex.compile(r"(?<=[.!?])\s+(?=\p{Lu})")

    def resolve(documents: list[str]) -> list[tuple[list[str]]]:
        out = []
        for document in documents:
            last, resolved = None, []
            for sentence in cut.split(document):
                if last:
                    sentence = initial.sub(last, sentence)
                found = name.findall(sentence)
                last = found[-1] if found else last
                if sentence.strip():
                    resolved.append(sentence.strip())
            out.append((resolved,))
        return out

    return resolve


def resolve_coreference(
    docs: DataFrame, sents: str = "sent_lists", factory: ScorerFactory = pronoun_resolver, max_words: int | None = None
) -> DataFrame:
    """Sentences with mentions replaced, after the text was put together (and cut to ``max_words``, if given)."""
    ready = docs.withColumn("_text", text.prepare_for_resolution(F.col(sents), max_words))
    out = T.StructType([T.StructField("coref_resolved_sents", T.ArrayType(T.StringType()))])
    return score_batches(ready, ["_text"], out, factory).drop("_text")


def extract_entities(
    df: DataFrame, body: str, n_sentences: int | None = None, gazetteer: DataFrame | None = None, row_id: str | None = None,
    name: str = "ents",
) -> DataFrame:
    """Entities of a text, or of its first sentences: capitalised phrases, kept only if listed when a gazetteer is given."""
    found = text.sentences(F.replace(F.col(body), F.lit("\n"), F.lit(" ")))
    head = F.array_join(found if n_sentences is None else text.first_sentences(found, n_sentences), " ")
    found = df.withColumn(name, text.capitalised_phrases(head))
    if gazetteer is None:
        return found
    listed = gazetteer.select(F.col(gazetteer.columns[0]).alias("_e")).distinct()
    hits = found.select(row_id, F.explode(name).alias("_e")).join(listed, "_e", "left_semi")
    lists = hits.groupBy(row_id).agg(F.sort_array(F.collect_list("_e")).alias("_l"))
    return found.join(lists, row_id, "left").withColumn(
        name, F.coalesce("_l", F.array().cast("array<string>"))
    ).drop("_l")


def summarise_groups(
    rows: DataFrame, doc: str, label: str, sentence: str, order: str, first_docs: int | None = None,
    summary: Callable[[Column], Column] = lambda passage: F.get(text.sentences(passage), 0),
) -> DataFrame:
    """One summary per document and discourse label, for all documents or the first by id."""
    if first_docs is not None:
        chosen = rows.select(doc).distinct().orderBy(doc).limit(first_docs)
        rows = rows.join(chosen, doc, "left_semi")
    passages = passages_by_label(rows, doc, label, sentence, order)
    return passages.withColumn("summary", summary(F.col("passage")))


def sentence_documents(df: DataFrame, body: str, keep: Callable[[Column], Column] = text.acceptable_sentence):
    """Accepted sentences of each document and the words of each."""
    with_sents = hold(df, sent_lists=F.filter(text.sentences(F.col(body)), lambda s: keep(s)))
    return hold(with_sents, word_lists=F.transform("sent_lists", text.words))


def sentence_chain(df: DataFrame, body: str, low: int = 1, high: int | None = None, partitions: int | None = None):
    """Length filter, spread, sentences, non-empty, junk filter: the whole preparation as one plan."""
    sized = df.where(F.length(body) >= low if high is None else F.length(body).between(low, high))
    spread = sized.repartition(partitions) if partitions else sized
    return filter_errors(sentence_documents(spread, body).where(F.size("sent_lists") > 0), words="word_lists")


# ---- prompts -----------------------------------------------------------------------------------------------------
def one_line_text(html_or_text: Column) -> Column:
    """Tags and line ends to spaces, ASCII, single spaces."""
    bare = F.regexp_replace(html_or_text, "<[^>]*>", " ")
    return F.regexp_replace(F.replace(text.transliterate(bare), F.lit("\n"), F.lit(" ")), " +", " ")


PROMPT = "Write the news coverage of an announcement, sentence by sentence.\n\n{examples}\n\nAnnouncement: {release}\nCoverage:"
EXAMPLE = "Announcement: {release}\nCoverage: {sentences}"


def _filled(template: str, **parts: Column) -> Column:
    """A template with columns in the place of its ``{names}``."""
    pieces = _pieces(template)
    return F.concat(*[parts[p[1:-1]] if p[:1] == "{" and p[1:-1] in parts else F.lit(p) for p in pieces if p])


def _pieces(template: str) -> list[str]:
    return re.split(r"(\{\w+\})", template)


def example_block(
    examples: DataFrame, order: str, release: str, sentences: str, first: int | None = None, release_chars: int | None = None,
    template: str = EXAMPLE,
) -> DataFrame:
    """Examples in order as one text. A prompt holds a few: hand over those few, or name how many to take.

    With ``release_chars`` the release of an example is cut to that many characters.
    """
    body = one_line_text(F.col(release))
    shown = body if release_chars is None else F.substring(body, 1, release_chars)
    filled = _filled(template, release=F.coalesce(shown, F.lit("")), sentences=F.coalesce(F.col(sentences), F.lit("")))
    ranked = examples.select(F.col(order).alias("o"), filled.alias("e"))
    ranked = ranked if first is None else ranked.orderBy("o", "e").limit(first)
    packed = ranked.agg(whole_list(F.struct("o", "e"), F.octet_length("e").cast("long")).alias("_e"))
    return packed.select(F.array_join(F.col("_e.e"), "\n\n").alias("examples"))


def prompts(
    targets: DataFrame, release: str, block: DataFrame, name: str = "prompt", release_chars: int | None = None, template: str = PROMPT
) -> DataFrame:
    """One few-shot prompt per target release; all share the example block."""
    body = one_line_text(F.col(release))
    shown = body if release_chars is None else F.substring(body, 1, release_chars)
    return targets.withColumn(name, _filled(template, examples=block.select("examples").scalar(), release=F.coalesce(shown, F.lit(""))))
