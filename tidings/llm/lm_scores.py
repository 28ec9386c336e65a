"""Stupid-backoff scores of documents under an n-gram model of the corpus itself.

The model has words and pairs of neighbouring words, with marks before and after every text. A pair that the
corpus holds at least ``MIN_COUNT`` times scores its count over the count of its first word; any
other scores ``ALPHA`` times the share of its second word among all words. A text's score is the sum
of the logarithms.

Everything is a join by hash. Word counts are one table. Texts go out as pairs, dealt by the hash of the first
word, so that a part can count its pairs, find the counts of their first words, and add up what every
text gets from them. Pairs that back off go on to the part of their second word and meet its count
there. Sums come back per batch of texts. Pairs travel as packed arrays, one row per batch and
part; sums too.

Words with more than one in ``MAX_HOT`` of all words are known everywhere (there can be no more than
``MAX_HOT`` of them), and pairs that start with one are dealt by the whole pair instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings.llm.common import LOWER, WordHashes, as_bytes, map_batches, materialize, mixed, odd_numbers, prepare

MIN_COUNT = 2  # a pair that occurs once would only vouch for itself
ALPHA = 0.4  # fixed value of the method
MAX_HOT = 50_000
PART_WORDS = 1_500_000  # words whose pairs are counted in one part
CODE_BITS = 48
BEGIN, END = b" begin", b" end"  # no words, as words have no blanks
FACTOR = odd_numbers(1, 5)[0]


def coded(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Codes of the words of a text between its marks; nothing for a text without words."""
    words = (text or b"").translate(LOWER).split()
    return hashes.of([BEGIN, *words, END]) >> np.uint64(64 - CODE_BITS) if words else np.zeros(0, np.uint64)


def packed(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CODE_BITS // 8].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // CODE_BITS, 8), np.uint8)
    out[:, : CODE_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, CODE_BITS // 8)
    return out.view("<u8").ravel()


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(codes) % np.uint64(parts)).astype(np.int64)


def word_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """Table of ``word`` (code) and ``n``, marks included; both marks are counted once per text."""
    hashes = WordHashes()

    def run(texts):
        codes, n = np.unique(np.concatenate([coded(t, hashes) for t in as_bytes(texts)]), return_counts=True)
        return [codes.view(np.int64), n.astype(np.int64)]

    return map_batches(docs, [F.col(text_column)], run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# a row of the exchanges: the part and the batch of texts it belongs to, what it holds, and arrays as bytes
ARRAYS = ("first", "second", "text", "n", "value", "batches", "sizes")
ROW = "part bigint, batch bigint, kind string, " + ", ".join(f"{x} binary" for x in ARRAYS)


def row(part: int, batch: int, kind: str, ids: list | None = None, **arrays: bytes) -> tuple:
    return (part, batch, kind, *[arrays.get(x) for x in ARRAYS], ids)


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64 if kind[1] != "f" else np.float64)


def sum_rows(batch: np.ndarray, batches: np.ndarray, text: np.ndarray, value: np.ndarray, parts: int) -> list[tuple]:
    """Sums per text as one row per batch; ``batch`` points into ``batches``."""
    place, at = np.unique(batch << 16 | text, return_inverse=True)
    total = np.bincount(at, value, len(place))
    edges = np.searchsorted(place >> 16, np.arange(len(batches) + 1))
    return [
        row(b % parts, b, "sum", text=(place[lo:hi] & 0xFFFF).astype("<u2").tobytes(), value=total[lo:hi].tobytes())
        for b, lo, hi in zip(batches.tolist(), edges[:-1], edges[1:]) if hi > lo
    ]


class Hot:
    """Codes and counts of the frequent words."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = np.append(codes[order], np.uint64(2**64 - 1)), np.append(counts[order], 1)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is frequent, and its count if so."""
        at = np.searchsorted(self.codes, codes)
        return self.codes[at] == codes, self.counts[at]


def pair_rows(docs: DataFrame, id_column: str, text_column: str, hot: Hot, parts: int, schema: T.StructType) -> DataFrame:
    """Distinct pairs of each text with their counts, packed by batch and part, and per batch a row with the ids."""
    hashes, arrow = WordHashes(), to_arrow_schema(schema)

    def run(ids, texts):
        codes = [coded(t, hashes) for t in as_bytes(texts)]
        seen = xxhash.xxh3_64(repr(ids.to_pylist()).encode())
        for c in codes:
            seen.update(c.tobytes())
        batch = seen.intdigest() >> 1
        sizes = np.array([max(0, len(c) - 1) for c in codes])
        rows = [row(batch % parts, batch, "ids", ids.to_pylist(), n=sizes.astype("<u4").tobytes())]
        first, second = np.concatenate([c[:-1] for c in codes]), np.concatenate([c[1:] for c in codes])
        owner = np.repeat(np.arange(len(codes)), sizes)
        order = np.lexsort((mixed(first * FACTOR + second), owner))
        first, second, owner = first[order], second[order], owner[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(first)))
        first, second, owner = first[start], second[start], owner[start]
        part = part_of(np.where(hot.find(first)[0], first * FACTOR + second, first), parts)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
        for lo, hi in zip(edges[:-1], edges[1:]):
            at = order[lo:hi]
            rows.append(row(
                int(part[at[0]]), batch, "pairs", first=packed(first[at]), second=packed(second[at]),
                text=owner[at].astype("<u2").tobytes(), n=n[at].astype("<u4").tobytes(),
            ))
        return [c.combine_chunks() for c in rows_table(rows, arrow).columns]

    texts = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    return map_batches(docs, [F.col(id_column).alias("id"), texts], run, schema)


def scored_parts(pairs: DataFrame, hot: Hot, total: int, parts: int, schema: T.StructType) -> DataFrame:
    """Sums from the pairs that stand, and the second words of the others (kind ``back``), dealt by the word."""
    arrow = to_arrow_schema(schema)

    def run(table):
        kind = np.array(table["kind"].to_pylist())
        rest = table.filter(pa.array(kind != "pairs"))
        mine = table.filter(pa.array(kind == "pairs"))
        if not mine.num_rows:
            return rest
        text = [numbers(x, "<u2") for x in mine["text"].to_pylist()]
        batches, batch = np.unique(np.repeat(mine["batch"].to_numpy(), [len(x) for x in text]), return_inverse=True)
        text = np.concatenate(text)
        first, second = (np.concatenate([unpacked(x) for x in mine[c].to_pylist()]) for c in ("first", "second"))
        n = np.concatenate([numbers(x, "<u4") for x in mine["n"].to_pylist()])
        _, at = np.unique(mixed(first * FACTOR + second), return_inverse=True)
        pair = np.bincount(at, n)[at]
        _, at = np.unique(first, return_inverse=True)
        known, count = hot.find(first)
        context = np.where(known, count, np.bincount(at, n)[at])
        known, count = hot.find(second)
        stands = pair >= MIN_COUNT
        value = n * np.where(stands, np.log(pair / context), np.log(ALPHA * count / total))
        here = stands | known
        rows = sum_rows(batch[here], batches, text[here], value[here], parts)
        back = np.flatnonzero(~here)
        part = part_of(second[back], parts)
        back, part = back[np.lexsort((batch[back], part))], np.sort(part)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        for lo, hi in zip(edges[:-1], edges[1:]):
            at = back[lo:hi]
            held, sizes = np.unique(batch[at], return_counts=True)
            rows.append(row(
                int(part[lo]), 0, "back", second=packed(second[at]), text=text[at].astype("<u2").tobytes(), n=n[at].astype("<u4").tobytes(),
                batches=batches[held].astype("<i8").tobytes(), sizes=sizes.astype("<u4").tobytes(),
            ))
        return pa.concat_tables([rest.cast(arrow), rows_table(rows, arrow)])

    return pairs.groupBy("part").applyInArrow(run, schema)


def backed_off(scored: DataFrame, words: DataFrame, total: int, parts: int, schema: T.StructType) -> DataFrame:
    """Rows of ``scored``, with sums in the place of words that backed off."""
    arrow = to_arrow_schema(schema)
    dealt = map_batches(words, ["word", "n"], lambda word, n: [part_of(word.to_numpy().view(np.uint64), parts), word, n], "part bigint, word bigint, n bigint")

    def run(table, words):
        kind = np.array(table["kind"].to_pylist())
        rest, mine = table.filter(pa.array(kind != "back")), table.filter(pa.array(kind == "back"))
        if not mine.num_rows:
            return rest
        order = np.argsort(words["word"].to_numpy())
        code, count = words["word"].to_numpy()[order].view(np.uint64), words["n"].to_numpy()[order]
        second = np.concatenate([unpacked(x) for x in mine["second"].to_pylist()])
        text = np.concatenate([numbers(x, "<u2") for x in mine["text"].to_pylist()])
        n = np.concatenate([numbers(x, "<u4") for x in mine["n"].to_pylist()])
        owner = np.concatenate([np.repeat(numbers(b, "<i8"), numbers(s, "<u4")) for b, s in zip(mine["batches"].to_pylist(), mine["sizes"].to_pylist())])
        batches, batch = np.unique(owner, return_inverse=True)
        value = n * np.log(ALPHA * count[np.searchsorted(code, second)] / total)
        return pa.concat_tables([rest.cast(arrow), rows_table(sum_rows(batch, batches, text, value, parts), arrow)])

    return scored.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(run, schema)


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_words: int = PART_WORDS, max_hot: int = MAX_HOT) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``score`` (sum of log scores, natural) and ``mean_score`` (per word and end mark).

    Counts cover all of ``docs``, and whole texts are scored. Words are separated by ASCII white space, A-Z in lower
    case. Null and blank texts have no words, score 0 and no mean. Repeated rows count and score
    each. An empty table stays empty. ``docs`` has to read the same rows in the same order each time, as
    files do: batches of its rows are told apart by what they hold.
    """
    prepare(docs.sparkSession)
    words = materialize(word_counts(docs, text_column), "words")
    begin = int(coded(b"x", WordHashes())[0])
    total = words.where(F.col("word") != begin).agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // part_words))
    # fewer than max_hot rows, and the mark before texts
    found = words.where((F.col("n") > total / max_hot) | (F.col("word") == begin)).toArrow()
    hot = Hot(found["word"].to_numpy().view(np.uint64), found["n"].to_numpy())
    kind = docs.schema[id_column].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{ROW}, ids array<{kind}>")
    scored = scored_parts(pair_rows(docs, id_column, text_column, hot, parts, schema), hot, total, parts, schema)
    sums = backed_off(scored, words, total, parts, schema)
    out = T.StructType.fromDDL(f"`{id_column}` {kind}, n_words bigint, score double, mean_score double")
    arrow = to_arrow_schema(out)

    def gather(table):
        kind = table["kind"].to_pylist()
        ids = [i for i, k in enumerate(kind) if k == "ids"]
        n = numbers(table["n"][ids[0]].as_py(), "<u4")
        score = np.zeros(len(n))
        for i, k in enumerate(kind):
            if k == "sum":
                score[numbers(table["text"][i].as_py(), "<u2")] += numbers(table["value"][i].as_py(), "<f8")
        score /= len(ids)  # equal batches have one number and their sums have met
        made = [table["ids"][ids[0]].as_py(), np.maximum(n - 1, 0).tolist(), score.tolist(), [s / k if k else None for s, k in zip(score.tolist(), n.tolist())]]
        return pa.Table.from_arrays([pa.array(x * len(ids), f.type) for x, f in zip(made, arrow)], schema=arrow)

    return sums.groupBy("batch").applyInArrow(gather, out)
