"""Postings of the terms that queries ask for, one narrow row per document.

Texts are read once and stay where they are: a task turns the words of a text into codes of asked terms and their counts, and only these
travel, so that the rows of one document meet. What a search needs of them (document frequencies, best postings, scores) is added up inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidings.functions import text
from tidings.plans.storage import materialize

TEXTS = 1_000  # texts whose words are looked up at once
PRODUCTS = 1 << 20  # weights times gains that a task holds at once
CELLS = 1 << 22  # sums of documents and queries that a task holds at once


def _schema(doc: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType(), False)
    return T.StructType([T.StructField("doc", doc), T.StructField("lens", ints), T.StructField("codes", ints), T.StructField("tfs", ints)])


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Offsets of the rows of a list column in its flat values."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _summed(group: np.ndarray, code: np.ndarray, tf: np.ndarray, n_groups: int, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each group, their counts, and how many codes each group has."""
    key, place = np.unique(group * n_codes + code, return_inverse=True)
    return key % n_codes, np.bincount(place, tf, len(key)).astype(np.int64), np.bincount(key // n_codes, minlength=n_groups)


def _counter(terms: pa.Array, schema: pa.Schema):
    """(doc, words) -> (doc, lens, codes, tfs) of each text; a null text has no length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                words, n = part.column(1), part.num_rows
                code = pc.index_in(words.flatten(), value_set=terms)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), np.diff(_ends(words)))[known]
                codes, tfs, sizes = _summed(row, code.drop_null().to_numpy().astype(np.int64), np.ones(len(row)), n, len(terms))
                there = words.is_valid().to_numpy(zero_copy_only=False)
                lens = _lists(np.diff(_ends(words))[there], there.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lens, _lists(codes, sizes), _lists(tfs, sizes)], schema=schema)

    return run


def _merged(rows: pa.Table, n_codes: int, schema: pa.Schema) -> pa.Table:
    """One row for each run of equal documents."""
    rows = rows.combine_chunks()
    doc, lens, codes, tfs = (rows[c].combine_chunks() if rows.num_rows else pa.array([], schema.field(c).type) for c in schema.names)
    same = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.append(True, same[1:] != same[:-1]) if len(same) else np.zeros(0, bool)
    if first.all():
        return rows
    group = np.cumsum(first) - 1
    n = int(first.sum())
    code, tf, sizes = _summed(np.repeat(group, np.diff(_ends(codes))), _flat(codes).astype(np.int64), _flat(tfs), n, n_codes)
    n_lens = np.bincount(group, np.diff(_ends(lens)), n).astype(np.int64)
    return pa.Table.from_arrays([doc.take(pa.array(np.flatnonzero(first))), _lists(_flat(lens), n_lens), _lists(code, sizes), _lists(tf, sizes)], schema=schema)


def _merger(n_codes: int, schema: pa.Schema):
    """Rows sorted by document -> one row per document, however many batches its rows come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch]).cast(schema)
                rows = _merged(new if held is None else pa.concat_tables([held, new]), n_codes, schema)
                held = rows.slice(rows.num_rows - 1)
                yield from rows.slice(0, rows.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def asked_counts(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, lens, codes, tfs), stored: the lengths of a document's texts and the asked terms in them (places in ``terms``) with their counts.

    Texts of one document count together. Documents without an asked term are there with their lengths; a null document is one document.
    """
    known = pa.array(terms, pa.string())
    words = texts.select("doc", text.tokens(F.col("body")).alias("words"))
    schema = _schema(texts.schema["doc"].dataType)
    arrow = to_arrow_schema(schema)
    counted = words.mapInArrow(_counter(known, arrow), schema)
    return materialize(counted.repartition("doc").sortWithinPartitions("doc").mapInArrow(_merger(len(terms), arrow), schema), "asked-counts")


def mean_length(counts: DataFrame) -> float:
    return counts.select(F.explode("lens").alias("n")).agg(F.avg("n")).first()[0] or 0.0


def _gains(batch: pa.RecordBatch, mean: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of documents, codes, and what each posting adds; the texts of a document add up."""
    ends, codes = _ends(batch.column("codes")), _flat(batch.column("codes")).astype(np.int64)
    tf, lens, len_ends = _flat(batch.column("tfs")).astype(np.float64), _flat(batch.column("lens")), _ends(batch.column("lens"))
    size = np.diff(len_ends)
    gain = lambda tf, n: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * (n / mean)))
    only = np.where(size > 0, lens[np.minimum(len_ends[:-1], max(0, len(lens) - 1))] if len(lens) else 0, 0)
    if not len(codes):
        return ends, codes, tf
    out = gain(tf, np.repeat(only, np.diff(ends)))
    for i in np.flatnonzero(size > 1):
        at = slice(ends[i], ends[i + 1])
        values, n = np.unique(lens[len_ends[i] : len_ends[i + 1]], return_counts=True)
        out[at] = sum(times * gain(tf[at], value) for value, times in zip(values, n))
    return ends, codes, out


def gain_rows(counts: DataFrame, terms: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """(term, doc, gain); ``terms`` has the names of the codes."""
    schema = T.StructType([T.StructField("code", T.LongType()), counts.schema["doc"], T.StructField("gain", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, codes, gain = _gains(batch, mean, k1, b)
            doc = batch.column("doc").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))))
            yield pa.RecordBatch.from_arrays([pa.array(codes), doc, pa.array(gain)], schema=arrow)

    return counts.where("doc is not null").mapInArrow(run, schema).join(terms, "code").select("term", "doc", "gain")


def best_postings(counts: DataFrame, n_codes: int, mean: float, cutoff: int, k1: float, b: float) -> DataFrame:
    """(code, n, doc, gain), stored: of each task the documents that have a term, as a row without a document, and its ``cutoff`` best postings."""
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType()), counts.schema["doc"], T.StructField("gain", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cut, kept = np.zeros(n_codes, np.int64), np.full(n_codes, -np.inf), None
        for batch in batches:
            ends, codes, gain = _gains(batch, mean, k1, b)
            n += np.bincount(codes, minlength=n_codes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            there = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            near = np.flatnonzero((gain > cut[codes]) & there[row])
            code, value, doc = codes[near], gain[near], batch.column("doc").take(pa.array(row[near]))
            if kept is not None:
                code, value, doc = np.append(kept[0], code), np.append(kept[1], value), pa.concat_arrays([kept[2], doc])
            order = np.lexsort((-value, code))
            size = np.bincount(code, minlength=n_codes)
            order = order[np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) < cutoff]
            kept = code[order], value[order], doc.take(pa.array(order))
            size = np.minimum(size, cutoff)
            full = size == cutoff
            cut[full] = kept[1][np.cumsum(size)[full] - 1]
        if kept is not None:
            met = np.flatnonzero(n)
            none = pa.nulls(len(met), arrow.field("doc").type)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), none, pa.nulls(len(met), pa.float64())], schema=arrow)
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(np.zeros(len(kept[0]), np.int64)), kept[2], pa.array(kept[1])], schema=arrow)

    return materialize(counts.mapInArrow(run, schema), "best-postings")


def scores_above(counts: DataFrame, weights: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """(query, doc, score) of the documents that reach what their query wants at least.

    ``weights`` (``query``, ``code``, ``weight``, ``wanted``) travels to the tasks: one row for each term of a query.
    """
    table = weights.toArrow()
    n_codes = (pc.max(table["code"]).as_py() or 0) + 1 if len(table) else 1
    kind = table["query"].combine_chunks().dictionary_encode(null_encoding="encode") if len(table) else pa.array([], table.schema.field("query").type).dictionary_encode()
    ids, asked = kind.dictionary, kind.indices.to_numpy()
    order = np.argsort(table["code"].to_numpy(), kind="stable")
    query, weight = asked[order].astype(np.int64), table["weight"].to_numpy()[order]
    per_code = np.bincount(table["code"].to_numpy(), minlength=n_codes)
    start = np.cumsum(per_code) - per_code
    wanted = np.full(len(ids), -np.inf)
    wanted[asked] = table["wanted"].to_numpy()
    sent = weights.sparkSession.sparkContext.broadcast((ids, query, weight, per_code, start, wanted))
    schema = T.StructType([weights.schema["query"], counts.schema["doc"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query, weight, per_code, start, wanted = sent.value
        if not len(ids):
            return
        for batch in batches:
            ends, codes, gain = _gains(batch, mean, k1, b)
            times = np.where(codes < len(per_code), per_code[np.minimum(codes, len(per_code) - 1)], 0)
            total = np.concatenate([[0], np.cumsum(times)])[ends]
            lo = 0
            while lo < batch.num_rows:
                # at least one document, and no more than fit
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PRODUCTS, "right")) - 1)
                at = slice(ends[lo], ends[hi])
                n = times[at]
                place = np.repeat(start[np.minimum(codes[at], len(per_code) - 1)] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), n)
                key, value = row * len(ids) + query[place], np.repeat(gain[at], n) * weight[place]
                if (hi - lo) * len(ids) <= CELLS:
                    sums = np.bincount(key, value, (hi - lo) * len(ids))
                    cell = np.flatnonzero(sums)
                    sums = sums[cell]
                else:
                    cell, back = np.unique(key, return_inverse=True)
                    sums = np.bincount(back, value, len(cell))
                enough = sums >= wanted[cell % len(ids)]
                cell, sums = cell[enough], sums[enough]
                if len(cell):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cell % len(ids))), batch.column("doc").take(pa.array(cell // len(ids) + lo)), pa.array(sums)], schema=arrow)
                lo = hi

    return counts.where("doc is not null").mapInArrow(run, schema)
