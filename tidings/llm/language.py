"""Language of a text by averaged hashed subword embeddings under a linear softmax.

Byte n-grams of words (1 to 4 bytes, word edges included) are hashed into buckets; a text is the mean of
its buckets' embeddings, and a softmax over the languages reads that mean. Embeddings and weights
are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(``per_language`` rows of each language, ``max_rows`` in all, chosen by hash). One part of the sample is
not trained on: it sets the temperature that makes the scores probabilities, and what a text needs to be accepted.

A softmax is sure of texts unlike any it has seen, so rejection goes by familiarity: how much likelier the
n-grams of a text are in the learned languages together than if buckets were drawn at random, per n-gram. Texts of
mixed languages are as familiar as those of one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import as_bytes, lists_of, map_batches, prepare, row_key
from tidings.plans.skew import top_rows

BUCKETS = 8_192
WIDTH = 16  # of an embedding
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
FLOOR = 0.1  # share of even chances in the learned frequencies, for buckets that no training row fills
PRIOR = 20  # n-grams of usual familiarity that every text is given: a few letters are no evidence
STRANGE, DOUBTFUL = 0.5, 0.75  # of the familiarity of held-back rows: less is rejected, or rejected if the score is low too
CHUNK = 250  # texts whose bucket counts are held at once
# letters in lower case and bytes beyond ASCII stay, all else is a blank
SUBWORD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
LETTERS_ONLY = bytes(b if chr(b).isalpha() and b < 128 else 32 for b in range(256))


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(text.translate(LETTERS_ONLY).strip()) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, one line per text."""
    joined = SUBWORD_BYTES[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    code, blank = joined.astype(np.uint32), joined == 32
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.append(owner, len(texts) - 1)  # the closing blank
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    gram = np.zeros(len(joined), np.uint32)
    clean = np.ones(len(joined), bool)  # no blank between first and last byte
    for n in ORDERS:
        m = len(joined) - n + 1
        if m <= 0:
            break
        gram = gram[:m] << np.uint32(8) | code[n - 1 :]
        if n > 2:
            clean = clean[:m] & ~blank[n - 2 : n - 2 + m]
        use = clean[:m] & ~(blank[:m] & blank[n - 1 :])
        h = (gram[use] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        total += np.bincount(owner[:m][use] * BUCKETS + (h >> np.uint32(19)), minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


@dataclass
class LanguageModel:
    """``table`` is embeddings times weights, so that a text needs one product."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float  # score that all but ``max_loss`` of right answers have
    known: np.ndarray  # logarithm of how much likelier than at random a bucket is
    usual: float  # familiarity of the rows held back
    least: float  # familiarity that all but ``max_loss`` of them have

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        mean = counts @ self.table / np.maximum(counts.sum(1, keepdims=True), 1)
        return softmax((mean + self.bias) / self.temperature)

    def accepts(self, counts: np.ndarray, score: np.ndarray) -> np.ndarray:
        found = familiarity(counts @ self.known, counts.sum(1), self.usual)
        return (found >= STRANGE * self.least) & ((found >= DOUBTFUL * self.least) | (score >= self.threshold))


def familiarity(total: np.ndarray, n: np.ndarray, usual: float) -> np.ndarray:
    return (total + PRIOR * usual) / (n + PRIOR)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Shares:
    """Bucket shares of rows, kept as the buckets that each row has; dense only for the rows asked for."""

    def __init__(self, places: pa.Array, counts: pa.Array):
        self.ends = places.offsets.to_numpy()
        self.places, values = places.values.to_numpy().astype(np.uint16), counts.values.to_numpy()
        row = np.repeat(np.arange(len(places)), np.diff(self.ends))
        self.sizes = np.bincount(row, values, len(places)).astype(np.float32)
        self.shares = values.astype(np.float32) / np.maximum(self.sizes, 1)[row]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for line, r in zip(out, rows):
            here = slice(self.ends[r], self.ends[r + 1])
            line[self.places[here]] = self.shares[here]
        return out

    def times(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows times ``table``, some rows at a time."""
        return np.concatenate([self[rows[at : at + CHUNK]] @ table for at in range(0, len(rows), CHUNK)])

    def mean(self, rows: np.ndarray) -> np.ndarray:
        return sum(self[rows[at : at + CHUNK]].sum(0) for at in range(0, len(rows), CHUNK)) / len(rows)


def fit(x: Shares, labels: list[str], max_loss: float = 0.002, epochs: int = 25, rate: float = 2.0, seed: int = 1) -> LanguageModel:
    """Train on four fifths of the rows, calibrate on the rest."""
    languages = sorted(set(labels))
    y = np.array([languages.index(label) for label in labels])
    sizes = x.sizes
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(y))
    held = shuffled[: len(y) // 5] if len(y) >= 5 else shuffled
    train = shuffled[len(y) // 5 :]
    embed = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            batch = x[rows]
            mean = batch @ embed
            error = softmax(mean @ weight + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weight.T
            weight -= step * (mean.T @ error)
            bias -= step * error.sum(0)
            embed -= 20 * step * (batch.T @ back)  # an n-gram is a small share of a text
    table = embed @ weight
    logits = x.times(held, table) + bias
    scales = np.geomspace(0.05, 20, 61)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in scales]
    temperature = float(scales[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    threshold = float(np.quantile(right, max_loss, method="lower")) if len(right) else 0.0
    shares = np.mean([x.mean(train[y[train] == i]) for i in np.unique(y[train])], 0)
    known = np.log((shares * BUCKETS + FLOOR) / (1 + FLOOR)).astype(np.float32)
    found = x.times(held, known)
    usual = float(found.mean())
    least = float(np.quantile(familiarity(found * sizes[held], sizes[held], usual), max_loss, method="lower"))
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, threshold, known, usual, least)


def train(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    per_language: int = 500, max_rows: int = 4_000, **how,
) -> LanguageModel | None:
    """A model of the labelled rows of ``docs``; None where no row has a label and a letter.

    Rows of a language are taken by hash. At most ``max_rows`` rows of at most ``BUCKETS`` counts reach the driver.
    """
    prepare(docs.sparkSession)
    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    keys = rows.select(F.col(lang_column).alias("lang"), *row_key(id_column, text_column)).dropDuplicates(["_k1", "_k2", "lang"])
    order = [F.xxhash64("_k1", "_k2", F.lit(11)), "_k1", "_k2"]
    some = top_rows(keys, ["lang"], order, per_language).orderBy("rn", "lang").limit(max_rows).select("lang", "_k1", "_k2")
    # no more than max_rows keys
    texts = rows.select(*row_key(id_column, text_column), F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).join(
        F.broadcast(some), ["_k1", "_k2", "lang"]
    ).dropDuplicates(["_k1", "_k2", "lang"])

    def run(k1, k2, lang, texts):
        counts = [bucket_counts([t])[0] for t in as_bytes(texts)]
        places = [np.flatnonzero(c) for c in counts]
        sizes = [len(p) for p in places]
        return [k1, k2, lang, lists_of(np.concatenate(places).astype(np.int32), sizes), lists_of(np.concatenate([c[p] for c, p in zip(counts, places)]).astype(np.int32), sizes)]

    found = map_batches(texts, ["_k1", "_k2", "lang", "text"], run, "k1 string, k2 bigint, lang string, places array<int>, counts array<int>").toArrow()
    found = found.sort_by([("k1", "ascending"), ("k2", "ascending"), ("lang", "ascending")])
    if not found.num_rows:
        return None
    whole = lambda c: found[c].combine_chunks()
    rows, labels = Shares(whole("places"), whole("counts")), found["lang"].to_pylist()
    del found
    return fit(rows, labels, **how)


def identify(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (probability of that language) and ``accepted``.

    Whole texts count. Null texts and texts without a letter are ``und`` with score 0 and not accepted; so
    is every text if there is no model. Texts that are not familiar enough to the model keep
    their language and are not accepted. Columns of ``docs`` with the names of results are replaced.
    """
    prepare(docs.sparkSession)
    old = docs.drop("lang_pred", "score", "accepted")
    at = old.columns.index(text_column)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in old.schema)

    def run(*columns):
        texts = as_bytes(columns[at])
        name, score, accepted = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
        for start in range(0, len(known), CHUNK):
            rows = known[start : start + CHUNK]
            counts = bucket_counts([texts[i] for i in rows]).astype(np.float32)
            p = model.probabilities(counts)
            for i, best, value, fits in zip(rows, p.argmax(1).tolist(), p.max(1).tolist(), model.accepts(counts, p.max(1)).tolist()):
                name[i], score[i], accepted[i] = model.languages[best], value, fits
        return [*columns, name, score, accepted]

    return map_batches(old, [F.col(f"`{c}`") for c in old.columns], run, f"{kind}, lang_pred string, score double, accepted boolean")


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no model may learn from: a fourth of the ids."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **how) -> DataFrame:
    """``docs`` with ``held_out`` and the results of a model of the rows that are not held out."""
    model = train(docs.where(~held_out(id_column)), id_column, text_column, lang_column, **how)
    return identify(docs, model, text_column).withColumn("held_out", held_out(id_column))
