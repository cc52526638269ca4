"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Terms of a word (cut at white space) are its letters and digits in lower case, what stands before and after them, and,
if the word before was the same, a term that says so.
Each term has an index vector of a few +1 and -1 whose places come from its hash. The vector of a term seen in the
training sample is the sum of the index vectors of the terms around it there, normalised; of any other term, its
index vector, normalised. A document is the mean over its words of the sum of their terms' vectors. The network (one
hidden layer of tanh units, one logistic output) is trained by full-batch Adam on the labelled sample, less a fifth on
which the temperature of its output is then fitted, so that scores are probabilities.

The sample is bounded: of each label the SAMPLE_ROWS labelled doc_ids with the least hashes at most, and as many of
these, in that order, as have SAMPLE_BYTES of text in all; the vocabulary has the VOCABULARY most frequent terms of the
sample. Scores see nothing but the text.

Defined results: null and empty texts get the score of a document without words; without labelled rows of both
labels every score is the share of label 1 among the labels, or 0.5; rows whose label is null are not learned from, nor is a
doc_id with both labels; of a repeated doc_id the least text is learned from, and every row is scored by its own; equal
texts get equal scores; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, in_arrow, slices, texts_as_bytes
from .language import remainder

DIMENSIONS, NONZERO, HIDDEN, EPOCHS, RATE, DECAY = 48, 4, 16, 400, 0.02, 1e-3
SAMPLE_ROWS, SAMPLE_BYTES, VOCABULARY, REACH, STRETCH = 2500, 64 << 20, 20_000, 2, 100_000
#: Words whose vectors a Python worker remembers.
MEMORY_WORDS = 200_000
THRESHOLD = 0.3
#: The term of a word that repeats the one before it; no word gives it.
AGAIN = b"\x00 again"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")


def terms(word: bytes) -> list[bytes]:
    """At most three: what stands before, from the first to the last letter or digit, what stands after."""
    parts = _TERM.findall(word.lower())
    if len(parts) <= 3:
        return parts
    first = not parts[0][:1].isalnum() and parts[0][0] < 128
    last = not parts[-1][:1].isalnum() and parts[-1][0] < 128
    middle = b"".join(parts[first : len(parts) - last])
    return [*parts[:first], middle, *parts[len(parts) - last :]]


def index_vector(term: bytes) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.float32)
    h = xxhash.xxh3_128_intdigest(term)
    for _ in range(NONZERO):
        h, place = divmod(h, DIMENSIONS)
        h, sign = divmod(h, 2)
        out[place] += 1 - 2 * sign
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def text_terms(text: bytes) -> Iterator[bytes]:
    before = None
    for w in text.split():
        yield from terms(w)
        if w == before:
            yield AGAIN
        before = w


def context_vectors(texts: list[bytes]) -> dict[bytes, np.ndarray]:
    """Random indexing over the sample, STRETCH terms at a time."""
    counts = Counter()
    for text in texts:
        counts.update(text_terms(text))
    names = [t for t, _ in heapq.nsmallest(VOCABULARY, counts.items(), key=lambda x: (-x[1], x[0]))]
    del counts
    number = {t: k for k, t in enumerate(names)}
    none = len(names)
    index = np.array([index_vector(t) for t in names] + [np.zeros(DIMENSIONS)], np.float32)
    flat = array("i", [none] * REACH)
    for text in texts:
        flat.extend([number.get(t, none) for t in text_terms(text)])
        flat.extend([none] * REACH)
    flat = np.frombuffer(flat, np.int32)
    total = np.zeros((none + 1, DIMENSIONS))
    for at in range(REACH, len(flat) - REACH, STRETCH):
        end = min(at + STRETCH, len(flat) - REACH)
        around = sum(index[flat[at + s : end + s]] for s in range(-REACH, REACH + 1) if s)
        for k in range(DIMENSIONS):
            total[:, k] += np.bincount(flat[at:end], around[:, k], none + 1)
    return dict(zip(names, normalised(total[:-1]).astype(np.float32), strict=True))


class Pooler:
    """Document vectors from term vectors; remembers the vectors of words."""

    def __init__(self, vectors: dict[bytes, np.ndarray]) -> None:
        self.vectors, self.number = vectors, {}
        self.again = vectors.get(AGAIN, normalised(index_vector(AGAIN))).astype(np.float64)
        self.table = np.zeros((1024, DIMENSIONS), np.float32)

    def _word(self, word: bytes) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        for t in terms(word):
            found = self.vectors.get(t)
            out += normalised(index_vector(t)) if found is None else found
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        words = [t.split() for t in texts]
        if len(self.number) > MEMORY_WORDS:
            self.number.clear()
        number = self.number
        for w in {w for ws in words for w in ws if w not in number}:
            k = number[w] = len(number)
            if k >= len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[k] = self._word(w)
        out = np.zeros((len(texts), DIMENSIONS), np.float64)
        for k, ws in enumerate(words):
            if ws:
                own = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
                out[k] = self.table[own].mean(0, dtype=np.float64) + (own[1:] == own[:-1]).sum() / len(own) * self.again
        return out


@dataclass
class Model:
    vectors: dict[bytes, np.ndarray]
    prior: float
    layers: tuple[np.ndarray, ...] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def trained(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    random = np.random.default_rng(7)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    p = [random.normal(0, DIMENSIONS**-0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
        back = np.outer(error, p[2]) * (1 - h * h)
        for k, g in enumerate((z.T @ back + DECAY * p[0], back.sum(0), h.T @ error + DECAY * p[2], error.sum(keepdims=True))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return (mean, spread, *p)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float((np.logaddexp(0, z) - y * z).mean())

    low, high, ratio = -3.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fitted(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of labels (doc_id, quality 0 or 1) over documents (doc_id, text)."""
    rows = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    tables, order = Tables(), F.xxhash64("doc_id", F.lit("quality"))
    least = [rows.where(F.col("quality") == q).select("doc_id", "quality", order.alias("order")).orderBy("order", "doc_id").limit(sample_rows) for q in (0, 1)]
    chosen = F.broadcast(least[0].union(least[1]))  # 2 * sample_rows
    sample = tables.stored(documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("quality", "order", "doc_id").agg(F.min("text").alias("text")), "quality-sample")
    sizes = Window.partitionBy("quality").orderBy("order", "doc_id")  # over the sample only
    fitting = sample.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(sizes)).where(F.col("bytes") <= sample_bytes)
    found = fitting.orderBy("doc_id").select("doc_id", "text", "quality").toArrow()  # 2 * sample_rows, 2 * sample_bytes
    tables.release()
    texts, y = texts_as_bytes(found.column("text").combine_chunks()), found.column("quality").to_numpy().astype(np.float64)
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(set(y.tolist())) < 2:
        return Model({}, prior)
    model = Model(context_vectors(texts), prior)
    x = Pooler(model.vectors).pooled(texts)
    kept = np.array([xxhash.xxh3_64_intdigest(str(d)) % 5 > 0 for d in found.column("doc_id").to_pylist()])
    if len(set(y[kept].tolist())) < 2:
        kept[:] = True
    model.layers = trained(x[kept], y[kept])
    rest = ~kept if len(set(y[~kept].tolist())) == 2 else kept
    model.temperature = temperature(model.logits(x[rest]), y[rest])
    # both labels were taken alike, the corpus may hold more of one: its odds go into the last bias
    odds = lambda p: np.log(p / (1 - p))
    *layers, bias = model.layers
    model.layers = (*layers, bias + model.temperature * (odds(prior) - odds(y.mean())))
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # VOCABULARY vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pooler = Pooler(own.vectors)
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(own.scores(pooler.pooled(texts_as_bytes(batch.column("text")))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").transform(in_arrow, run, "doc_id long, score double")


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = fitted(documents, labels.where(~held_out))
    return scored(documents, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
