"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Random indexing gives each word a fixed sparse vector, +1 in one dimension and -1 in another by its hash; a word's
meaning vector is the sum of those of its neighbours, up to ``REACH`` words away, over the whole corpus. Words live in
``BUCKETS`` hashed slots, apart by shape (lower case, capitalised, capitals, digits, marks), so the vectors are a table
of fixed size whatever the corpus: every task sums its own, and Spark adds the tables up.

A document is the mean of its words' vectors, the mean over its distinct words, their spread, and how many and how
varied its words are. The network learns from a bounded sample of labelled documents (``SAMPLE``, those of least hash);
a fifth of the sample is kept apart to set the temperature by which its log odds are divided, so that scores are
calibrated probabilities. Labels, language, source and doc_id are no inputs.

Defined cases: null and empty texts are scored as documents of no words; several labels of a document are averaged, of several
texts under one doc_id the one of least features teaches;
with labels of one class or none every score is their mean (0.5 for none); repeated rows get equal scores; an empty
table gives no rows. ``keep`` returns the columns of docs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import texts

DIMENSIONS, REACH, SAMPLE = 32, 2, 12_000
#: Slots by shape: lower case, capitalised, capitals, digits, marks.
REGIONS = (5120, 1024, 1024, 256, 768)
BUCKETS = sum(REGIONS)
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
FEATURES = 3 * DIMENSIONS + 2
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


class _Slots(dict):
    """Word to slot, remembered for up to 500,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        first = word[:1]
        if first.isdigit():
            shape = 3
        elif not (first.isalpha() or first >= b"\x80"):
            shape = 4
        elif word.isupper() and len(word) > 1:
            shape = 2
        else:
            shape = 1 if first.isupper() else 0
        start = sum(REGIONS[:shape])
        self[word] = slot = start + zlib.crc32(word) % REGIONS[shape]
        return slot


_slots = _Slots()


def slots(text: str) -> np.ndarray:
    found = _TOKEN.findall(text.encode())
    return np.fromiter(map(_slots.__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For every slot the dimensions of its +1 and its -1."""
    draw = np.random.default_rng(11)
    plus = draw.integers(0, DIMENSIONS, BUCKETS)
    return plus, (plus + draw.integers(1, DIMENSIONS, BUCKETS)) % DIMENSIONS


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all slots over all documents, each of length 1. The driver gets one row a slot."""
    columns = [f"d{k}" for k in range(DIMENSIONS)]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS, np.int64)

        def add(words: np.ndarray) -> None:
            for step in range(1, REACH + 1):
                for a, b in ((words[:-step], words[step:]), (words[step:], words[:-step])):
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both] * DIMENSIONS, b[both]
                    total.__iadd__(np.bincount(a + plus[b], minlength=len(total)))
                    total.__isub__(np.bincount(a + minus[b], minlength=len(total)))

        gap = np.full(REACH, -1)  # no neighbours across documents
        waiting, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                words = slots(text.as_py())
                waiting += [words, gap]
                size += len(words)
                if size > 1_000_000:
                    add(np.concatenate(waiting))
                    waiting, size = [], 0
        if waiting:
            add(np.concatenate(waiting))
        table = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(table.any(1))
        yield pa.record_batch([pa.array(used), *(pa.array(table[used, k]) for k in range(DIMENSIONS))], names=["slot", *columns])

    schema = "slot long, " + ", ".join(f"{c} long" for c in columns)
    summed = texts(docs).select("text").mapInArrow(neighbours, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns])
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in summed.collect():
        out[row[0]] = row[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    words = slots(text)
    if not len(words):
        return np.zeros(FEATURES)
    kinds, counts = np.unique(words, return_counts=True)
    v, share = vectors[kinds].astype(np.float64), counts / len(words)
    mean = share @ v
    spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0.0))
    return np.concatenate([mean, v.mean(0), spread, [np.log1p(len(words)), len(kinds) / len(words)]])


class Network:
    """Two layers, tanh between them, trained by Adam; then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.flat = len(y) < 10 or y.min() == y.max()
        if self.flat:
            return
        draw = np.random.default_rng(seed)
        order = draw.permutation(len(y))
        apart, learn = order[: len(y) // 5], order[len(y) // 5 :]
        self.centre, self.scale = x[learn].mean(0), x[learn].std(0) + 1e-3
        self.weights = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(draw.permutation(learn), max(1, len(learn) // 64)):
                step += 1
                for k, g in enumerate(self._gradients(x[part], y[part])):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(apart) and y[apart].min() != y[apart].max():
            odds, sign = self.log_odds(x[apart]), 2 * y[apart] - 1
            grid = np.exp(np.linspace(-np.log(8), np.log(8), 121))
            best = float(min(grid, key=lambda t: np.logaddexp(0, -sign * odds / t).mean()))
            # a sample that the network separates would ask for ever sharper scores, and tells no temperature
            self.temperature = best if best > grid[0] else 1.0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights[0] + self.weights[1])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.weights[2] + self.weights[3]

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        d = (1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3]))) - y) / len(y)
        back = np.outer(d, self.weights[2]) * (1 - h * h)
        return [z.T @ back + DECAY * self.weights[0], back.sum(0), h.T @ d + DECAY * self.weights[2], np.array([d.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and the network learned from at most ``sample`` of the labelled ones."""
    vectors = word_vectors(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("double").alias("quality")).dropna()
    chosen = marks.groupBy("labelled_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t.as_py(), vectors).tolist() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "label"])

    # at most ``sample`` rows are broadcast, and as many come back
    known = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")
    rows = known.mapInArrow(features, "doc_id long, x array<double>, label double").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows]).reshape(len(rows), FEATURES)
    return vectors, Network(x, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], *also: Column) -> DataFrame:
    """doc_id (and whatever else) with the score of every whole text."""
    vectors, network = model
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), *also)
    names = [*rows.columns[1:], "score"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([pooled(t.as_py(), vectors) for t in batch.column(0)]).reshape(len(batch), FEATURES)
            yield pa.record_batch([*batch.columns[1:], pa.array(network.probability(x))], names=names)

    schema = type(rows.schema)(rows.schema.fields[1:]).add("score", "double")
    return rows.mapInArrow(rate, schema)


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that score under ``least``."""
    found = score(docs, fit(docs, labels), F.struct("*").alias("row"))
    return found.filter(F.col("score") >= least).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = fit(docs, labels.filter(~held_out))
    found = score(docs, model, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
