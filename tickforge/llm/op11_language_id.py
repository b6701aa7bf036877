"""Language identification by language-bitmask n-gram filters.

An n-gram of letters (1 to ``ORDERS`` of them, words in lower case with a blank at either end) belongs to a language at level j if it
makes up at least 1 / 2^(``FINEST`` - 2j) of all n-grams of its order in that language's documents. Levels are a factor of 4 apart, so the number of levels that hold
an n-gram is the logarithm of its frequency. As shares of an order sum to one, a level can't hold more than
2^``FINEST`` n-grams of an order, whatever the corpus: that bounds the filters, without a cap on what is counted.

Each language and level has a Bloom filter, and all of them share their slots and hashes: the filters are bit-sliced, a
slot holds a byte a language with a bit a level. The bytes of an n-gram's ``PROBES`` slots, and-ed, give all languages and levels
that contain it in one look-up. A document's n-grams are counted up by language (popcounts), each bit corrected by its filter's rate of false
positives: (bit - rate) / (1 - rate), which in the mean is what is really held. The language with the most decides; the score is its share of
the evidence, with a factor of 4 a level and a weight of one order (n-grams of different orders say the same thing of a word).

Counts are over all training documents. Tasks count words first, then the n-grams of distinct words, so that a common word is taken apart once a task
and few rows are shuffled. Workers remember what a word adds to each language.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0. Runs of over ``RUN`` letters are cut. With no training
document every text is ``und``. Text none of whose n-grams is known gets the first language, at an even score. Of more than ``LANGUAGES``
values of lang those with the most n-grams are learned. An empty lang is a value. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

ORDERS, FINEST, LEVELS, PROBES = 4, 17, 8, 3
#: Slots for each n-gram of the largest filter (rounded up to a power of two), and their least number.
ROOM, LEAST_SLOTS = 8, 1 << 14
RUN, LANGUAGES = 40, 64
#: Distinct words that a task holds before it sends their n-grams on, or a worker remembers.
HELD = 200_000
NONE = "und"
_WORDS = re.compile(r"[^\W\d_]{1,%d}" % RUN)
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return bool(words) and (words[0].isalpha() or any(c.isalpha() for w in words for c in w))


def ngrams(words: Iterable[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of these words, and the number of the word each is of."""
    words = list(words)
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # surrogates aside, a code point is a code: lengths are known
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    n = np.maximum(lengths - order + 1, 0)
    of = np.repeat(np.arange(len(words)), n)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.zeros(0, np.int64)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[of]
    if order == 1:
        letters = codes[at] != 32
        at, of = at[letters], of[letters]
    hashes = np.full(len(at), order, np.uint64)
    for k in range(order):
        hashes = (hashes ^ codes[at + k]) * _FACTOR
        hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    return hashes ^ (hashes >> np.uint64(32)), of


def counted(docs: DataFrame) -> DataFrame:
    """lang, n, gram (a hash), count over all texts of docs with a lang; stored."""

    def expand(lang: str, held: Counter) -> pa.RecordBatch:
        words, weights = list(held), np.fromiter(held.values(), np.int64, len(held))
        orders, grams, counts = [], [], []
        for n in range(1, ORDERS + 1):
            hashes, of = ngrams(words, n)
            kinds, which = np.unique(hashes, return_inverse=True)
            orders.append(np.full(len(kinds), n, np.int32))
            grams.append(kinds.view(np.int64))
            counts.append(np.bincount(which, weights[of], len(kinds)).astype(np.int64))
        rows = [pa.array(np.concatenate(c)) for c in (orders, grams, counts)]
        return pa.record_batch([pa.array([lang] * len(rows[0])), *rows], names=["lang", "n", "gram", "count"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                held[lang.as_py()].update(words_of(text.as_py()))
                if sum(map(len, held.values())) > HELD:
                    yield from (expand(k, c) for k, c in held.items() if c)
                    held.clear()
        yield from (expand(k, c) for k, c in held.items() if c)

    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    return stored(rows.mapInArrow(count, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "grams")


class Filters(NamedTuple):
    """``slices`` has a row a slot, a byte a language, a bit a level; ``worth`` is what a byte adds to each language."""

    languages: list[str]
    slices: np.ndarray
    worth: np.ndarray

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """A byte a language for each n-gram: the levels that contain it, or seem to."""
        step, mask = hashes >> np.uint64(32) | np.uint64(1), np.uint64(len(self.slices) - 1)
        bits = self.slices[hashes & mask]
        for k in range(1, PROBES):
            bits = bits & self.slices[hashes + np.uint64(k) * step & mask]
        return bits

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row a word, a column a language: corrected popcounts of the word's n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        for n in range(1, ORDERS + 1):
            hashes, of = ngrams(words, n)
            bits = self.found(hashes)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(of, self.worth[k][bits[:, k]], len(words))
        return out


def build(languages: list[str], of: np.ndarray, grams: np.ndarray, levels: np.ndarray) -> Filters:
    """Filters of n-grams (hashes), each with its language's number and the number of levels it is in."""
    most = int(np.bincount(of, minlength=1).max(initial=0))
    slots = max(LEAST_SLOTS, 1 << (ROOM * most - 1).bit_length() if most else 0)
    slices = np.zeros((slots, len(languages)), np.uint8)
    step, mask = grams >> np.uint64(32) | np.uint64(1), np.uint64(slots - 1)
    held = ((1 << levels.astype(np.int64)) - 1).astype(np.uint8)
    for k in range(PROBES):
        np.bitwise_or.at(slices, ((grams + np.uint64(k) * step & mask).astype(np.int64), of), held)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
    rates = np.array([[(slices[:, k] >> j & 1).mean() ** PROBES for j in range(LEVELS)] for k in range(len(languages))]).reshape(-1, LEVELS)
    worth = ((bits[None] - rates[:, None]) / (1 - rates[:, None])).sum(2)
    return Filters(languages, slices, worth)


def fit(docs: DataFrame) -> Filters:
    """Filters learned from text and lang of all docs that have a lang.

    The driver gets the n-grams that reach the finest level: 2^FINEST a language and order at most.
    """
    counts = counted(docs)
    sums = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    chosen = sums.groupBy("lang").agg(F.sum("total").alias("t")).orderBy(F.desc("t"), "lang").limit(LANGUAGES)
    languages = sorted(r[0] for r in chosen.select("lang").collect())
    known = sums.filter(F.col("lang").isin(languages))
    reached = [F.when(F.col("count") * F.lit(1 << FINEST - 2 * j) >= F.col("total"), 1).otherwise(0) for j in range(LEVELS)]
    level = sum(reached[1:], reached[0]).alias("level")
    # totals: a row for each of at most LANGUAGES languages and ORDERS orders
    rows = counts.join(F.broadcast(known), ["lang", "n"]).select("lang", "gram", level).filter("level > 0").toArrow()
    number = {x: k for k, x in enumerate(languages)}
    of = np.array([number[x] for x in rows.column(0).to_pylist()], np.int64)
    return build(languages, of, rows.column(1).to_numpy().view(np.uint64), rows.column(2).to_numpy())


class _Remembered(dict):
    """Word to its number; words met for the first time wait in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def predict(docs: DataFrame, filters: Filters, *also: Column) -> DataFrame:
    """Whatever else is asked for, with lang_pred and score of every whole text."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), *also)
    names = [*rows.columns[1:], "lang_pred", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        n, seen, evidence = len(f.languages), _Remembered(), np.zeros((0, len(f.languages)))
        for batch in batches:
            total, lettered, waiting, held = np.zeros((len(batch), n)), np.zeros(len(batch), bool), [], 0
            for k, text in enumerate(batch.column(0)):
                words = words_of(text.as_py()) if n else []
                lettered[k] = has_letter(words)
                for at in range(0, len(words), HELD):
                    part = words[at : at + HELD]
                    waiting.append((k, np.fromiter(map(seen.__getitem__, part), np.int64, len(part))))
                    held += len(part)
                if held > HELD or k == len(batch) - 1:
                    # words met for the first time are taken apart together
                    evidence = np.concatenate([evidence, f.evidence(seen.new)]) if seen.new else evidence
                    for j, ids in waiting:
                        total[j] += evidence[ids].sum(0)
                    seen.new, waiting, held = [], [], 0
                    if len(seen) > HELD:
                        seen, evidence = _Remembered(), evidence[:0]
            preds, scores = [NONE] * len(batch), np.zeros(len(batch))
            for k in np.flatnonzero(lettered):
                best = int(total[k].argmax())
                preds[k] = f.languages[best]
                scores[k] = 1 / np.exp((total[k] - total[k][best]) * (np.log(4.0) / ORDERS)).sum()
            yield pa.record_batch([*batch.columns[1:], pa.array(preds, pa.string()), pa.array(scores)], names=names)

    schema = type(rows.schema)(rows.schema.fields[1:]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(rate, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found = predict(docs, fit(docs.filter(~held_out)), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
