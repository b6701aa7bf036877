"""Language-model scores by subword lattice likelihood.

A word (ASCII letters in lower case) is a lattice of all its segmentations into the pieces of an existing subword
vocabulary; its probability is their sum, by the forward recursion in log space. Documents fall in classes by their
language label, and each class weighs the pieces anew: their expected uses over all segmentations of the training words
met once in the class, which stand for the words not met yet, ``ROUNDS`` times. Words met in training are arcs of the
lattice too. With c_k(w) a word's uses in the training documents of class k, N_k all of them and their ends, c(w) the
uses in all classes:

    P_k(w) = (c_k(w) - D(c_k(w))) / N_k + H_k (B_k Q(w) + (1 - B_k) L_k(w)),  P_k(end) = ends_k / N_k

The discounts D (of counts 1, 2, 3 and more) come from the counts of counts (Chen and Goodman's estimate), H_k is the
mass they free, Q the discounted share c(w) - D(c(w)) among the words of all classes, L_k the lattice, and B_k the share
of words met once in the class that other classes have too. In a document, its own earlier words are further arcs, as
texts repeat their own words; the weight of those arcs is not known, so the document's probability under a class is the mean over the
weights ``OWN``. The score is the log of the text's marginal probability: the sum over all classes, each with its share of the
training documents. The text's own label has no part in it; labels of training documents only say which class learns from them.

Every document's words are numbered in the dictionary of its block, some megabytes of texts of one class, when the texts
are read, once. Only dictionaries meet the corpus counts, so that a word travels once for each block and not for each
use; the answers, a word's log probability under every class, come back by block, where documents are arrays of word numbers. They travel in
single precision: all terms of a score have one sign, so its relative error is that of a term, 2^-24, at most.

Defined cases: a null or empty text is the end alone; with no training documents all words are unknown and the
pieces keep their first weights; without a column ``lang`` there is one class, and a null or rare language is in the
last class; words of any length are scored and re-estimate the pieces; repeated rows are scored and counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import vocabulary
from .lattice import lattice_of
from .shared import stored, texts

#: Rounds of re-estimation, smoothing of pieces, and the greatest weights of the document's own words.
ROUNDS, SMOOTHING, OWN = 3, 0.02, (0.0, 0.03, 0.1, 0.3)
#: Classes: the languages of the most training documents, and one for all others.
CLASSES = 8
#: Bytes of text in the open blocks of a task: larger blocks repeat fewer words in the shuffles and hold more in a task.
BLOCK_BYTES = 14_000_000
BLOCK = "block long, class int, idx int, word string, trained long, doc_ids binary, held_out binary, lengths binary, ids binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Documents of one class, as numbers of their words."""

    def __init__(self):
        self.words, self.size, self.rows = _Numbers(), 0, []

    def add(self, doc_id: int | None, raw: bytes, held: bool) -> None:
        ids = np.array(list(map(self.words.__getitem__, raw.lower().split())), np.int64)
        self.rows.append((-(2**63) if doc_id is None else doc_id, held, ids))
        self.size += len(raw)

    def batches(self, block: int, of: int) -> Iterator[pa.RecordBatch]:
        doc_ids, held, ids = zip(*self.rows, strict=True)
        flat = np.concatenate(ids)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        trained = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(self.words)) if len(self.words) else np.zeros(0, np.int64)
        data = [np.array(doc_ids, np.int64), np.array(held, np.uint8), lengths, flat.astype(np.uint32)]
        yield pa.record_batch([pa.array([block]), pa.array([of], pa.int32()), pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([0]), *(pa.array([d.tobytes()], pa.binary()) for d in data)], names=NAMES)
        spelled = list(self.words)
        for at in range(0, len(spelled), 50_000):
            part = spelled[at : at + 50_000]
            n = len(part)
            known = [pa.array(x) for x in (np.full(n, block), np.full(n, of, np.int32), np.arange(at, at + n, dtype=np.int32))]
            yield pa.record_batch([*known, pa.array(part, pa.binary()).cast(pa.string()), pa.array(trained[at : at + n].astype(np.int64)), *[pa.nulls(n, pa.binary())] * 4], names=NAMES)


def class_of(docs: DataFrame, held_out: Column) -> tuple[Column, int]:
    """Each document's class, and how many classes there are. The driver gets ``CLASSES`` - 1 names at most."""
    if "lang" not in docs.columns:
        return F.lit(0), 1
    lang = F.col("lang").cast("string")
    most = docs.filter(~held_out & lang.isNotNull()).groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES - 1).collect()
    if not most:
        return F.lit(0), 1
    found = F.create_map(*[F.lit(x) for k, r in enumerate(most) for x in (r.lang, k)])
    return F.coalesce(F.try_element_at(found, lang), F.lit(len(most))), len(most) + 1


def blocks(docs: DataFrame, held_out: Column, of: Column) -> DataFrame:
    """A row for each word of a block (idx its number, trained its uses in training documents) and, idx -1, the block's documents."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, size = TaskContext.get().partitionId(), 0, 0
        held: dict[int, _Block] = {}
        for batch in batches:
            for doc_id, text, apart, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode()
                held.setdefault(k, _Block()).add(doc_id, raw, apart)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    k = max(held, key=lambda k: held[k].size)
                    size -= held[k].size
                    yield from held.pop(k).batches(task << 32 | nth, k)
                    nth += 1
        for k, block in held.items():
            yield from block.batches(task << 32 | nth, k)
            nth += 1

    return texts(docs, held_out.alias("__held"), of.cast("int").alias("__class")).mapInArrow(number, BLOCK)


@dataclass
class Counts:
    """What the training words of one class, or of all, add up to: uses, words, words met 1 to 4 times, and words met once that other classes have too."""

    used: int
    distinct: int
    met: tuple[int, int, int, int]
    shared: int = 0

    def discounts(self) -> np.ndarray:
        """Off counts of 0, 1, 2, 3 and more; a half of the usual where too few words tell."""
        n1, n2, n3, n4 = self.met
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        given = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.7, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.8]
        return np.array([0.0, *(min(max(d, 0.05), 0.95 * (k + 1)) for k, d in enumerate(given))])

    def freed(self) -> float:
        """What the discounts take off all counts."""
        n = np.array([0, self.met[0], self.met[1], self.distinct - self.met[0] - self.met[1]])
        return float(self.discounts() @ n)

    def left(self, count: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return count - self.discounts()[np.minimum(count, 3)]


def counted(counts: DataFrame, classes: int) -> list[Counts]:
    """For each class, then for all, from a table of words with a column of uses a class."""
    every = sum((F.coalesce(f"t{k}", F.lit(0)) for k in range(1, classes)), F.coalesce("t0", F.lit(0)))
    wanted = []
    for x in [*(F.col(f"t{k}") for k in range(classes)), every]:
        wanted += [F.coalesce(F.sum(x), F.lit(0)), F.count_if(x > 0), *(F.count_if(x == j) for j in range(1, 5)), F.count_if((x == 1) & (every > 1))]
    row = counts.agg(*[c.alias(f"c{i}") for i, c in enumerate(wanted)]).first()
    return [Counts(row[i], row[i + 1], tuple(row[i + 2 : i + 6]), row[i + 6]) for i in range(0, len(wanted), 7)]


def learned_pieces(counts: DataFrame, classes: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the vocabulary's pieces, a row a class, from the training words met once in it.

    The driver gets one number a piece and class in each round, at most the vocabulary's size for each.
    """
    lattice = lattice_of(path)
    weights = np.tile(lattice.scores[:-1], (classes, 1))
    once = [F.when(F.col(f"t{k}") == 1, k) for k in range(classes)]
    known = stored(counts.select("word", F.explode(F.array_compact(F.array(*once))).alias("class")), "words-met-once")
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            lattice, total = lattice_of(path), np.zeros(weights.shape)
            for batch in batches:
                of = batch.column(1).to_numpy()
                words = np.array([b" " + w for w in batch.column(0).cast(pa.binary()).to_pylist()], object)
                for k in np.unique(of):
                    mine = words[of == k].tolist()
                    total[k] += lattice.weighed(weights[k]).expected(mine, np.ones(len(mine)))
            k, piece = np.nonzero(total)
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["class", "piece", "uses"])

        found = known.mapInArrow(expect, "class int, piece int, uses double").groupBy("class", "piece").agg(F.sum("uses").alias("uses")).collect()
        if not found:
            break
        uses = np.full(weights.shape, SMOOTHING)
        for r in found:
            uses[r["class"], r.piece] += r.uses
        learned = sorted({r["class"] for r in found})
        weights[learned] = np.log(uses / uses.sum(1, keepdims=True))[learned]
    return weights


def own_words(log_p: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per class (row) and document: the log of its words' probability, with its own earlier words as arcs, as the mean over their weights."""
    start = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(ids))
    earlier = at - start[owner]
    # how often the document had each word before: ranks among the same word of the same document
    order = np.lexsort((ids, owner))
    first = np.ones(len(ids), bool)
    first[1:] = (ids[order][1:] != ids[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    seen = np.empty(len(ids), np.int64)
    seen[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    again = np.flatnonzero(seen)
    share = seen[again] / earlier[again]
    sums = np.zeros((len(OWN), len(log_p), len(lengths)))
    for j, weight in enumerate(OWN):
        own = weight * earlier / (earlier + 20.0)
        for k, of_class in enumerate(log_p):
            p = of_class[ids] + np.log1p(-own)
            if weight:
                p[again] = np.logaddexp(p[again], np.log(own[again] * share))
            sums[j, k] = np.bincount(owner, p, len(lengths))
    return np.logaddexp.reduce(sums) - math.log(len(OWN))


def scores(docs: DataFrame, held_out: Column, path: str | None = None) -> DataFrame:
    """Scores all documents by a model of those not held out; see RESULT."""
    path = path or vocabulary("piece_bpe_32k.model")
    of, classes = class_of(docs, held_out)
    read = stored(blocks(docs, held_out, of), "blocks")
    words = read.filter("idx >= 0").select("block", "class", "idx", "word", "trained")
    # a column a class; null: no document of the class has the word
    uses = [F.sum(F.when(F.col("class") == k, F.col("trained"))).alias(f"t{k}") for k in range(classes)]
    counts = stored(words.groupBy("word").agg(*uses), "word-counts")
    *of_class, of_all = counted(counts, classes)
    ends = np.zeros(classes, np.int64)
    for r in docs.filter(~held_out).groupBy(of.alias("class")).agg(F.count("*").alias("n")).collect():
        ends[r["class"]] = r.n
    n, v = of_all.used + int(ends.sum()), of_all.distinct + int(ends.sum() > 0)
    weights = learned_pieces(counts, classes, path)
    totals = np.array([c.used for c in of_class]) + ends
    freed = [c.freed() / t if t and c.used else 1.0 for c, t in zip(of_class, totals.tolist(), strict=True)]
    shared = [(c.shared + 0.5) / (c.met[0] + 1) if classes > 1 and of_all.used > c.used else 0.0 for c in of_class]
    known_mass = of_all.used - of_all.freed()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            count = np.stack([batch.column(1 + k).fill_null(0).to_numpy() for k in range(classes)])
            every = count.sum(0)
            spelled = [b" " + w for w in batch.column(0).cast(pa.binary()).to_pylist()]
            pieces, log_p = lattice.log_probabilities(spelled, weights), np.zeros((classes, len(batch)), np.float32)
            for k in range(classes):
                with np.errstate(divide="ignore"):
                    spelt = pieces[k] + math.log(freed[k] * (1 - shared[k]))
                    whole = np.log(of_class[k].left(count[k]) / max(totals[k], 1) + freed[k] * shared[k] * of_all.left(every) / max(known_mass, 1.0))
                log_p[k] = np.logaddexp(spelt, whole)
            yield pa.record_batch([batch.column(0), pa.array(every), *map(pa.array, log_p)], names=["word", "trained", *under])

    under = [f"p{k}" for k in range(classes)]
    weighed = stored(counts.mapInArrow(weigh, "word string, trained long, " + ", ".join(f"{c} float" for c in under)), "weighed-words")
    answers = words.select("block", "idx", "word").join(weighed, "word").select(F.col("block").alias("of_block"), "idx", "trained", *under)
    log_end = np.log(np.where(ends > 0, ends, 0.5) / np.maximum(totals, 1)) + np.log((ends + 1) / (ends.sum() + classes))
    base_end = math.log10((int(ends.sum()) + 1) / (n + v + 1))
    any_end = int(ends.sum() > 0)

    def score(key: tuple, documents: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        row = documents.iloc[0]
        doc_ids, held, lengths = (np.frombuffer(row[c], t) for c, t in (("doc_ids", np.int64), ("held_out", np.bool_), ("lengths", np.int64)))
        ids = np.frombuffer(row["ids"], np.uint32).astype(np.int64)
        trained, log_p = np.zeros(len(answered), np.int64), np.zeros((classes, len(answered)))
        trained[answered["idx"]] = answered["trained"]
        for k, c in enumerate(under):
            log_p[k, answered["idx"]] = answered[c]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((trained + 1) / (n + v + 1))
        sums = [np.bincount(owner, x[ids], len(lengths)) for x in (trained > 0, base)]
        model = np.logaddexp.reduce(own_words(log_p, ids, lengths) + log_end[:, None])
        return pd.DataFrame({
            "doc_id": doc_ids, "held_out": held, "n_tokens": lengths + 1, "n_known": sums[0].astype(np.int64) + any_end,
            "train_tokens": n, "base_score": sums[1] + base_end, "score": model / math.log(10),
        })

    documents = read.filter("idx < 0").select("block", "class", "doc_ids", "held_out", "lengths", "ids")
    out = documents.groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(score, RESULT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
