"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

A bin-packing instance is fully described by how many pieces there are of each length, at most ``capacity`` numbers
whatever the corpus. So the plan is made from that histogram, in bulk: dominance first fixes small sets of lengths that
provably beat all alternatives, many copies at a time, and best fit places what remains, longest first. The plan says
where ranks [r, r+n) of a length go; Spark gives each piece its rank among its length (its rank in its task plus the
earlier tasks' counts, so that no length is gathered in one task) and looks its place up.

Defined cases: a null or empty text is a piece of the end id alone; repeated rows are packed each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoder, vocabulary
from .shared import running_base, stored, texts

CAPACITY = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def cut(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """The pieces of every document with their rank among the pieces of their length in the same task."""
    vocab = vocab or vocabulary("byte_bpe_50k.json")
    end = np.uint32(end_id).tobytes()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocab).encode, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total, at, piece = len(ids) // 4, 0, 0
                length = total if total <= capacity else total % capacity or capacity
                while at < total:
                    rows.append((doc_id, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), task, seen[length]))
                    seen[length] += 1
                    at, piece, length = at + length, piece + 1, capacity
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    return texts(docs).mapInArrow(take, PIECE)


class Plan:
    """Where the pieces of each length go: (length, first rank, count, first sequence, offset) by bulk decisions."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.sequences = capacity, dict(counts), 0
        self.placed = dict.fromkeys(counts, 0)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.fixed = 0
        self.reduce()
        self.best_fit()

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.segments.append((length, self.placed[length], count, first, offset))
        self.placed[length] += count
        self.left[length] -= count

    def fix(self, lengths: list[int], count: int) -> None:
        """``count`` sequences of exactly these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, count, self.sequences, offset)
            offset += length
        self.sequences += count
        self.fixed += count

    def dominating(self, j: int, sizes: list[int]) -> list[int] | None:
        """A set with j that dominates every feasible set with j, if the rules find one.

        One set dominates another if the other's pieces can be grouped so that each group is no longer than a piece
        of the first. ``sizes``: the lengths that remain, ascending. A set fills the gap that j leaves.
        """
        gap = self.capacity - j

        def count(x: int, taken: tuple[int, ...] = ()) -> int:
            return self.left[x] - (x == j) - taken.count(x)

        def largest(limit: int, taken: tuple[int, ...] = ()) -> int:
            i = bisect_left(sizes, limit + 1) - 1
            while i >= 0 and count(sizes[i], taken) < 1:
                i -= 1
            return sizes[i] if i >= 0 else 0

        k = largest(gap)
        if not k:
            return [j]
        if k == gap:
            return [j, k]  # fills the sequence: whatever else joins j fits in k's place
        smallest = []
        for x in sizes:
            smallest += [x] * min(3, count(x))
            if len(smallest) >= 3:
                break
        if len(smallest) < 2 or sum(smallest[:2]) > gap:
            return [j, k]  # one more piece at most
        if len(smallest) >= 3 and sum(smallest[:3]) <= gap:
            return None  # four pieces may share a sequence: left to best fit
        best, deepest = 0, 0  # the largest sum of two more, and the largest shorter one of two
        for i in range(bisect_left(sizes, gap) - 1, -1, -1):
            a = sizes[i]
            if count(a) < 1:
                continue
            b = largest(min(a, gap - a), (a,))
            if b:
                best, deepest = max(best, a + b), max(deepest, b)
            if 2 * a <= gap:
                break
        if best <= k:
            return [j, k]
        b = largest(gap - k, (k,))
        return [j, k, b] if b and deepest <= b else None

    def reduce(self) -> None:
        """Fixes dominating sets, the longest pieces first, as often as the rule stays the same."""
        for j in sorted(self.left, reverse=True):
            while self.left[j]:
                sizes = sorted(x for x in self.left if self.left[x])
                found = self.dominating(j, sizes)
                if found is None:
                    break
                # an exact fill stays dominating while its pieces last; any other set is tried again each time
                exact = sum(found) == self.capacity or len(found) == 1
                times = min(self.left[x] // found.count(x) for x in found) if exact else 1
                if not exact and (spare := min(self.left[x] // found.count(x) for x in found)) > 8:
                    times = spare - 4  # copies beyond four of each cannot change what fits
                self.fix(found, max(1, times))

    def best_fit(self) -> None:
        """Places the rest, longest first, each in the fullest sequence that takes it, a whole class of equals at once."""
        free: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def release(room: int, first: int, count: int) -> None:
            if room and count:
                if room not in free:
                    free[room] = []
                    insort(order, room)
                free[room].append((first, count))

        for length in sorted((x for x in self.left if self.left[x]), reverse=True):
            while self.left[length]:
                i = bisect_left(order, length)
                if i < len(order):
                    room = order[i]
                    first, count = free[room].pop()
                    if not free[room]:
                        del free[room]
                        order.pop(i)
                    n = min(count, self.left[length])
                    self.put(length, n, first, self.capacity - room)
                    release(room - length, first, n)
                    release(room, first + n, count - n)
                    continue
                each = self.capacity // length
                full, rest = divmod(self.left[length], each)
                for count, size in ((full, each), (1, rest)):
                    if count and size:
                        for k in range(size):
                            self.put(length, count, self.sequences, k * length)
                        release(self.capacity - size * length, self.sequences, count)
                        self.sequences += count


def pack(docs: DataFrame, capacity: int = CAPACITY, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut(docs, capacity, vocab, end_id), "pieces")
    counts = running_base(pieces.groupBy("length", "task").agg(F.count("*").alias("__n")), ["length"], ["task"], "__n", "__base")
    # at most ``capacity`` rows, whatever the corpus
    plan = Plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    segments = sorted(plan.segments) or [(0, 0, 0, 0, 0)]
    length0, rank0, _, first, offset = (np.array(c, np.int64) for c in zip(*segments, strict=True))
    starts = length0 << 40 | rank0
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(starts, batch.column(3).to_numpy() << 40 | rank, "right") - 1
            yield pa.record_batch([*(batch.column(k) for k in range(5)), pa.array(first[at] + rank - rank0[at]), pa.array(offset[at])], names=names)

    based = pieces.join(counts.select("length", "task", "__base"), ["length", "task"])
    rows = based.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("__base")).alias("rank"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
