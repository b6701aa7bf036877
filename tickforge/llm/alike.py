"""Groups of texts that SimHash links or whose sets of five-word shingles are alike at 0.8 or more, by balls over bits, then over symbols.

First come the links of ``op05_simhash``, all of them: fingerprints of three-word shingles, balls of half the radius, verification over all 64 bits
(see ``fingerprinted``). They find copies and texts of few edits; for likeness 0.8 SimHash bits are too coarse: two sets at 0.8 differ in up to 0.15 of their bits, so a ball that catches 95 of 100 such
pairs has some 400 variants a text, and needs more bits, hence more variants, the more texts there are. So texts get fingerprints of a second kind,
whose links are added to those of the first; their places hold symbols instead of bits: the least value of the set's shingles under a hash of the place's own, which two sets share with
exactly the chance of their likeness, whatever the edit was. A text has ``PRINTS`` fingerprints of ``SYMBOLS`` symbols; the ball
of half the radius is what is left with one symbol left out in turn, tagged by its place (24 variants in all). Two texts meet where a
fingerprint of theirs differs in one symbol at most: with a chance of 0.986 at a likeness of 0.8, 0.998 at 0.85; unlike texts never share five symbols.

Sets that meet are verified by their ``LEAST_HASHES`` least hashes: exactly where the sets are no larger, else as an estimate that must
reach ``LIKE_SHARE``. Equal sets are one node, so copies meet once. What is verified does not depend on the size of a bucket:

1. every member is held against the least member of its bucket, which is linear in the bucket (a hot one is split as a skewed join);
2. components of these links are labelled; a bucket whose members are all in one component needs nothing more;
3. in the others every pair of members of different components is compared, in blocks of about ``BLOCK`` members, a task a pair of blocks.

So a bucket of a million alike texts costs a million comparisons, and no pair that meets goes untested unless it is already joined. Buckets of the same
members are compared once. The third step is quadratic in what is left: texts that meet but are not alike, such as a million forms of likeness 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op05_simhash import SEED, components, fingerprint, links
from .shared import stored, texts

SHINGLE, LIKE = 5, 0.8
PRINTS, SYMBOLS = 4, 6
LEAST_HASHES, LIKE_SHARE = 512, 0.77
BLOCK = 256


def _odd(n: int, salt: str) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"{salt}{j}", SEED) | 1 for j in range(n)], np.uint64)


_FACTORS, _TURNS, _PLACES = _odd(SHINGLE + 1, ""), _odd(PRINTS * SYMBOLS, "turn"), _odd(PRINTS * SYMBOLS, "place").reshape(PRINTS, SYMBOLS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _FACTORS[SHINGLE]
    return x ^ x >> np.uint64(29)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Each value once, ascending."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class _Words(dict):
    """XXH64 of words, remembered for up to 100,000 of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()


def shingle_set(text: str) -> np.ndarray:
    """A hash of each different five-word shingle, ascending; of the whole sequence of words if that is shorter."""
    each = text.encode("utf-8", "surrogatepass").lower().split()
    words = np.fromiter(map(_words.__getitem__, each), np.uint64, len(each))
    n = min(SHINGLE, len(words))
    if not n:
        return words
    hashes = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        hashes += words[k : len(words) - n + 1 + k] * _FACTORS[k]
    return _distinct(_mixed(hashes))


def symbols(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the places' hashes."""
    least = np.full(len(_TURNS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        each = hashes[None, at : at + (1 << 11)] ^ _TURNS[::-1, None]
        each *= _TURNS[:, None]
        each ^= each >> np.uint64(31)
        np.minimum(least, each.min(1), out=least)
    return least


def variants(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints with one symbol left out in turn."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    weighed = _mixed(symbols(hashes)).reshape(PRINTS, SYMBOLS) * _PLACES
    return _mixed(weighed.sum(1, dtype=np.uint64)[:, None] - weighed + _PLACES[::-1, ::-1]).ravel()


def sketch(text: str) -> tuple[int, bytes, np.ndarray]:
    """Of a text's set of shingles: its digest, its least hashes (their upper 32 bits) and its variants."""
    import xxhash

    hashes = shingle_set(text)
    node = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))
    # multiplied anew: the set is in the order of its hashes, and so would the halves be
    halves = _distinct((hashes * _FACTORS[0] >> np.uint64(32)).astype(np.uint32))
    return node, halves[:LEAST_HASHES].tobytes(), variants(hashes)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sketches' least hashes show sets that are alike."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    shared = np.intersect1d(a, b, assume_unique=True)
    if max(len(a), len(b)) < LEAST_HASHES:
        return len(shared) >= LIKE * (len(a) + len(b) - len(shared))
    union = np.union1d(a, b)[:LEAST_HASHES]
    return int((shared <= union[-1]).sum()) >= LIKE_SHARE * len(union)


def _hashes(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint32)


def sketched(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (SimHash), node, least, variants and the named columns of every whole text."""
    rows = texts(docs, *more)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                new = zip(*((fingerprint(t), *sketch(t)) for t in (x.as_py() for x in part.column(1))), strict=True)
                columns = [pa.array([v.view(np.int64) for v in c] if pa.types.is_list(k) else c, k) for c, k in zip(new, kinds, strict=True)]
                yield pa.record_batch([part.column(0), *columns, *part.columns[2:]], names=["doc_id", "fp", "node", "least", "variants", *more])
        # the worker lives on and does other work
        _words.clear()

    return rows.mapInArrow(take, ", ".join(["doc_id long, fp long, node long, least binary, variants array<long>", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)]))


def fingerprinted(sketches: DataFrame) -> DataFrame:
    """a, b: links of nodes that connect all texts whose SimHash fingerprints are equal or within the radius."""
    each = stored(sketches.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")), "fingerprints")
    equal = sketches.join(each.filter("low <> high"), "fp").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = stored(links(each), "fingerprint-links")
    for end in ("a", "b"):
        near = near.join(each.select(F.col("fp").alias(end), F.col("low").alias(f"low_{end}")), end)
    return equal.union(near.select("low_a", "low_b")).filter("a <> b").distinct()


def verified(each: DataFrame, least: DataFrame) -> DataFrame:
    """a, b: the links whose least hashes, given by node, are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [alike(_hashes(x), _hashes(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    for end in ("a", "b"):
        each = each.join(least.select(F.col("node").alias(end), F.col("least").alias(f"least_{end}")), end)
    return each.select("a", "b", "least_a", "least_b").mapInArrow(check, "a long, b long")


def compare(rows: list[tuple], apart: bool) -> list[tuple[int, int]]:
    """True links among rows (block, root, node, rep, least) of different components; of different blocks if ``apart``.

    What a link has joined here is one component from then on.
    """
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    held, out = [_hashes(r[4]) for r in rows], []
    for i, (block, mine, node, rep, _) in enumerate(rows):
        for j in range(i):
            other = rows[j]
            # the least member has been held against all others
            if (apart and other[0] == block) or node == rep or other[2] == rep or (p := root(mine)) == (q := root(other[1])):
                continue
            if alike(held[i], held[j]):
                up[p] = q
                out.append((node, other[2]))
    return out


def crossed(members: DataFrame, roots: DataFrame, least: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """a, b: true links between members of a bucket that are in different components so far, from members (key, node, rep, n).

    None where all buckets are settled.
    """
    labelled = members.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ones = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.first("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("too"))
    keys = stored(open_ones.filter("least <> most").groupBy("n", "who", "too").agg(F.min("key").alias("key")).select("key"), "unsettled")
    if keys.isEmpty():
        return None
    rows = labelled.join(keys, "key", "left_semi").select("key", "node", "rep", "n", "root")
    blocks = F.ceil(F.col("n") / block)
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pairs = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "root", "node", "rep").join(least, "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def close() -> pa.RecordBatch:
            found = compare(held, last[1] != last[2])
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != last:
                    if held:
                        yield close()
                    last, held = (key, i, j), []
                held.append(tuple(row))
        if held:
            yield close()

    place = ["key", "i", "j"]
    return pairs.select(*place, "mine", "root", "node", "rep", "least").repartition(*place).sortWithinPartitions(*place, "node").mapInArrow(links, "a long, b long")


def rooted(sketches: DataFrame) -> DataFrame:
    """node, root (the least node of its group) of every node that has a link; from a stored table of ``sketched``."""
    each = sketches.groupBy("node").agg(F.min("variants").alias("variants"))
    emitted = stored(each.select("node", F.explode("variants").alias("key")), "variants")
    buckets = emitted.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    members = stored(emitted.join(buckets, "key"), "members")
    met = stored(members.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), "met")
    # the hashes of the members alone, for all that follows
    ends = stored(met.select(F.col("a").alias("node")).union(met.select(F.col("b").alias("node"))).distinct(), "ends")
    least = stored(sketches.join(ends, "node", "left_semi").groupBy("node").agg(F.min("least").alias("least")), "least")
    roots = components(stored(fingerprinted(sketches).union(verified(met, least)), "links"))
    more = crossed(members, roots, least)
    if more is None:
        return roots
    # a star for each component so far says all that its links said
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
