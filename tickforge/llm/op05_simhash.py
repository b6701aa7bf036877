"""SimHash near-duplicates by meet-in-the-middle ball hashing, with connected components.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. The whole ball of half that radius has 2,081 variants a
fingerprint, twenty times the input in the shuffle. So the 64 bits are first cut in three parts: of three differing
bits the fullest part holds at least one, hence with one part left out two fingerprints differ in at most two of the
kept bits, and the half radius is one. Every distinct fingerprint emits, for each part left out, its kept bits and all
variants with one of them flipped (131 in all); two linked fingerprints meet at least once. Copies share a
fingerprint and emit once. Colliding fingerprints are verified over all 64 bits.

A bucket never yields all its pairs: links that only confirm what a task already joined are not sent on, and a
bucket of over ``PAIRED`` members is linked by a second ball hashing over its left-out bits (see ``_star``), which
is linear in its size and loses no connection. Components come from alternating large-star and small-star rounds.

``keep_one(docs, similar=True)`` adds to these links those of texts whose sets of five-word shingles are alike at 0.8 or more, which 3 of 64 bits
seldom find: balls over symbols follow those over bits, see ``alike``.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows and equal doc_ids
keep all their rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .shared import stored, texts

RADIUS, SHINGLE, SEED = 3, 3, 42
#: (first bit, bits) of the parts, one of which is left out in turn.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket up to which its pairs are compared one by one.
PAIRED = 1024
#: Joined nodes that a task remembers; beyond, it starts anew and may send links twice.
REMEMBERED = 500_000


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text's words, ASCII letters in lower case, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if shingle == 1:
        shingles = words
    elif len(words) > shingle:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    else:
        shingles = [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits whether it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint16)
    return 2 * ones > len(hashes)


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return _packed(majority(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and the named columns of every whole text."""
    rows = texts(docs, *more)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.int64, len(batch))
            yield pa.record_batch([batch.column(0), pa.array(found), *batch.columns[2:]], names=["doc_id", "fp", *more])

    return rows.mapInArrow(take, ", ".join(["doc_id long, fp long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)]))


def _masks() -> list[tuple[int, np.ndarray]]:
    """For each part: the bits kept when it is left out, and the flips (none, or one kept bit)."""
    out = []
    for first, n in PARTS:
        kept = ~(((1 << n) - 1) << first) & (2**64 - 1)
        out.append((kept, np.array([0] + [1 << b for b in range(64) if kept >> b & 1], np.uint64)))
    return out


def _emitted(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """key, fp: each row (fp first) at all its meeting points, of which ``keys`` gives an array a row of a batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                key = keys(part)
                fp = np.tile(part.column(0).to_numpy(), len(key) // max(1, len(part)))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp)], names=["key", "fp"])

    # a row becomes over a hundred: dealt to all shuffle partitions first, so that no task writes a merged partition's
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *rows.columns).mapInArrow(emit, "key long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """key and fp: each fingerprint at all its meeting points. The key is the variant, tagged by its part."""
    masks = _masks()

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        bits = batch.column(0).to_numpy().view(np.uint64)
        each = [((bits & np.uint64(kept))[None, :] ^ flips[:, None]) | np.uint64(part + 1 << PARTS[part][0]) for part, (kept, flips) in enumerate(masks)]
        return np.concatenate(each).ravel()

    return _emitted(fps, keys)


def _star(key: int, members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within one large bucket, linear in its size.

    A member (r kept bits, at most one, from the bucket's variant) is put at every value of the left-out bits within
    one flip of its own, within two if r is 0. At each value, everyone is linked to one member whose total distance
    from there is at most 1; as totals are at most 2, all these links are true. Two members within three bits meet so
    in this bucket or another.
    """
    links = []
    for part, ((first, n), (kept, _)) in enumerate(zip(PARTS, _masks(), strict=True)):
        r = np.bitwise_count((members ^ np.uint64(key)) & np.uint64(kept))
        if (key >> first) & ((1 << n) - 1) != part + 1 or r.max() > 1:
            continue
        left = ((members >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64)
        singles = [1 << b for b in range(n)]
        near = np.array([0, *singles], np.int64)
        far = np.array([a | b for a, b in combinations(singles, 2)], np.int64)
        at = [(left[:, None] ^ near[None, :]).ravel()]
        who = [np.repeat(np.arange(len(members)), len(near))]
        total = [(r[:, None] + (near != 0)[None, :]).ravel()]
        exact = np.flatnonzero(r == 0)
        at.append((left[exact][:, None] ^ far[None, :]).ravel())
        who.append(np.repeat(exact, len(far)))
        total.append(np.full(len(exact) * len(far), 2))
        at, who, total = map(np.concatenate, (at, who, total))
        order = np.lexsort((total, at))
        at, who, total = at[order], who[order], total[order]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hub = np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))
        joined = (total[hub] <= 1) & (np.arange(len(at)) != hub)
        links.append((members[who[hub[joined]]], members[who[joined]]))
    return links


def _paired(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    close = [(i, i + 1 + np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= RADIUS)) for i in range(len(members) - 1)]
    return [(np.repeat(members[i], len(js)), members[js]) for i, js in close if len(js)]


class _Joined:
    """Which nodes a task has already connected."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def new(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Of these links those that connect something new."""
        if len(self.parent) > REMEMBERED:
            self.parent.clear()
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := self.root(x)) != (q := self.root(y)):
                self.parent[p] = q
                out.append((x, y))
        return out


def collide(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the fingerprints (unsigned) that share a key; rows are sorted by key."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.concatenate([start, [len(keys)]]))
    small = np.repeat(length <= 32, length)
    found = []
    for step in range(1, int(min(32, length.max(initial=0)))):
        i = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= RADIUS]
        found.append((fps[i], fps[i + step]))
    for at, n in zip(start[length > 32].tolist(), length[length > 32].tolist(), strict=True):
        members = np.unique(fps[at : at + n])
        found += _paired(members) if len(members) <= PAIRED else _star(int(keys[at].view(np.uint64)), members)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _met(emitted: DataFrame, out: Callable[[_Joined, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """a, b: what ``out`` gives for the keys (sorted, each whole) and fingerprints of a task, with a state of its own."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, rest, last = _Joined(), [], None
        for batch in batches:
            if not len(batch):
                continue
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if keys[-1] != last:
                if rest or cut:
                    yield out(joined, *map(np.concatenate, zip(*rest, (keys[:cut], values[:cut]), strict=True)))
                rest, last = [], keys[-1]
            rest.append((keys[cut:], values[cut:]))
        if rest:
            yield out(joined, *map(np.concatenate, zip(*rest, strict=True)))

    return emitted.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def _linked(a: Sequence[int], b: Sequence[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect all fingerprints within the radius; each is a true link."""

    def out(joined: _Joined, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        rows = joined.new(*(x.view(np.int64) for x in collide(keys, values)))
        return _linked([r[0] for r in rows], [r[1] for r in rows])

    return _met(variants(fps.select("fp")), out)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge, by large-star and small-star.

    Each round is two aggregations and joins by node; the edges are stored between rounds, so a lost executor costs
    no more than its round. Edges shrink to stars around the roots.
    """

    def mark(df: DataFrame) -> tuple:
        # the sum of whole 64-bit hashes: sets that differ agree in it once in 2^64
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    larger = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = stored(larger.distinct(), "edges")
    seen = mark(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        before, seen = seen, mark(now)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def rooted(classes: DataFrame) -> DataFrame:
    """Adds root, the least fingerprint of its component, to a table of distinct fingerprints."""
    roots = components(links(classes))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, for every row of docs."""
    fps = stored(fingerprints(docs), "fingerprints")
    classes = rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = classes.join(least, "root").select("fp", "component_id")
    return fps.join(by_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similar: bool = False) -> DataFrame:
    """One row of each component stays, whatever doc_ids its rows have: that of the smallest doc_id (rows without one
    last), then of the smallest digest of id and text; of rows that repeat both, the one whose columns come first in order.

    Components are those of ``near_duplicates``; if similar, texts alike at 0.8 over five-word shingles are linked too. The choice is made on ids, fingerprints and digests; whole rows are shuffled once, by digest.
    """
    from . import alike

    # whole rows lie in a struct, so that no name of theirs meets one of here
    row = docs.select(F.struct("*").alias("row"))
    doc_id, text = F.col("row").getField("doc_id").cast("long"), F.coalesce(F.col("row").getField("text"), F.lit(""))
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(":"), text)
    rows = row.select("row", doc_id.alias("doc_id"), text.alias("text"), F.unhex(F.sha2(named, 256)).alias("key"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    if similar:
        nodes = stored(alike.sketched(rows, "key"), "sketches")
        found = nodes.groupBy("node").agg(least).join(alike.rooted(nodes), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    else:
        found = rooted(stored(fingerprints(rows, "key"), "fingerprints").groupBy("fp").agg(least))
    first = found.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
    others = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text") and _orderable(docs.schema[c].dataType)]
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(others)])
    # repeated rows meet in their tasks before the shuffle, however many there are
    one = rows.groupBy("key").agg((F.min_by("row", order) if others else F.first("row")).alias("row"))
    return one.join(stored(first, "kept-rows"), "key", "left_semi").select("row.*")


def _orderable(kind: DataType) -> bool:
    return not any(t in kind.simpleString() for t in ("map<", "variant", "interval"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
