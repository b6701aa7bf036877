"""Conversation prefix trie by a pointer-jumping roll-up.

Conversations that start with the same turns share the nodes of those turns. A node is known by a digest of its whole
path: two sums modulo 2 (exclusive ors) of 64-bit hashes of each turn and its place. Such a sum is a prefix aggregate, so that the
turns of a long conversation are cut into chunks of ``CHUNK`` places and spread over tasks; and it can be undone, so that
a node's digest and last turn give its parent's digest, the parent edge, without looking at another row.

Subtree sums (leaves, savings) go up by doubling. In round k every node that is at least 2^k deep has its 2^k-th
ancestor and the sums of its subtree down to 2^k - 1 levels below; it sends these sums to that ancestor, and takes over the ancestor's own
ancestor. After the logarithm of the greatest depth, all ancestors have all sums. Deep nodes alone take part in later rounds, what is
sent is added up in the sending tasks, so that a root with a third of all nodes below it is no hot key, and each round is
stored, so that a lost executor costs no more than its round.

Ids of conversations that end at a node are hashed in ascending order. They are range-partitioned by node and id, and
each task joins its stretch into pieces of text; only pieces of up to ``PIECE`` ids travel to the task that feeds them to the
node's SHA-256, which by its nature takes one after the other, and no list of ids is held.

``rebuilt`` makes the conversations of the query: the first turns of one conversation, then the own turns of another.
Turns are put in one global order first; places in a conversation are sums over files, so no conversation is held in a task.

Defined cases: turns are ordered by turn (null first), ties by role and text digests; null role or text is
empty; repeated rows are turns each; rows without conv_id belong to no conversation and are left out; an empty table gives no
rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ordered, running_base, stored

CHUNK, PIECE = 1024, 8192
#: Conversations of a family share the turns of its first; of its own, a conversation keeps what follows the shared turns.
FAMILY, MOST_SHARED = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["p", "q"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a and b (hashes of role and text), bytes of the text; a row a turn, in one global order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the hash of a column is the seed of the next, so that role and text can't be told apart wrongly
    a, b = (F.xxhash64(F.lit(salt), role, text) for salt in (17, 29))
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")
    keys = ["conv_id", "turn", "a", "b"]  # nulls come first
    # stored, so that the range partitioner's sampling doesn't hash the texts a second time
    rows = ordered(stored(slim, "hashed"), keys, "turns")
    shards = rows.groupBy("shard", "conv_id").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    based = running_base(shards, ["conv_id"], ["shard"], "n", "base").select("shard", "conv_id", "first", "base")
    # only a conversation that goes on in another file has a base; in its first file its first row counts from 0
    place = (F.col("idx") - F.col("first") + F.col("base") + 1).alias("place")
    return rows.join(based, ["shard", "conv_id"]).select("conv_id", place, "a", "b", "bytes")


def rebuilt(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the query from ``turns``: rows (conv_id, depth, a, b, bytes, ends), and each conversation's length."""
    sizes = each.groupBy("conv_id").agg(F.max("place").alias("n"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", shared, base.alias("base")).join(first, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")
    convs = stored(convs.select("conv_id", "base", "h", taken, (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    # at most MOST_SHARED - 1 rows of a conversation meet the few conversations of its family
    heads = each.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    prefix = heads.join(convs, "base").filter("place <= taken").withColumn("depth", F.col("place"))
    own = each.join(convs, "conv_id").filter("place > h").withColumn("depth", F.col("taken") + F.col("place") - F.col("h"))
    columns = ["conv_id", "depth", "a", "b", "bytes", (F.col("depth") == F.col("length")).alias("ends")]
    return prefix.select(*columns).union(own.select(*columns)), convs.select("conv_id", "length")


def paths(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds p, q (the digest of a row's path, from the first turn to its own) and pp, pq (that of the path before it)."""
    keyed = {"p": F.xxhash64("depth", "a", "b"), "q": F.xxhash64("b", "depth", "a")}
    dealt = stored(rows.withColumns({f"own_{k}": c for k, c in keyed.items()}).withColumn("chunk", F.floor(F.col("depth") / chunk)).drop("a", "b"), "keyed")
    sums = dealt.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"own_{k}").alias(k) for k in NODE])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("conv_id", "chunk", *[F.bit_xor(k).over(before).alias(f"base_{k}") for k in NODE]).filter("chunk > 0 and base_p is not null")
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumns({k: F.bit_xor(f"own_{k}").over(upto) for k in NODE}).join(bases, ["conv_id", "chunk"], "left")
    found = found.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(f"base_{k}", F.lit(0))) for k in NODE})
    return found.select("conv_id", "depth", "bytes", "ends", *NODE, *[F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(f"p{k}") for k in NODE])


def same(left: str, right: str, names: tuple[str, str] = ("p", "q")) -> Column:
    return (F.col(f"{left}.{names[0]}") == F.col(f"{right}.p")) & (F.col(f"{left}.{names[1]}") == F.col(f"{right}.q"))


def nodes(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row a node: p, q, pp, pq (parent), depth, conv_id, n_convs, saved (its own), n_children; root included."""
    met = prefixes.groupBy(*NODE).agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("pp").alias("pp"), F.min("pq").alias("pq"),
    )
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("pp"), F.lit(None).cast("long").alias("pq"))
    both = stored(met.select(*root.columns).union(root), "nodes")
    children = both.filter("depth > 0").groupBy("pp", "pq").agg(F.count("*").alias("n_children")).select(F.col("pp").alias("p"), F.col("pq").alias("q"), "n_children")
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    found = both.join(children, NODE, "left").select(*NODE, "pp", "pq", "depth", "conv_id", "n_convs", saved, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    return stored(found, "nodes")


def rolled_up(each: DataFrame) -> DataFrame:
    """p, q, n_leaves, saved_tokens: the sums over each node's subtree, by doubling."""
    own = each.select(*NODE, "pp", "pq", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    sums = ["n_leaves", "saved_tokens"]
    sent = [own.select(*NODE, *sums)]
    active, reach = own.filter("depth > 0"), 1
    deepest = each.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        given = stored(active.groupBy("pp", "pq").agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("pp").alias("p"), F.col("pq").alias("q"), *sums), "sent")
        sent.append(given)
        if (reach := 2 * reach) > deepest:
            break
        # the ancestor's ancestor, and what has just come from below
        up = active.select(*NODE, F.col("pp").alias("up_p"), F.col("pq").alias("up_q"))
        deep = active.filter(F.col("depth") >= reach).alias("l").join(up.alias("u"), same("l", "u", ("pp", "pq"))).select(*[f"l.{c}" for c in (*NODE, "depth", *sums)], F.col("up_p").alias("pp"), F.col("up_q").alias("pq"))
        more = given.select(*NODE, *[F.col(c).alias(f"more_{c}") for c in sums])
        total = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]
        active = stored(deep.join(more, NODE, "left").select(*NODE, "pp", "pq", "depth", *total), "active")
    every = sent[0]
    for x in sent[1:]:
        every = every.union(x)
    return every.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of numbers that end in a text."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, pa.string() if k == len(names) - 1 else pa.int64()) for k, c in enumerate(columns)], names=names)


def ends(prefixes: DataFrame, lengths: DataFrame, piece: int = PIECE) -> DataFrame:
    """p, q, ends_sha256: the digest of the ids that end at each node at which one does."""
    zero = F.lit(0).cast("long")
    last = stored(prefixes.filter("ends").select(*NODE, "conv_id").union(lengths.filter("length = 0").select(zero.alias("p"), zero.alias("q"), "conv_id")), "ends")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of one node's ids, in order; a node whose ids fit a piece is one row."""
        names = [*NODE, "first", "ids"]
        node, held, rows = None, [], []

        def close() -> None:
            if held:
                rows.append((*node, held[0], ",".join(map(str, held))))

        for batch in batches:
            for p, q, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, q) != node or len(held) >= piece:
                    close()
                    node, held = (p, q), []
                held.append(conv)
            yield _batch(rows, names)
            rows.clear()
        close()
        yield _batch(rows, names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NODE, "ends_sha256"]
        node, digest, rows = None, None, []
        for batch in batches:
            for p, q, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (p, q) == node:
                    digest.update(b",")
                else:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (p, q), hashlib.sha256()
                digest.update(ids.encode())
            yield _batch(rows, names)
            rows.clear()
        if node:
            yield _batch([(*node, digest.hexdigest())], names)

    order = [*NODE, "conv_id"]
    pieces = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "p long, q long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "p long, q long, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of conversations given as in ``rebuilt``."""
    prefixes = stored(paths(rows), "paths")
    each = nodes(prefixes, lengths)
    named = each.select(F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("parent_conv_id"))
    found = each.join(rolled_up(each), NODE).join(ends(prefixes, lengths), NODE, "left")
    # last, as a hot parent's children are then split like any skewed side
    found = stored(found.select("pp", "pq", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")), "trie")
    return found.join(named, ["pp", "pq"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lengths = rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(rows, lengths)
