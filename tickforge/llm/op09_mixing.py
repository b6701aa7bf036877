"""Mixing sources to target weights by systematic sampling.

Each source's target is its share by weight of ``share`` of all words, at most ``most`` times the source; what is cut
off is shared out again. A document's expected copies are its source's target over its size. Within a source,
documents run in the order of size, doc_id and text hash; the expected copies are prefix-summed, one random offset is added, and a
document is taken once for every integer its stretch crosses. In size order equal stretches hold equal words, so the
words taken come within about one long document of the target. Where a source has few documents that is still far, so
the offset is drawn ``DRAWS`` times and the draw whose total comes nearest is used (balanced rejection).

As a source's documents all expect the same copies, the prefix sum is the document's rank times those; ranks are
counted by task and summed over tasks, so a source with a third of all rows is spread like any other.

Defined cases: null text has size 0; a source of no words has target 0 and gives nothing; null is a source, the last;
repeated rows are sampled each; an empty table gives no rows. ``mix`` returns the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ordered, running_base, stored

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20
#: Random offsets drawn for a source, of which the one with the nearest total is used; each draw follows the last by
#: the golden section, which spreads them evenly.
DRAWS, GOLDEN = 16, 0.6180339887498949


def size_in_words(text: Column) -> Column:
    """Words of a text (runs without ASCII white space), 0 for null: the separators inside it, plus one."""
    spaces = "".join(map(chr, (9, 10, 11, 12, 13)))
    plain = F.translate(text, spaces, " " * 5)
    return F.when(text.isNull() | (F.trim(plain) == ""), 0).otherwise(F.regexp_count(F.trim(plain), F.lit(" +")) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: water-filling of the weighted shares under the caps.

    Only three sums come to the driver in each round; a round caps at least one more source.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    last = per.withColumn("__null", F.col("source").isNull())
    in_order = ordered(last, ["__null", "source"], "sources-in-order")
    shards = in_order.groupBy("shard").agg(F.count("*").alias("__n"), F.min("idx").alias("__first"))
    place = in_order.join(running_base(shards, [], ["shard"], "__n", "__base"), "shard")
    nth = F.col("idx") - F.col("__first") + F.col("__base")
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    known = stored(place.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weights")
    budget = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        capped, n, open_weight = known.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            break
        level, full = (budget - capped) / open_weight, n
    return known.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """source, size, doc_id and the text's hash, by which rows are put in order, and whatever goes along."""
    source = F.col("source").cast("string").alias("source")
    return docs.select(source, size_in_words(F.col("text")).alias("size"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), row.alias("row"))


def copies(sizes: DataFrame, seed: int = SEED, **mixture) -> DataFrame:
    """Adds source_size, target and copies to every row of ``sized``."""
    rows = ordered(sizes, ["source", "size", "doc_id", "tie"], "by-source")
    same = rows.groupBy("shard", "source").agg(F.count("*").alias("__n"), F.min("idx").alias("__first"))
    based = running_base(same, ["source"], ["shard"], "__n", "__base").alias("b")
    goal = targets(rows.select("source", "size"), **mixture).alias("t")
    known = based.join(goal, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.shard", "b.source", "__first", "__base", "source_size", "target")
    known = stored(known, "places")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("idx") - F.col("__first") + F.col("__base")
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("r.source"), F.lit("\0null"))), F.lit(1 << 30)) / float(1 << 30)

    def placed(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.alias("r").join(right.alias("k"), (F.col("r.shard") == F.col("k.shard")) & F.col("r.source").eqNullSafe(F.col("k.source")))

    def crossed(draw: Column) -> Column:
        offset = F.pmod(drawn + draw * GOLDEN, F.lit(1.0))
        return (F.floor(offset + ratio * (rank + 1)) - F.floor(offset + ratio * rank)).cast("int")

    slim = placed(rows.select("shard", "source", "idx", "size"), known)
    sums = slim.groupBy("r.source").agg(F.max("target").alias("__target"), *[F.sum(crossed(F.lit(j)) * F.col("size")).alias(f"__{j}") for j in range(DRAWS)])
    misses = F.array(*[F.abs(F.col(f"__{j}") - F.col("__target")) for j in range(DRAWS)])
    best = sums.select(F.col("source").alias("__source"), (F.array_position(misses, F.array_min(misses)) - 1).alias("__draw"))
    # what a row needs is joined by file and source, so whole rows are never dealt by source
    known = stored(known.join(best, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"), "draws")
    return placed(rows, known).select("r.doc_id", "r.source", "r.size", "r.row", "source_size", "target", crossed(F.col("__draw")).alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, **mixture) -> DataFrame:
    """The mixed documents, each row as often as it is taken, with the columns of docs.

    Only sizes and row numbers are put in order; whole rows are stored with their numbers, by which their copies are joined to them,
    so that a task's share of text doesn't depend on the order of sizes.
    """
    rows = stored(sized(docs, F.struct("*")).withColumn("number", F.monotonically_increasing_id()), "sizes")
    taken = copies(rows.select("source", "size", "doc_id", "tie", F.col("number").alias("row")), seed, **mixture).filter("copies > 0")
    found = rows.select("number", "row").join(taken.select(F.col("row").alias("number"), "copies"), "number")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored, so that the range partitioner's sampling doesn't count the words a second time
    out = copies(stored(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(0)), "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
