"""Ordered work on a key's rows that does not put the key in one task.

A key's rows are cut into chunks by the value of their order column, ``ROWS`` values each. What a chunk must know of the
rows before it is little: its last rows, as guests, or sums, added up over a row a chunk. Windows run by key and chunk,
so a key with a third of all rows spreads over as many tasks as it has chunks. Empty chunks are no harm: what is carried
comes from the last chunk that has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Values of the order column in a chunk.
ROWS = 1_000_000
CHUNK, GUEST = "__chunk", "__guest"


def chunk_of(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / rows).alias(CHUNK)


def window(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key, CHUNK).orderBy(order)


def with_guests(df: DataFrame, key: str, order: str, n: int, known: list[str], rows: int | None = None) -> DataFrame:
    """``df`` in chunks, each with the last ``n`` rows before it as guests, of which only key, order and ``known`` are given."""
    chunked = df.withColumn(CHUNK, chunk_of(order, rows or ROWS))
    slim = chunked.select(key, order, *known, CHUNK)
    last = Window.partitionBy(key, CHUNK).orderBy(F.desc(order))
    tails = slim.withColumn("__nth", F.row_number().over(last)).filter(F.col("__nth") <= n)
    # a chunk's last rows and, if it has fewer, those of the chunks before it: n rows a chunk in all
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    ends = tails.withColumn("__held", F.collect_list(F.struct(order, *known)).over(upto)).filter("__nth = 1")
    following = F.lead(CHUNK).over(Window.partitionBy(key).orderBy(CHUNK))
    guests = ends.select(key, "__held", following.alias(CHUNK)).filter(F.col(CHUNK).isNotNull()).select(key, CHUNK, F.inline("__held"))
    return chunked.withColumn(GUEST, F.lit(False)).unionByName(guests.withColumn(GUEST, F.lit(True)), allowMissingColumns=True)


def own(df: DataFrame) -> DataFrame:
    """Without guests."""
    return df.filter(~F.col(GUEST)).drop(GUEST, CHUNK)


def running(df: DataFrame, key: str, order: str, sums: dict[str, Column], rows: int | None = None) -> DataFrame:
    """Adds sums over a key's rows up to each: those of the chunk by a window, those of the chunks before it by a row a chunk."""
    chunked = df.withColumn(CHUNK, chunk_of(order, rows or ROWS))
    totals = chunked.groupBy(key, CHUNK).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(key).alias("__of"), F.col(CHUNK).alias("__in"), *[F.sum(n).over(before).alias(f"__{n}") for n in sums])
    rows_of = chunked.join(bases, F.col(key).eqNullSafe(F.col("__of")) & F.col(CHUNK).eqNullSafe(F.col("__in")))
    w = window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    zero = {n: F.coalesce(f"__{n}", F.lit(0)) for n in sums}
    return rows_of.withColumns({n: F.sum(c).over(w) + zero[n] for n, c in sums.items()}).drop("__of", "__in", CHUNK, *[f"__{n}" for n in sums])


def numbered(df: DataFrame, key: str, order: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds the number (from 1) of each row of its key in order."""
    return running(df, key, order, {name: F.lit(1)}, rows)
