"""Candles, rolling volatility, de-duplication and retention over tick series: windows and aggregations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunks

RING, LEAST_SIGMA = 100, 0.1
#: Time, in its own units, that a chunk of an as-of join spans: a day of milliseconds.
ASOF_WIDTH = 86_400_000


def candles(ticks: DataFrame, seconds: int) -> DataFrame:
    """Open, high, low, close and volume by symbol and epoch-aligned bucket; time in seconds.

    One partial aggregation a task, then one shuffle by symbol and bucket. Volume is summed in integer lots.
    """
    time = (F.floor(F.col("ts_ms") / (seconds * 1000)) * seconds).cast("long").alias("time")
    return ticks.groupBy("symbol", time).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), (F.sum("lots") / 100.0).alias("volume"),
    )


def newest(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group. Spark keeps n a task and group before the shuffle (window group limit)."""
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= n).drop("__nth")


def last_by(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The last row for each key, as a map that is written to in order would keep. Aggregated in every task first."""
    names = [f"__k{i}" for i in range(len(keys))]
    kept = df.withColumns(dict(zip(names, keys, strict=True))).groupBy(*names).agg(F.max_by(F.struct(*df.columns), order).alias("row"))
    return kept.select("row.*")


WIDE = "decimal(38,0)"


def _sigma(n: Column, s1: Column, s2: Column, scale: float) -> Column:
    """Population deviation from exact sums of whole price units, in prices; never under ``LEAST_SIGMA``."""
    n, s1, s2 = n.cast("decimal(4,0)"), s1.cast("decimal(19,0)"), s2.cast("decimal(33,0)")
    deviation = F.sqrt((n * s2 - s1 * s1).cast("double") / (n * n).cast("double")) / scale
    return F.greatest(deviation, F.lit(LEAST_SIGMA))


def _sums(df: DataFrame, order, last: int) -> DataFrame:
    """Adds s1 and s2, the sums of the ``RING`` prices and their squares that end ``last`` rows ago, as differences of running sums."""
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    units = F.col("cents").cast("decimal(19,0)")
    summed = df.withColumns({"__r1": F.sum(units.cast(WIDE)).over(w), "__r2": F.sum((units * units).cast(WIDE)).over(w)})
    at = lambda c, n: F.coalesce(F.lag(c, n).over(order) if n else F.col(c), F.lit(0).cast(WIDE))
    return summed.withColumns({s: at(r, last) - at(r, last + RING) for s, r in (("s1", "__r1"), ("s2", "__r2"))}).drop("__r1", "__r2")


def rolling_volatility(ticks: DataFrame, zero_slot: bool = True, scale: float = 100.0, rows: int | None = None) -> DataFrame:
    """Deviation of the last 100 prices, never under 0.1. ``scale``: units of ``cents`` in a price of one.

    With ``zero_slot``, until the ring has 100 prices one of its empty slots counts as a price of zero, as in the
    reference; without it, a warm-up uses the prices there are.
    """
    order = chunks.window("symbol", "seq")
    dealt = chunks.with_guests(ticks.select("symbol", "seq", "cents"), "symbol", "seq", RING - 1, ["cents"], rows)
    n = F.least(F.row_number().over(order), F.lit(RING)).cast("long")
    seen = chunks.own(_sums(dealt.withColumn("n", n), order, 0))
    slots = F.col("n") + F.when((F.col("n") > 1) & (F.col("n") < RING), 1).otherwise(0) if zero_slot else F.col("n")
    sigma = F.when(F.col("n") == 1, LEAST_SIGMA).otherwise(_sigma(slots, F.col("s1"), F.col("s2"), scale))
    return seen.select("symbol", "seq", "n", sigma.alias("sigma"))


def quoting_sigma(ticks: DataFrame, live: bool = True, scale: float = 100.0, by_symbol: bool = False, rows: int | None = None) -> DataFrame:
    """The deviation a quoter knows at each of its steps, from the prices before it.

    A live quoter observes the first tick at its start and once more at its first step. A replay consumes the first
    tick at its start, so that its steps begin with the second, and no tick counts twice. ``by_symbol``: a symbol's
    rows stay together in order, for a fold to read; otherwise they are dealt in chunks.
    """
    if by_symbol:
        order = Window.partitionBy("symbol").orderBy("seq")
        dealt = ticks
    else:
        order = chunks.window("symbol", "seq")
        dealt = chunks.with_guests(ticks, "symbol", "seq", RING, ["cents"], rows)
    # with RING guests, the number and first price in a chunk are the symbol's own wherever the ring is not full
    first = F.first("cents").over(order.rowsBetween(Window.unboundedPreceding, 0))
    summed = _sums(dealt.withColumns({"__k": F.row_number().over(order), "__first": first}), order, 1)
    known = summed if by_symbol else chunks.own(summed)
    k = F.col("__k")
    if live:
        observed = k
        twice = F.when(k <= RING, F.col("__first")).otherwise(0).cast("decimal(19,0)")
        s1, s2 = F.col("s1") + twice, F.col("s2") + twice * twice
    else:
        known, observed, s1, s2 = known.filter(k > 1), k - 1, F.col("s1"), F.col("s2")
    slots = F.when(observed < RING, observed + 1).otherwise(RING)
    sigma = F.when(observed == 1, LEAST_SIGMA).otherwise(_sigma(slots, s1, s2, scale))
    return known.withColumn("sigma", sigma).drop("__k", "__first", "s1", "s2")


def replay_ticks(messages: DataFrame, rows: int | None = None) -> DataFrame:
    """Runs of equal timestamps in file order: adds ``tick``, from 1, by symbol.

    Runs are counted in each chunk; a chunk that begins with the timestamp the one before it ended with goes on its run.
    """
    order = chunks.window("symbol", "seq")
    new = F.when(F.col("timestamp") == F.lag("timestamp").over(order), 0).otherwise(1)
    dealt = messages.withColumn(chunks.CHUNK, chunks.chunk_of("seq", rows or chunks.ROWS)).withColumn("__new", new)
    local = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy("symbol", chunks.CHUNK).agg(F.sum("__new").alias("__n"), F.min_by("timestamp", "seq").alias("__first"), F.max_by("timestamp", "seq").alias("__last"))
    in_order = Window.partitionBy("symbol").orderBy(chunks.CHUNK)
    joins = F.when(F.col("__first") == F.lag("__last").over(in_order), 1).otherwise(0)
    ends = ends.withColumn("__joins", joins)
    base = F.coalesce(F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("__joins").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    bases = ends.select(F.col("symbol").alias("__of"), F.col(chunks.CHUNK).alias("__in"), base.alias("__base"))
    found = dealt.join(bases, F.col("symbol").eqNullSafe(F.col("__of")) & F.col(chunks.CHUNK).eqNullSafe(F.col("__in")))
    return found.withColumn("tick", local + F.col("__base")).drop("__new", "__base", "__of", "__in", chunks.CHUNK)


def normalized(ticks: DataFrame, clip: float = 10.0, least: float = 1e-8, rows: int | None = None) -> DataFrame:
    """symbol, seq, z: prices by their running mean and deviation, cut at ``clip``, from exact sums."""
    units = F.col("cents").cast("decimal(19,0)")
    sums = {"n": F.lit(1), "s1": units.cast(WIDE), "s2": (units * units).cast(WIDE)}
    seen = chunks.running(ticks.select("symbol", "seq", "cents"), "symbol", "seq", sums, rows)
    n = F.col("n").cast("double")
    whole = F.col("n").cast("decimal(10,0)") * F.col("s2").cast("decimal(28,0)") - F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)")
    z = (F.col("cents") - F.col("s1").cast("double") / n) / F.sqrt(F.greatest(whole.cast("double") / (n * n), F.lit(least)))
    return seen.select("symbol", "seq", F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)).alias("z"))


def conflate(ticks: DataFrame, millis: int) -> DataFrame:
    """The newest tick of every symbol and slot of time, as a consumer with a one-tick slot would see."""
    return last_by(ticks, [F.col("symbol"), F.floor(F.col("ts_ms") / millis)], "seq")


def klines_to_messages(klines: DataFrame, step: int = 15, first_id: int = 1000) -> DataFrame:
    """Each candle's open, high, low and close as an add and, ``step`` later, an execute of a fresh id.

    Ids and sides follow from the candle's number ``n``, so that every run gives the same messages.
    """
    prices = F.posexplode(F.array("open", "high", "low", "close")).alias("leg", "at_price")
    legs = klines.select("symbol", "n", "time", "volume", prices).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("executed"))
    place = (F.col("n") * 8 + F.col("leg") * 2).cast("long")
    order_id = F.lit(first_id) + place + F.col("executed")
    pair = F.lit(first_id) + place
    side = (F.floor(pair * 7919 / 16) % 2).cast("int")
    time = F.col("time") * 1000 + (F.col("leg") + F.col("executed")) * step
    qty = F.greatest(F.lit(1), (F.when(F.col("volume") > 0, F.col("volume") / 4).otherwise(0.1) * 10000).cast("long"))
    return legs.select(
        "symbol", (place + F.col("executed")).alias("seq"), time.alias("timestamp"), F.when(F.col("executed") == 1, 3).otherwise(1).alias("type"),
        order_id.alias("order_id"), side.alias("side"), F.col("at_price").cast("long").alias("price"), qty.alias("qty"),
    )


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carry: list[str], rows: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides go through one window by key and chunk of time, so that rows are sorted and read once and nothing is
    paired. The last right row before a chunk comes from a table of a row a chunk.
    """
    width = rows or ASOF_WIDTH
    carried = right.select(F.struct(*carry)).schema[0].dataType
    mine = left.select(F.col(key).alias("__key"), F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(carried).alias("__r"))
    theirs = right.select(F.col(key), F.col(right_time), F.lit(0), F.lit(None).cast(mine.schema["__l"].dataType), F.struct(*carry))
    both = mine.union(theirs).withColumn(chunks.CHUNK, chunks.chunk_of("__time", width))
    ends = both.groupBy("__key", chunks.CHUNK).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col("__time"))).alias("__end"))
    before = Window.partitionBy("__key").orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(F.col("__key").alias("__of"), F.col(chunks.CHUNK).alias("__in"), F.last("__end", ignorenulls=True).over(before).alias("__base"))
    w = Window.partitionBy("__key", chunks.CHUNK).orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.join(bases, F.col("__key").eqNullSafe(F.col("__of")) & F.col(chunks.CHUNK).eqNullSafe(F.col("__in")))
    found = dealt.withColumn("__found", F.coalesce(F.last("__r", ignorenulls=True).over(w), "__base")).filter("__side = 1")
    return found.select("__l.*", *[F.col(f"__found.{c}").alias(c) for c in carry])


def controlled(ticks: DataFrame, control: DataFrame) -> DataFrame:
    """Ticks with ``is_quoting``, the last toggle of their symbol at or before them; quoting before the first.

    ``control``: symbol, at_ms, is_quoting.
    """
    found = asof(ticks, control, "symbol", "ts_ms", "at_ms", ["is_quoting"])
    return found.withColumn("is_quoting", F.coalesce("is_quoting", F.lit(True)))
