"""Joins of intervals: which overlap, and first-in-first-out lots as overlaps of cumulative quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunks

#: Rows of the left side in one bucket and task of an overlap join; buckets with more are dealt to several.
HOT = 50_000
#: Units of cumulative quantity in a chunk of the lot matching.
LOTS = 1_000_000


def overlapping(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int, hot: int = HOT) -> DataFrame:
    """Pairs of rows of one key whose half-open spans [from, to) overlap: the columns of both sides (the key once).

    Time is cut into buckets of ``width``. Each row is put in every bucket that its span touches, so that an equi-join by key and bucket finds all pairs;
    a pair that shares several buckets counts in the first of them only. A bucket with more than ``hot`` left rows is
    dealt by row over as many tasks as that takes, and its right rows go to each. Choose a width of about a usual span: a shorter one repeats rows, a longer one
    compares rows that don't meet. Empty spans (to <= from) overlap nothing, nor do rows without a key or bound.
    """

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        first, last = F.floor(F.col(span[0]) / width), F.floor((F.col(span[1]) - 1) / width)
        rows = df.filter(F.col(span[0]) < F.col(span[1])).select(F.col(key).alias("__key"), F.struct(*df.columns).alias(name), F.col(span[0]).alias(f"{name}_from"), F.col(span[1]).alias(f"{name}_to"), first.alias(f"{name}_first"), last.alias("__last"))
        return rows.withColumn("__bucket", F.explode(F.sequence(f"{name}_first", "__last"))).drop("__last")

    mine, theirs = dealt(left, left_span, "__l"), dealt(right, right_span, "__r")
    # a row a bucket that is too large, none as a rule
    sizes = mine.groupBy("__key", "__bucket").agg(F.count("*").alias("__n")).filter(F.col("__n") > hot)
    sizes = sizes.select("__key", "__bucket", F.ceil(F.col("__n") / hot).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    mine = mine.join(sizes, ["__key", "__bucket"], "left").withColumn("__part", F.pmod(F.xxhash64("__l"), parts)).drop("__parts")
    theirs = theirs.join(sizes, ["__key", "__bucket"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("__parts")
    met = mine.join(theirs, ["__key", "__bucket", "__part"])
    met = met.filter((F.col("__l_from") < F.col("__r_to")) & (F.col("__r_from") < F.col("__l_to")) & (F.col("__bucket") == F.greatest("__l_first", "__r_first")))
    return met.select("__l.*", *[F.col(f"__r.`{c}`").alias(c) for c in right.columns if c != key])


def fifo_lots(trades: DataFrame, rows: int | None = None, lots: int | None = None) -> DataFrame:
    """Which bought units were sold to which sale, first in first out: symbol, buy_seq, sell_seq, qty, buy_cents, sell_cents.

    ``trades``: symbol, seq, is_buy, qty (whole units), cents. The k-th unit bought meets the k-th unit sold, whichever came first: a sale before its
    purchase is a short position that the purchase closes. A trade is an interval of its side's cumulative quantity (prefix sums by chunk of seq), and a lot is the overlap of a
    purchase and a sale. Overlaps come from a sweep, not from pairing: intervals are cut at every ``LOTS`` units, and within a chunk the bounds of
    both sides in order give each stretch its purchase and its sale. There are fewer lots than trades and cuts. What one side has not
    met is open and gives none; trades of no quantity neither.
    """
    lots = lots or LOTS
    side = trades.filter("qty > 0").select("symbol", "seq", "is_buy", F.col("qty").cast("long").alias("qty"), "cents")
    summed = chunks.running(
        side.withColumns({"__b": F.when(F.col("is_buy"), F.col("qty")).otherwise(0), "__s": F.when(F.col("is_buy"), 0).otherwise(F.col("qty"))}),
        "symbol", "seq", {"__bought": F.col("__b").cast("decimal(38,0)"), "__sold": F.col("__s").cast("decimal(38,0)")}, rows,
    )
    to = F.when(F.col("is_buy"), F.col("__bought")).otherwise(F.col("__sold")).cast("long")
    spans = summed.select("symbol", "seq", "is_buy", "cents", (to - F.col("qty")).alias("from"), to.alias("to"))
    nth = F.explode(F.sequence(F.floor(F.col("from") / lots), F.floor((F.col("to") - 1) / lots)))
    cut = spans.withColumn("nth", nth).withColumns({"from": F.greatest("from", F.col("nth") * lots), "to": F.least("to", (F.col("nth") + 1) * lots)})
    order = Window.partitionBy("symbol", "nth").orderBy("from", "is_buy")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct("seq", "cents", "to")
    swept = cut.withColumns({
        "buy": F.last(F.when(F.col("is_buy"), row), ignorenulls=True).over(upto), "sell": F.last(F.when(~F.col("is_buy"), row), ignorenulls=True).over(upto),
        "next": F.coalesce(F.lead("from").over(order), (F.col("nth") + 1) * lots),
    })
    # a side is one gapless row of intervals, so the last that began covers a stretch unless the side has ended
    stop = F.least("next", "buy.to", "sell.to")
    met = swept.withColumn("qty", stop - F.col("from")).filter("buy is not null and sell is not null and qty > 0")
    # a lot that a cut has parted is one lot
    return met.groupBy("symbol", F.col("buy.seq").alias("buy_seq"), F.col("sell.seq").alias("sell_seq")).agg(F.sum("qty").alias("qty"), F.max("buy.cents").alias("buy_cents"), F.max("sell.cents").alias("sell_cents"))


def realized(lots: DataFrame) -> DataFrame:
    """What each closing trade has earned: symbol, seq, qty closed, pnl (in cents times units), is_win."""
    closes = lots.select("symbol", F.greatest("buy_seq", "sell_seq").alias("seq"), "qty", (F.col("qty") * (F.col("sell_cents") - F.col("buy_cents"))).alias("pnl"))
    return closes.groupBy("symbol", "seq").agg(F.sum("qty").alias("qty"), F.sum("pnl").alias("pnl")).withColumn("is_win", F.col("pnl") > 0)
