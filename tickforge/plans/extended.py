"""Queries over feeds, streams with state, stores that are kept up to date, intervals, sketches and SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import table as table_functions
from tickforge.operators import intervals, series, sketches
from tickforge.plans import oracle as sql
from tickforge.plans.catalog import ORACLE, query
from tickforge.sources import feed
from tickforge.sources import tables as t
from tickforge.streaming import control, live, sinks

# Paged feeds


def _recorded_trades(spark: SparkSession, d: str) -> str:
    """A recording of the ticks as a feed of trades; its folder."""
    folder = f"{live.folder(spark)}/trades"
    feed.record(t.ticks(spark, d), F.col("seq"), feed.trade_record(), folder, 1000)
    return folder


@query("paged_last_trades", f"WITH {sql.TICKS} SELECT symbol, seq, ts_ms, price, volume, is_buyer_maker FROM ticks QUALIFY seq >= max(seq) OVER (PARTITION BY symbol) - 4000")
def paged_last_trades(spark, d):
    """The newest trades of every symbol, fetched page by page from 4,000 ids before the last."""
    rows = feed.opened(spark, _recorded_trades(spark, d), limit=500, last=4000, keys_per_task=1000)
    return rows.select("symbol", F.col("a").alias("seq"), F.col("T").alias("ts_ms"), F.col("p").alias("price"), F.col("q").alias("volume"), F.col("m").alias("is_buyer_maker"))


@query("paged_kline_range", f"WITH {sql.RAW}, {sql.candles(1800)} SELECT * FROM candles WHERE time >= 1704412800 AND time <= 1705276800")
def paged_kline_range(spark, d):
    """Candles of a range of days: the conditions on the open time narrow the pages that are fetched."""
    folder = f"{live.folder(spark)}/klines"
    feed.record(series.candles(t.raw_ticks(spark, d), 1800), F.col("time") * 1000, feed.candle_record(), folder, 100 * 1_800_000)
    rows = feed.opened(spark, folder, kind="candles", limit=100, pushdown=True).filter("open_ms >= 1704412800000 and open_ms <= 1705276800000")
    return rows.select("symbol", (F.col("open_ms") / 1000).cast("long").alias("time"), "open", "high", "low", "close", "volume")


@query("stream_paged_trades", f"WITH {sql.TICKS} SELECT symbol, seq, ts_ms, price FROM ticks")
def stream_paged_trades(spark, d):
    """The feed followed as a stream, an offset a symbol."""
    rows = feed.followed(spark, _recorded_trades(spark, d), limit=500, keys_per_task=20_000)
    return live.run_to_table(rows.select("symbol", F.col("a").alias("seq"), F.col("T").alias("ts_ms"), F.col("p").alias("price")))


# Streams with state


def _arriving(ticks: DataFrame, late: F.Column, batches: int = 6) -> DataFrame:
    """Ticks as a stream in the order of their arrival, ``late`` ms after their time."""
    least, most = ticks.select((F.col("ts_ms") + late).alias("a")).agg(F.min("a"), F.max("a")).first()
    return live.arrivals(ticks, F.floor((F.col("ts_ms") + late - least) * batches / (most - least + 1)), batches)


#: Every tenth tick arrives two hours late, which the delay of three hours allows; every 97th twelve days late, which it doesn't.
def _late(very: bool = False) -> F.Column:
    late = F.when(F.col("seq") % 10 == 0, 7_200_000).otherwise(0)
    return F.when(F.col("seq") % 97 == 0, 1_036_800_000).otherwise(late) if very else late


ARRIVED = f"""{sql.TICKS}, late AS (SELECT *, ts_ms + CASE WHEN seq % 97 = 0 THEN 1036800000 WHEN seq % 10 = 0 THEN 7200000 ELSE 0 END AS arrival FROM ticks),
dealt AS (SELECT *, (arrival - min(arrival) OVER ()) * 6 // (max(arrival) OVER () - min(arrival) OVER () + 1) AS batch FROM late),
newest AS (SELECT b.batch, max(d.ts_ms) - 10800000 AS mark FROM (SELECT unnest(range(8)) AS batch) b JOIN dealt d ON d.batch < b.batch GROUP BY b.batch)"""


@query("stream_sessions", f"""WITH {ARRIVED}, came AS (SELECT d.* FROM dealt d LEFT JOIN newest m ON m.batch = d.batch - 1 WHERE m.mark IS NULL OR ts_ms + 1200000 > m.mark),
fresh AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, seq) < 1200000 THEN 0 ELSE 1 END AS new FROM came),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts_ms, seq) AS session FROM fresh)
SELECT symbol, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n, CAST(sum(lots) AS BIGINT) AS lots FROM s GROUP BY symbol, session HAVING max(ts_ms) + 1200000 <= (SELECT mark FROM newest WHERE batch = 7)""")
def stream_sessions(spark, d):
    """Sessions over a stream with late ticks: a late tick between two sessions joins them in the state store, one that is too late is dropped."""
    return live.run_to_table(live.sessions(_arriving(t.ticks(spark, d), _late(very=True))))


def _toggles(ticks: DataFrame) -> DataFrame:
    """Quoting goes off at the start of every eighth hour, and on at its end."""
    hour = 3_600_000
    spans = ticks.groupBy("symbol").agg(F.floor(F.min("ts_ms") / (8 * hour)).alias("first"), F.floor(F.max("ts_ms") / (8 * hour)).alias("last"))
    offs = spans.select("symbol", F.explode(F.sequence("first", "last")).alias("nth")).withColumn("off", F.col("nth") * 8 * hour)
    toggle = lambda at, on: F.struct(at.alias("at_ms"), F.lit(on).alias("is_quoting"))
    return offs.select("symbol", F.inline(F.array(toggle(F.col("off"), False), toggle(F.col("off") + hour, True))))


def _steered(spark: SparkSession, d: str) -> str:
    """Runs the control stream beside the tick stream; its folder (rows, log)."""
    ticks = t.ticks(spark, d)
    least, most = ticks.select((F.col("ts_ms") + _late()).alias("a")).agg(F.min("a"), F.max("a")).first()
    nth = F.floor((F.greatest(F.least(F.col("at_ms"), F.lit(most)), F.lit(least)) - least) * 6 / (most - least + 1))
    toggles = live.arrivals(_toggles(ticks), nth, 6)
    return live.run(control.steered(_arriving(ticks.select("symbol", "seq", "ts_ms", "price"), _late()), toggles))


#: What the watermark has passed at the end: three hours before the last tick or toggle.
PASSED = f"""{sql.TICKS}, toggles AS (SELECT symbol, unnest(range(min(ts_ms) // 28800000, max(ts_ms) // 28800000 + 1)) * 28800000 AS off FROM ticks GROUP BY symbol),
told AS (SELECT symbol, off AS at_ms FROM toggles UNION ALL SELECT symbol, off + 3600000 FROM toggles),
mark AS (SELECT greatest((SELECT max(ts_ms) FROM ticks), (SELECT max(at_ms) FROM told)) - 10800000 AS mark),
released AS (SELECT symbol, seq, ts_ms, price, ts_ms // 3600000 % 8 <> 0 AS is_quoting FROM ticks, mark WHERE ts_ms <= mark)"""


@query("stream_control", f"WITH {PASSED} SELECT * FROM released")
def stream_control(spark, d):
    """Every tick with the last toggle at or before it, ticks and toggles arriving out of order."""
    where = _steered(spark, d)
    return spark.read.schema(control.OUT).parquet(f"{where}/rows")


@query("state_status", f"""WITH {PASSED}, ahead AS (SELECT symbol, count(*) AS waiting FROM (SELECT symbol, ts_ms AS x FROM ticks UNION ALL SELECT symbol, at_ms FROM told), mark WHERE x > mark GROUP BY symbol)
SELECT r.symbol, r.seq, r.ts_ms, r.price, r.is_quoting, r.released, coalesce(waiting, 0) AS waiting
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS released FROM released QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) = 1) r LEFT JOIN ahead a ON a.symbol = r.symbol""")
def state_status(spark, d):
    """Where each symbol's stream stands, read from the state in its checkpoint."""
    return control.status(spark, f"{_steered(spark, d)}/log")


@query("state_chart", f"WITH {PASSED} SELECT symbol, seq, ts_ms, price, is_quoting FROM released QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, seq DESC) <= 500")
def state_chart(spark, d):
    """The points that a late subscriber gets, read from the state in the stream's checkpoint."""
    return control.chart(spark, f"{_steered(spark, d)}/log")


# Sinks


def _by_batch(stream: DataFrame, sink, mode: str = "append") -> None:
    where = live.folder(stream.sparkSession)
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start().awaitTermination()


def _failing(rows: DataFrame) -> DataFrame:
    raise ConnectionError("subscriber is gone")


@query("stream_fanout", f"""WITH {sql.TICKS} SELECT 'all' AS subscriber, symbol, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM ticks GROUP BY symbol
UNION ALL SELECT 'makers', symbol, count(*), CAST(sum(seq) AS BIGINT) FROM ticks WHERE is_buyer_maker GROUP BY symbol""")
def stream_fanout(spark, d):
    """One stream to three subscribers, one of which fails and is dropped without harm to the others."""
    folder, ticks = f"{live.folder(spark)}/sinks", t.ticks(spark, d).select("symbol", "seq", "ts_ms", "price", "is_buyer_maker")
    _by_batch(_arriving(ticks, _late(), 4), sinks.FanOut(folder, {"all": lambda x: x, "gone": _failing, "makers": lambda x: x.filter("is_buyer_maker")}))
    each = [sinks.table(spark, f"{folder}/{name}", "symbol string, seq long, ts_ms long, price double, is_buyer_maker boolean").withColumn("subscriber", F.lit(name)) for name in ("all", "gone", "makers")]
    return each[0].union(each[1]).union(each[2]).groupBy("subscriber", "symbol").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("stream_conflated", ORACLE["conflate_ticks"])
def stream_conflated(spark, d):
    """The newest tick of each symbol and hour, updated as ticks come and merged when read."""
    folder = f"{live.folder(spark)}/newest"
    ticks = t.ticks(spark, d).select("symbol", "seq", "ts_ms", "price")
    _by_batch(sinks.conflated(_arriving(ticks, _late()), 3_600_000), lambda rows, batch: sinks.written(rows, folder, batch), "update")
    return sinks.newest(spark, folder, ["symbol", "slot_ms"], "seq", "symbol string, slot_ms long, seq long, ts_ms long, price double").drop("slot_ms")


@query("candle_store", ORACLE["ohlcv_30m"])
def candle_store(spark, d):
    """Candles kept up to date by a stream's batches; the first ten days are compacted between two of them."""
    ticks = t.raw_ticks(spark, d).select("symbol", "seq", "ts_ms", "price", "lots")
    store = sinks.CandleStore(spark, f"{live.folder(spark)}/candles", 1800)
    early = F.col("day") < F.lit(19_733)

    def add(rows: DataFrame, batch: int) -> None:
        store.add(rows, batch)
        if batch in (2, 4):
            store.compact(early)

    _by_batch(_arriving(ticks, _late(very=True)), add)
    return store.read()


# Intervals


def _trades(spark, d) -> DataFrame:
    """Ticks as trades: the aggressor bought unless the buyer was the maker."""
    return t.ticks(spark, d).select("symbol", "seq", (~F.col("is_buyer_maker")).alias("is_buy"), F.col("lots").alias("qty"), "cents")


FIFO = f"""{sql.TICKS}, spans AS (SELECT symbol, seq, cents, is_buyer_maker AS sold, sum(lots) OVER (PARTITION BY symbol, is_buyer_maker ORDER BY seq) AS hi, lots FROM ticks WHERE lots > 0),
lots AS (SELECT b.symbol, b.seq AS buy_seq, s.seq AS sell_seq, CAST(least(b.hi, s.hi) - greatest(b.hi - b.lots, s.hi - s.lots) AS BIGINT) AS qty, b.cents AS buy_cents, s.cents AS sell_cents
    FROM spans b JOIN spans s ON b.symbol = s.symbol AND NOT b.sold AND s.sold AND b.hi - b.lots < s.hi AND s.hi - s.lots < b.hi)"""


@query("fifo_lots", f"WITH {FIFO} SELECT * FROM lots")
def fifo_lots(spark, d):
    return intervals.fifo_lots(_trades(spark, d))


@query("fifo_realized", f"""WITH {FIFO}, closed AS (SELECT symbol, greatest(buy_seq, sell_seq) AS seq, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(qty * (sell_cents - buy_cents)) AS BIGINT) AS pnl FROM lots GROUP BY ALL)
SELECT symbol, count(*) AS closes, CAST(sum(qty) AS BIGINT) AS qty, round(CAST(sum(pnl) AS BIGINT) / 10000.0e0, 4) AS pnl, round(100.0e0 * count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate FROM closed GROUP BY symbol""")
def fifo_realized(spark, d):
    """Realised profit of each symbol by first-in-first-out lots, and the share of closing trades that earned."""
    closes = intervals.realized(intervals.fifo_lots(_trades(spark, d)))
    wins = F.round(100.0 * F.count_if("is_win") / F.count("*"), 6)
    return closes.groupBy("symbol").agg(F.count("*").alias("closes"), F.sum("qty").alias("qty"), F.round(F.sum("pnl") / 10000.0, 4).alias("pnl"), wins.alias("win_rate"))


@query("candle_overlaps", f"""WITH {sql.RAW}, {sql.candles(7200)} SELECT r.symbol, r.seq, c.time, c.close FROM raw r JOIN candles c ON r.symbol = c.symbol AND r.ts_ms < (c.time + 7200) * 1000 AND c.time * 1000 < r.ts_ms + 900000""")
def candle_overlaps(spark, d):
    """Ticks that are valid for a quarter of an hour, with every two-hour candle that this time touches."""
    raw = t.raw_ticks(spark, d)
    valid = raw.select("symbol", "seq", "ts_ms", (F.col("ts_ms") + 900_000).alias("until_ms"))
    candles = series.candles(raw, 7200).select("symbol", "time", "close", (F.col("time") * 1000).alias("from_ms"), ((F.col("time") + 7200) * 1000).alias("to_ms"))
    return intervals.overlapping(valid, candles, "symbol", ("ts_ms", "until_ms"), ("from_ms", "to_ms"), 7_200_000).select("symbol", "seq", "time", "close")


# Sketches


def _users(spark, d) -> DataFrame:
    e = t.table(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", "value")


@query("sketch_rollup", """SELECT event_type AS symbol, epoch_us(ts) // 14400000000 * 14400 AS time, count(*) AS n, count(DISTINCT user_id) AS users,
    quantile_disc(value, 0.25) AS q25, quantile_disc(value, 0.5) AS q50, quantile_disc(value, 0.75) AS q75 FROM events GROUP BY ALL""")
def sketch_rollup(spark, d):
    """Users and price quantiles of four-hour candles from the stored tallies of half-hour ones, exact however many rows a candle has."""
    where, tallies = live.folder(spark), sketches.tallied(_users(spark, d), 1800, "user_id", "value")
    for name, tally in zip(("who", "prices"), tallies, strict=True):
        tally.write.parquet(f"{where}/{name}")
    return sketches.exact(*[sketches.widened(spark.read.parquet(f"{where}/{name}"), 14_400) for name in ("who", "prices")])


# SQL text


@query("sql_tick_runs", ORACLE["replay_ticks"])
def sql_tick_runs(spark, d):
    table_functions.open_sql(spark, d)
    return spark.sql(table_functions.TICK_RUNS)


@query("sql_rolling_vol", ORACLE["rolling_vol"])
def sql_rolling_vol(spark, d):
    table_functions.open_sql(spark, d)
    return spark.sql("SELECT symbol, seq, n, round(sigma, 6) AS sigma FROM rolling_sigma(TABLE(SELECT symbol, seq, cents FROM ticks) PARTITION BY symbol ORDER BY seq)")
