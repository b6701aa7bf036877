"""Queries of the engine by name, with the DuckDB SQL that gives the same rows.

A query without SQL is one whose state SQL can't carry (order books, streams); the tests hold those against
independent emulators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.functions import market as m
from tickforge.operators import chunks, folds, reports, series
from tickforge.plans import oracle as sql
from tickforge.sources import tables as t
from tickforge.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def r4(*columns: str) -> list:
    return [F.round(c, 4).alias(c) for c in columns]


# Sources and projections


@query("scan_messages", f"WITH {sql.MESSAGES} SELECT * FROM messages")
def scan_messages(spark, d):
    return t.messages(spark, d)


_NUMBERED = "seq - 1 AS seq, symbol, timestamp, type, order_id, side, price, qty"


def _csv_of(spark, d, folder: str, symbol: str, name: str) -> None:
    n = t.messages(spark, d).filter(F.col("symbol") == symbol).count()  # no number of theirs is computed for it
    t.write_messages_csv(t.messages(spark, d, by_symbol=False).filter(F.col("symbol") == symbol), f"{folder}/{name}.csv", n=n)


@query("csv_messages", f"WITH {sql.MESSAGES} SELECT {_NUMBERED} FROM messages WHERE seq > 1")
def csv_messages(spark, d):
    """Each symbol's messages written as CSV and read back; the first line is skipped, lines count from 0."""
    folder, out = live.folder(spark), None
    for (symbol,) in sorted(t.messages(spark, d).select("symbol").distinct().collect()):  # a row a symbol
        _csv_of(spark, d, folder, symbol, symbol)
        rows = t.read_messages_csv(spark, t.message_path(spark, folder, symbol), symbol)[0]
        out = rows if out is None else out.union(rows)
    return out


@query("csv_fallback", f"""WITH {sql.MESSAGES} SELECT {_NUMBERED} FROM messages WHERE symbol = 'R' AND seq > 1
UNION ALL SELECT seq - 1, 'N/O-NE', timestamp, type, order_id, side, price, qty FROM messages WHERE symbol = 'A' AND seq > 1""")
def csv_fallback(spark, d):
    """A symbol that has a file is read from it, one that has none from the fallback."""
    folder = live.folder(spark)
    _csv_of(spark, d, folder, "R", "R")
    _csv_of(spark, d, folder, "A", "test_data")
    found, none = (t.read_messages_csv(spark, t.message_path(spark, folder, s), s)[0] for s in ("R", "N/O-NE"))
    return found.union(none)


@query("message_type_counts", f"WITH {sql.MESSAGES} SELECT symbol, type, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM messages GROUP BY symbol, type")
def message_type_counts(spark, d):
    return t.messages(spark, d).groupBy("symbol", "type").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("replay_ticks", f"""WITH {sql.MESSAGES}, marked AS (
    SELECT *, CASE WHEN timestamp = lag(timestamp) OVER (PARTITION BY symbol ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM messages
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY seq) AS tick FROM marked)
SELECT symbol, CAST(tick AS BIGINT) AS tick, min(timestamp) AS timestamp, count(*) AS n, min(seq) AS first_seq FROM runs GROUP BY symbol, tick""")
def replay_ticks(spark, d):
    runs = series.replay_ticks(t.messages(spark, d))
    return runs.groupBy("symbol", "tick").agg(F.min("timestamp").alias("timestamp"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def _klines(spark, d):
    candles = series.candles(t.raw_ticks(spark, d), 1800)
    return chunks.numbered(candles, "symbol", "time", "n", rows=10_000 * 1800).withColumn("n", F.col("n") - 1)


@query("kline_range_scan", f"WITH {sql.RAW}, {sql.candles(1800)} SELECT * FROM candles WHERE time >= 1704412800 AND time <= 1705276800")
def kline_range_scan(spark, d):
    at = t.raw_ticks(spark, d).schema["at"].dataType
    day = lambda x: F.lit(x).cast(at)
    # whole candles by their ticks' own time, so that the scan skips what lies outside
    wanted = t.raw_ticks(spark, d).filter((F.col("at") >= day("2024-01-05 00:00:00")) & (F.col("at") < day("2024-01-15 00:30:00")))
    return series.candles(wanted, 1800)


@query("last_n_trades", f"WITH {sql.TICKS} SELECT seq, symbol, ts_ms, price, volume FROM ticks ORDER BY seq DESC LIMIT 400000")
def last_n_trades(spark, d):
    return t.ticks(spark, d).orderBy(F.desc("seq")).limit(400_000).select("seq", "symbol", "ts_ms", "price", "volume")


@query("kline_to_messages", f"""WITH {sql.RAW}, {sql.candles(1800)}, k AS (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS n FROM candles
), legs AS (
    SELECT symbol, n, time, volume, leg, CASE leg WHEN 0 THEN open WHEN 1 THEN high WHEN 2 THEN low ELSE close END AS p, executed
    FROM k, (SELECT unnest([0, 1, 2, 3]) AS leg), (SELECT unnest([0, 1]) AS executed))
SELECT symbol, n * 8 + leg * 2 + executed AS seq, time * 1000 + (leg + executed) * 15 AS timestamp, CASE executed WHEN 1 THEN 3 ELSE 1 END AS type,
    1000 + n * 8 + leg * 2 + executed AS order_id, CAST(floor((1000 + n * 8 + leg * 2) * 7919 / 16.0) AS BIGINT) % 2 AS side, CAST(trunc(p) AS BIGINT) AS price,
    greatest(1, CAST(trunc((CASE WHEN volume > 0 THEN volume / 4 ELSE 0.1e0 END) * 10000) AS BIGINT)) AS qty FROM legs""")
def kline_to_messages(spark, d):
    return series.klines_to_messages(_klines(spark, d))


@query("aggtrade_to_messages", f"""WITH {sql.TICKS} SELECT symbol, seq, ts_ms AS timestamp, 1 AS type, seq AS order_id, CASE WHEN is_buyer_maker THEN 1 ELSE 0 END AS side,
    CAST(round_even(price, 0) AS BIGINT) AS price, greatest(1, CAST(trunc(volume * 100) AS BIGINT)) AS qty FROM ticks""")
def aggtrade_to_messages(spark, d):
    side = m.aggressor(F.col("is_buyer_maker")).alias("side")
    return t.ticks(spark, d).select(
        "symbol", "seq", F.col("ts_ms").alias("timestamp"), F.lit(1).alias("type"), F.col("seq").alias("order_id"), side,
        m.whole_price(F.col("price")).alias("price"), m.trade_quantity(F.col("volume")).alias("qty"),
    )


@query("normalize_symbol", f"WITH {sql.REGISTRY} SELECT id, upper(regexp_replace(raw_symbol, '[/-]', '', 'g')) AS symbol, lower(regexp_replace(raw_symbol, '[/-]', '', 'g')) AS feed FROM registry")
def normalize_symbol(spark, d):
    raw = F.col("raw_symbol")
    return t.registry(spark, d).select("id", m.normalize_symbol(raw).alias("symbol"), m.feed_symbol(raw).alias("feed"))


@query("tick_scaling", f"""WITH {sql.TICKS} SELECT symbol, seq, CAST(round_even(price, 0) AS BIGINT) AS scaled_price,
    CASE WHEN volume < 1 THEN CAST(round_even(volume * 10000, 0) AS BIGINT) ELSE CAST(floor(volume) AS BIGINT) END AS scaled_volume FROM ticks""")
def tick_scaling(spark, d):
    return t.ticks(spark, d).select("symbol", "seq", m.whole_price(F.col("price")).alias("scaled_price"), m.whole_volume(F.col("volume")).alias("scaled_volume"))


@query("timeframe_map", "SELECT DISTINCT r AS asked, CASE r WHEN '2h' THEN '2h' WHEN '4h' THEN '4h' WHEN '5h' THEN '4h' ELSE '30m' END AS timeframe FROM (SELECT (o_orderkey % 6) || 'h' AS r FROM orders)")
def timeframe_map(spark, d):
    asked = F.concat((F.col("o_orderkey") % 6).cast("string"), F.lit("h")).alias("asked")
    return t.table(spark, d, "orders").select(asked).distinct().select("asked", m.timeframe(F.col("asked")).alias("timeframe"))


@query("close_line", f"WITH {sql.RAW}, {sql.candles(1800)} SELECT symbol, time, close AS value FROM candles")
def close_line(spark, d):
    return series.candles(t.raw_ticks(spark, d), 1800).select("symbol", "time", F.col("close").alias("value"))


@query("training_progress", """SELECT event_id AS n, round(least(100.0e0 * event_id / (SELECT count(*) FROM events), 100.0e0), 2) AS percent FROM events WHERE event_id > 0 AND event_id % 1024 = 0""")
def training_progress(spark, d):
    """Share of the recorded ticks that a run over them has done at every 1,024th."""
    steps = t.ticks(spark, d).select(F.col("seq").alias("n"))
    return steps.filter("n > 0 and n % 1024 = 0").select("n", F.round(F.least(100.0 * F.col("n") / steps.count(), F.lit(100.0)), 2).alias("percent"))


@query("policy_constant", f"WITH {sql.TICKS} SELECT symbol, seq, CASE WHEN seq % 7 = 0 THEN 0.5e0 ELSE 0.1e0 END AS gamma, CASE WHEN seq % 7 = 0 THEN 10.0e0 ELSE 1.0e0 END AS spread FROM ticks")
def policy_constant(spark, d):
    """The fixed action while quotes are out (here every seventh tick), the policy's otherwise."""
    out = F.col("seq") % 7 == 0
    return t.ticks(spark, d).select("symbol", "seq", F.when(out, 0.5).otherwise(m.DEFAULT_GAMMA).alias("gamma"), F.when(out, 10.0).otherwise(m.DEFAULT_SPREAD).alias("spread"))


# Quoting formulas


def _quoted(spark, d):
    rows = series.quoting_sigma(t.ticks(spark, d))
    mid, sigma, kappa, one = F.col("price"), F.col("sigma"), F.lit(m.DEFAULT_KAPPA), F.lit(m.DEFAULT_SPREAD)
    inventory = ((F.col("seq") % 21) - 10) / 2.0
    gamma = m.scaled_gamma(F.lit(m.DEFAULT_GAMMA), mid)
    spread = m.optimal_spread(sigma, gamma, kappa, one)
    return rows.withColumns({"half": spread / 2, "reservation": m.reservation(mid, inventory, gamma, sigma)})


@query("as_quotes", f"WITH {sql.QUOTED} SELECT symbol, seq, round(reservation - half, 4) AS bid, round(reservation + half, 4) AS ask, round(reservation, 4) AS reservation FROM quoted")
def as_quotes(spark, d):
    rows = _quoted(spark, d)
    pick = lambda c, n: F.round(c, 4).alias(n)
    return rows.select("symbol", "seq", pick(F.col("reservation") - F.col("half"), "bid"), pick(F.col("reservation") + F.col("half"), "ask"), pick(F.col("reservation"), "reservation"))


@query("clamped_quotes", f"""WITH {sql.QUOTED}, c AS (SELECT *, least(greatest(half, price * 0.00003e0), price * 0.0001e0) AS h FROM quoted)
SELECT symbol, seq, round(price - h, 4) AS bid, round(price + h, 4) AS ask FROM c""")
def clamped_quotes(spark, d):
    rows = _quoted(spark, d).withColumn("h", m.clamp_half(F.col("half"), F.col("price")))
    return rows.select("symbol", "seq", F.round(F.col("price") - F.col("h"), 4).alias("bid"), F.round(F.col("price") + F.col("h"), 4).alias("ask"))


@query("trade_sizing", f"""WITH {sql.QUOTED} SELECT symbol, seq, round(0.5e0 * least(greatest(greatest(price * 0.005e0, 0.01e0) / greatest(sigma, 0.01e0), 0.2e0), 1.0e0), 6) AS size FROM quoted""")
def trade_sizing(spark, d):
    return series.quoting_sigma(t.ticks(spark, d)).select("symbol", "seq", F.round(m.trade_size(F.lit(0.5), F.col("price"), F.col("sigma")), 6).alias("size"))


@query("live_obi", f"""WITH {sql.TICKS}, s AS (SELECT symbol, seq, is_buyer_maker AS mk, CAST(round_even(price, 0) AS BIGINT) AS p,
    CASE WHEN volume < 1 THEN CAST(round_even(volume * 10000, 0) AS BIGINT) ELSE CAST(floor(volume) AS BIGINT) END AS v FROM ticks),
b AS (SELECT *, CASE WHEN mk THEN greatest(p - 1, 0) ELSE p END AS bid, CASE WHEN mk THEN p + 1 ELSE p + 2 END AS ask, CASE WHEN mk THEN v ELSE 2 * v END AS bv, CASE WHEN mk THEN 2 * v ELSE v END AS av FROM s)
SELECT symbol, seq, bid AS best_bid, ask AS best_ask, bv AS bid_volume, av AS ask_volume, CASE WHEN bv + av = 0 THEN 0.0e0 ELSE (bv - av) / CAST(bv + av AS DOUBLE) END AS obi FROM b""")
def live_obi(spark, d):
    rows = t.ticks(spark, d).select("symbol", "seq", *[c.alias(n) for n, c in m.live_depth(m.whole_price(F.col("price")), m.whole_volume(F.col("volume")), F.col("is_buyer_maker")).items()])
    return rows.withColumn("obi", m.imbalance(F.col("bid_volume"), F.col("ask_volume")))


@query("live_mid", f"""WITH {sql.TICKS}, s AS (SELECT symbol, seq, is_buyer_maker AS mk, CAST(round_even(price, 0) AS BIGINT) AS p FROM ticks)
SELECT symbol, seq, (CASE WHEN mk THEN greatest(p - 1, 0) ELSE p END + CASE WHEN mk THEN p + 1 ELSE p + 2 END) / 2.0e0 AS mid FROM s""")
def live_mid(spark, d):
    """Middle price of the depth that each live tick leaves."""
    depth = m.live_depth(m.whole_price(F.col("price")), m.whole_volume(F.col("volume")), F.col("is_buyer_maker"))
    return t.ticks(spark, d).select("symbol", "seq", m.mid_price(depth["best_bid"], depth["best_ask"]).alias("mid"))


# Series


for _name, _seconds in (("ohlcv_30m", 1800), ("ohlcv_2h", 7200), ("ohlcv_4h", 14400)):
    query(_name, f"WITH {sql.RAW}, {sql.candles(_seconds)} SELECT * FROM candles")(lambda spark, d, s=_seconds: series.candles(t.raw_ticks(spark, d), s))


@query("ohlcv_last_500", f"WITH {sql.RAW}, {sql.candles(1800)} SELECT symbol, time, open, high, low, close, volume FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 500")
def ohlcv_last_500(spark, d):
    return series.newest(series.candles(t.raw_ticks(spark, d), 1800), ["symbol"], ["time"], 500)


@query("rolling_vol", f"WITH {sql.TICKS}, {sql.rolling(True)} SELECT symbol, seq, n, round(sigma, 6) AS sigma FROM vol")
def rolling_vol(spark, d):
    return series.rolling_volatility(t.ticks(spark, d)).withColumn("sigma", F.round("sigma", 6))


@query("rolling_vol_clean", f"WITH {sql.TICKS}, {sql.rolling(False)} SELECT symbol, seq, n, round(sigma, 6) AS sigma FROM vol")
def rolling_vol_clean(spark, d):
    return series.rolling_volatility(t.ticks(spark, d), zero_slot=False).withColumn("sigma", F.round("sigma", 6))


@query("last_per_second", f"WITH {sql.TICKS} SELECT symbol, ts_ms // 1000 AS time, arg_max(price, seq) AS value FROM ticks GROUP BY symbol, ts_ms // 1000")
def last_per_second(spark, d):
    rows = series.last_by(t.ticks(spark, d), [F.col("symbol"), F.floor(F.col("ts_ms") / 1000)], "seq")
    return rows.select("symbol", F.floor(F.col("ts_ms") / 1000).alias("time"), F.col("price").alias("value"))


@query("conflate_ticks", f"WITH {sql.TICKS} SELECT symbol, max(seq) AS seq, arg_max(ts_ms, seq) AS ts_ms, arg_max(price, seq) AS price FROM ticks GROUP BY symbol, ts_ms // 3600000")
def conflate_ticks(spark, d):
    return series.conflate(t.ticks(spark, d), 3_600_000).select("symbol", "seq", "ts_ms", "price")


@query("chart_tail", f"WITH {sql.TICKS} SELECT symbol, seq, ts_ms, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 500")
def chart_tail(spark, d):
    return series.newest(t.ticks(spark, d), ["symbol"], ["seq"], 500).select("symbol", "seq", "ts_ms", "price")


# Windows, joins and groupings beyond the reference


@query("tumbling_volume", f"WITH {sql.TICKS} SELECT symbol, ts_ms // 21600000 * 21600 AS start, count(*) AS n, CAST(sum(lots) AS BIGINT) AS lots FROM ticks GROUP BY ALL")
def tumbling_volume(spark, d):
    rows = live.late_safe(t.ticks(spark, d)).groupBy("symbol", F.window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("lots").alias("lots"))
    return rows.select("symbol", F.unix_seconds("w.start").alias("start"), "n", "lots")


@query("sliding_vwap", f"""WITH {sql.TICKS} SELECT symbol, (ts_ms // 3600000 - o) * 3600 AS start, round(CAST(sum(cents * lots) AS DOUBLE) / CAST(nullif(sum(lots), 0) AS DOUBLE) / 100, 4) AS vwap
FROM ticks, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS o) GROUP BY ALL""")
def sliding_vwap(spark, d):
    rows = live.late_safe(t.ticks(spark, d)).groupBy("symbol", F.window("at", "6 hours", "1 hour").alias("w")).agg(F.round(F.try_divide(F.sum(F.col("cents") * F.col("lots")), F.sum("lots")) / 100, 4).alias("vwap"))
    return rows.select("symbol", F.unix_seconds("w.start").alias("start"), "vwap")


@query("session_activity", f"""WITH {sql.TICKS}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY seq) < 1200000 THEN 0 ELSE 1 END AS fresh FROM ticks),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY seq) AS session FROM g)
SELECT symbol, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n FROM s GROUP BY symbol, session""")
def session_activity(spark, d):
    rows = live.late_safe(t.ticks(spark, d)).groupBy("symbol", F.session_window("at", "20 minutes").alias("w")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))
    return rows.select("symbol", "start_ms", "last_ms", "n")


@query("volume_rollup", f"WITH {sql.TICKS} SELECT symbol, is_buyer_maker, count(*) AS n, CAST(sum(lots) AS BIGINT) AS lots FROM ticks GROUP BY ROLLUP (symbol, is_buyer_maker)")
def volume_rollup(spark, d):
    return t.ticks(spark, d).rollup("symbol", "is_buyer_maker").agg(F.count("*").alias("n"), F.sum("lots").alias("lots"))


@query("asof_quotes", f"""WITH {sql.RAW}, {sql.candles(1800)}, c AS (SELECT symbol, (time + 1800) * 1000 AS done_ms, close FROM candles)
SELECT r.symbol, r.seq, r.ts_ms, c.close AS last_close FROM raw r ASOF LEFT JOIN c ON r.symbol = c.symbol AND r.ts_ms >= c.done_ms""")
def asof_quotes(spark, d):
    """Each tick with the close of the last candle that was complete."""
    raw = t.raw_ticks(spark, d)
    done = series.candles(raw, 1800).select("symbol", ((F.col("time") + 1800) * 1000).alias("done_ms"), F.col("close").alias("last_close"))
    return series.asof(raw.select("symbol", "seq", "ts_ms"), done, "symbol", "ts_ms", "done_ms", ["last_close"])


# Registry


@query("registry_by_symbol", f"WITH {sql.REGISTRY} SELECT id, upper(regexp_replace(raw_symbol, '[/-]', '', 'g')) AS symbol, model_filename, hyperparameters, created_at FROM registry WHERE upper(regexp_replace(raw_symbol, '[/-]', '', 'g')) = 'C7USDT'")
def registry_by_symbol(spark, d):
    rows = t.registry(spark, d).withColumn("symbol", m.normalize_symbol(F.col("raw_symbol"))).filter(F.col("symbol") == "C7USDT")
    return rows.select("id", "symbol", "model_filename", "hyperparameters", "created_at")


@query("latest_model", f"WITH {sql.REGISTRY}, {sql.LATEST} SELECT symbol, id, model_filename, created_at FROM latest")
def latest_model(spark, d):
    return reports.latest_model(t.registry(spark, d)).select("symbol", "id", "model_filename", "created_at")


def _symbols(spark, d):
    n = t.table(spark, d, "nation")
    symbol = F.concat(F.lit("C"), F.col("n_nationkey").cast("string"), F.lit("USDT"))
    sidecar = F.concat(F.lit('{"max_inventory": '), (F.col("n_nationkey") % 5 + 1).cast("string"), F.lit('.0, "kappa": 2.5}'))
    return n.select(symbol.alias("symbol"), F.when(F.col("n_nationkey") % 3 == 0, sidecar).alias("sidecar"))


@query("resolve_hyperparams", f"""WITH {sql.REGISTRY}, {sql.LATEST}, {sql.SYMBOLS}
SELECT s.symbol, coalesce(CASE WHEN l.id IS NOT NULL THEN {sql.number('l.hyperparameters', 'max_inventory')} ELSE {sql.number('s.sidecar', 'max_inventory')} END, 10.0e0) AS max_inventory,
    coalesce(CASE WHEN l.id IS NOT NULL THEN {sql.number('l.hyperparameters', 'base_trade_size')} ELSE {sql.number('s.sidecar', 'base_trade_size')} END, 0.5e0) AS base_trade_size,
    coalesce(CASE WHEN l.id IS NOT NULL THEN {sql.number('l.hyperparameters', 'kappa')} ELSE {sql.number('s.sidecar', 'kappa')} END, 1.5e0) AS kappa,
    CASE WHEN l.id IS NOT NULL THEN 'registry' WHEN s.sidecar IS NOT NULL THEN 'sidecar' ELSE 'default' END AS origin
FROM symbols s LEFT JOIN latest l ON s.symbol = l.symbol""")
def resolve_hyperparams(spark, d):
    symbols = _symbols(spark, d)
    return reports.resolve(symbols.select("symbol"), t.registry(spark, d), symbols)


@query("sidecar_params", f"""WITH {sql.SYMBOLS} SELECT symbol, {sql.number('sidecar', 'max_inventory')} AS max_inventory, {sql.number('sidecar', 'base_trade_size')} AS base_trade_size, {sql.number('sidecar', 'kappa')} AS kappa
FROM symbols WHERE sidecar IS NOT NULL""")
def sidecar_params(spark, d):
    """Hyperparameters from the JSON files that lie beside the models' own, one a symbol."""
    folder = live.folder(spark)
    _symbols(spark, d).filter("sidecar is not null").select("symbol", F.col("sidecar").alias("value")).write.partitionBy("symbol").text(folder)
    return t.read_sidecar(spark, folder).select("symbol", "max_inventory", "base_trade_size", "kappa")


@query("display_params", f"""WITH {sql.REGISTRY}, {sql.LATEST}, {sql.SYMBOLS}
SELECT s.symbol, coalesce({sql.number('s.sidecar', 'max_inventory')}, {sql.number('l.hyperparameters', 'max_inventory')}, 10.0e0) AS max_inventory,
    coalesce({sql.number('s.sidecar', 'kappa')}, {sql.number('l.hyperparameters', 'kappa')}, 1.5e0) AS kappa FROM symbols s LEFT JOIN latest l ON s.symbol = l.symbol""")
def display_params(spark, d):
    """Per field: the running engine's value (here the sidecar's), else the model's, else the default."""
    engine = _symbols(spark, d).withColumn("engine", F.from_json("sidecar", reports.HYPER))
    model = reports.latest_model(t.registry(spark, d)).select("symbol", F.from_json("hyperparameters", reports.HYPER).alias("model"))
    pick = lambda n: F.coalesce(f"engine.{n}", f"model.{n}", F.lit(reports.DEFAULTS[n])).alias(n)
    return engine.join(model, "symbol", "left").select("symbol", pick("max_inventory"), pick("kappa"))


# The quoter and what is made of its steps


def steps(spark, d, **parameters) -> DataFrame:
    return folds.simulate(t.ticks(spark, d), **parameters)


def _out(spark, d):
    """Quotes are out in every eighth hour: toggles at its start and end, held until the next, steer the quoter."""
    ticks, hour = t.ticks(spark, d), 3_600_000
    spans = ticks.groupBy("symbol").agg(F.floor(F.min("ts_ms") / (8 * hour)).alias("first"), F.floor(F.max("ts_ms") / (8 * hour)).alias("last"))
    offs = spans.select("symbol", F.explode(F.sequence("first", "last")).alias("nth")).withColumn("off", F.col("nth") * 8 * hour)
    toggle = lambda at, on: F.struct(at.alias("at_ms"), F.lit(on).alias("is_quoting"))
    control = offs.select("symbol", F.inline(F.array(toggle(F.col("off"), False), toggle(F.col("off") + hour, True))))
    return folds.simulate(series.controlled(ticks, control), F.col("is_quoting"))


SIM_COLUMNS = ("symbol", "seq", "is_quoting", *("bid", "ask", "cash", "inventory", "net_worth"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("symbol", "seq", "is_quoting", "side", "lots", *r4("bid", "ask", "cash", "inventory", "net_worth"))


@query("mm_sim_live", f"WITH RECURSIVE {sql.sim()} SELECT symbol, seq, is_quoting, side, lots, {sql.r4('bid', 'ask', 'cash', 'inventory', 'net_worth')} FROM steps")
def mm_sim_live(spark, d):
    return _shown(steps(spark, d))


@query("mm_sim_replay", f"WITH RECURSIVE {sql.sim(live=False)} SELECT symbol, seq, is_quoting, side, lots, {sql.r4('bid', 'ask', 'cash', 'inventory', 'net_worth')} FROM steps")
def mm_sim_replay(spark, d):
    return _shown(steps(spark, d, live=False))


@query("mm_sim_suppressed", f"WITH RECURSIVE {sql.sim(quoting='ts_ms // 3600000 % 8 <> 0')} SELECT symbol, seq, is_quoting, side, lots, {sql.r4('bid', 'ask', 'cash', 'inventory', 'net_worth')} FROM steps")
def mm_sim_suppressed(spark, d):
    return _shown(_out(spark, d))


@query("circuit_breaker", f"""WITH RECURSIVE {sql.sim(start=400000, base=8, most=400)}
SELECT symbol, count(*) AS steps, max(seq) AS last_seq, bool_or(ended) AS terminated, round(min(net_worth), 4) AS least_worth, round(arg_max(reward, seq), 4) AS last_reward FROM steps GROUP BY symbol""")
def circuit_breaker(spark, d):
    rows = steps(spark, d, start_cash=400_000.0, base_size=8.0, max_inventory=400.0)
    return rows.groupBy("symbol").agg(F.count("*").alias("steps"), F.max("seq").alias("last_seq"), F.bool_or("terminated").alias("terminated"), F.round(F.min("net_worth"), 4).alias("least_worth"), F.round(F.max_by("reward", "seq"), 4).alias("last_reward"))


@query("mm_fills", f"WITH RECURSIVE {sql.sim()}, {sql.FILLS} SELECT * FROM fills")
def mm_fills(spark, d):
    return reports.executions(steps(spark, d))


@query("equity_curve", f"WITH RECURSIVE {sql.sim()} SELECT symbol, seq, mid, {sql.r4('net_worth', 'inventory')} FROM steps")
def equity_curve(spark, d):
    return reports.equity_curve(steps(spark, d)).select("symbol", "seq", "mid", *r4("net_worth", "inventory"))


@query("reward_curve", f"WITH RECURSIVE {sql.sim()} SELECT symbol, seq, {sql.r4('reward')}, round(gained, 4) AS step_pnl FROM steps")
def reward_curve(spark, d):
    return steps(spark, d).select("symbol", "seq", *r4("reward", "step_pnl"))


@query("backtest_metrics", f"""WITH RECURSIVE {sql.sim()}, f AS (SELECT *, net_worth / max(net_worth) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS fall FROM steps)
SELECT symbol, round(arg_max(net_worth, seq) - 1000000, 4) AS pnl, count(side) AS trades, round(100 * avg(CASE WHEN realized IS NOT NULL THEN CASE WHEN realized > 0 THEN 1.0e0 ELSE 0.0e0 END END), 6) AS win_rate,
    round(100 * min(fall), 6) AS max_drawdown FROM f GROUP BY symbol""")
def backtest_metrics(spark, d):
    found = reports.backtest_metrics(steps(spark, d))
    return found.select("symbol", F.round("pnl", 4).alias("pnl"), "trades", F.round("win_rate", 6).alias("win_rate"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query("final_net_worth", f"WITH RECURSIVE {sql.sim()} SELECT symbol, round(arg_max(net_worth, seq), 4) AS net_worth, count(*) AS steps, arg_max(net_worth, seq) < 100000 AS bankrupt FROM steps GROUP BY symbol")
def final_net_worth(spark, d):
    return reports.final_worth(steps(spark, d)).withColumn("net_worth", F.round("net_worth", 4))


@query("exec_markers", f"WITH RECURSIVE {sql.sim()}, {sql.FILLS}, {sql.MARKERS} SELECT * FROM markers")
def exec_markers(spark, d):
    return reports.markers(reports.executions(steps(spark, d)))


@query("marker_dedup", f"WITH RECURSIVE {sql.sim()}, {sql.FILLS}, {sql.MARKERS} SELECT * FROM markers QUALIFY row_number() OVER (PARTITION BY symbol, time, text, position ORDER BY seq DESC) = 1")
def marker_dedup(spark, d):
    return reports.distinct_markers(reports.markers(reports.executions(steps(spark, d))))


@query("marker_dedup_time", f"WITH RECURSIVE {sql.sim()}, {sql.FILLS}, {sql.MARKERS} SELECT * FROM markers QUALIFY row_number() OVER (PARTITION BY symbol, time ORDER BY seq DESC) = 1")
def marker_dedup_time(spark, d):
    return reports.distinct_markers(reports.markers(reports.executions(steps(spark, d))), by_time_only=True)


@query("recent_executions", f"WITH RECURSIVE {sql.sim()}, {sql.FILLS} SELECT * FROM fills QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 50")
def recent_executions(spark, d):
    return series.newest(reports.executions(steps(spark, d)), ["symbol"], ["seq"], 50)


@query("engine_status", f"""WITH RECURSIVE {sql.sim()} SELECT symbol, seq, mid, round(inventory, 4) AS inventory, round(net_worth, 4) AS net_worth, is_quoting, CASE WHEN ended THEN 'OFFLINE' ELSE 'LIVE' END AS status
FROM steps QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1""")
def engine_status(spark, d):
    return reports.engine_status(steps(spark, d)).select("symbol", "seq", "mid", *r4("inventory", "net_worth"), "is_quoting", "status")


@query("recovery_snapshot", f"""WITH RECURSIVE {sql.sim()}, {sql.FILLS},
c AS (SELECT symbol, count(*) AS points, min(seq) AS first_point FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 500) GROUP BY symbol),
e AS (SELECT symbol, count(*) AS executions, min(seq) AS first_execution FROM (SELECT * FROM fills QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 50) GROUP BY symbol)
SELECT c.symbol, points, first_point, executions, first_execution FROM c LEFT JOIN e ON c.symbol = e.symbol""")
def recovery_snapshot(spark, d):
    found = reports.snapshot(steps(spark, d))
    size, first = (lambda c: F.size(c).cast("long")), (lambda c: F.get(c, 0).getField("seq"))
    return found.select("symbol", size("chart").alias("points"), first("chart").alias("first_point"), size("executions").alias("executions"), first("executions").alias("first_execution"))


#: The actions of the sweep: number, gamma, spread.
ACTIONS = [(3 * i + j, g, s) for i, g in enumerate((0.05, 0.1, 0.5)) for j, s in enumerate((0.5, 1.0, 4.0))]
#: Cash, size and inventory of the sweep, with which wide quotes trip the breaker on some symbols.
SWEPT = dict(start_cash=400_000.0, base_size=8.0, max_inventory=400.0)


@query("param_sweep", f"""WITH RECURSIVE {sql.sweep(ACTIONS, start=400000, base=8, most=400)}
SELECT action, CAST(symbol AS VARCHAR) AS symbol, round(arg_max(net_worth, seq), 4) AS net_worth, count(side) AS fills, count(*) AS steps, bool_or(ended) AS terminated, any_value(gamma0) AS gamma, any_value(spread) AS spread
FROM steps GROUP BY action, symbol""")
def param_sweep(spark, d):
    """The quoter under nine actions at once, side by side in one fold; an action ends at its breaker."""
    out = folds.sweep(t.ticks(spark, d), ACTIONS, **SWEPT)
    actions = spark.createDataFrame(ACTIONS, "action int, gamma double, spread double")
    return out.withColumn("net_worth", F.round("net_worth", 4)).join(F.broadcast(actions), "action")


@query("obs_normalized", f"""WITH {sql.TICKS}, w AS (SELECT symbol, seq, cents, count(*) OVER o AS n, CAST(sum(cents) OVER o AS HUGEINT) AS s1, CAST(sum(CAST(cents AS HUGEINT) * cents) OVER o AS HUGEINT) AS s2 FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY seq)),
z AS (SELECT symbol, seq, (cents - CAST(s1 AS DOUBLE) / n) / sqrt(greatest(CAST(n * s2 - s1 * s1 AS DOUBLE) / (CAST(n AS DOUBLE) * n), 1e-8)) AS z FROM w)
SELECT symbol, seq, round(least(greatest(z, -10e0), 10e0), 4) AS z FROM z""")
def obs_normalized(spark, d):
    return series.normalized(t.ticks(spark, d)).withColumn("z", F.round("z", 4))


# Order books


@query("book_l1")
def book_l1(spark, d):
    rows = folds.book_l1(t.messages(spark, d), dealt=True)
    return rows.withColumns({"mid": m.mid_price(F.col("best_bid"), F.col("best_ask")), "obi": m.imbalance(F.col("bid_volume"), F.col("ask_volume"))})


@query("lob_fills")
def lob_fills(spark, d):
    return folds.fills(t.messages(spark, d), dealt=True)


@query("lob_cancels")
def lob_cancels(spark, d):
    return folds.book_l1(t.messages(spark, d), dealt=True).filter(F.col("status").isin("CANCELLED", "NOT_FOUND")).select("symbol", "seq", "status", "cancelled")


@query("replay_mid")
def replay_mid(spark, d):
    """Middle price after each run of equal timestamps, and whether it was the symbol's last."""
    book = folds.book_l1(t.messages(spark, d), dealt=True).select("symbol", "seq", "timestamp", "best_bid", "best_ask")
    runs = series.replay_ticks(book).groupBy("symbol", "tick").agg(F.max_by(F.struct("seq", "timestamp", "best_bid", "best_ask"), "seq").alias("b"))
    last = F.col("tick") == F.max("tick").over(Window.partitionBy("symbol"))
    return runs.select("symbol", "tick", F.col("b.timestamp").alias("timestamp"), m.mid_price(F.col("b.best_bid"), F.col("b.best_ask")).alias("mid"), last.alias("done"))


@query("book_depth")
def book_depth(spark, d):
    changes = folds.resting_orders(t.messages(spark, d), dealt=True)
    return changes.groupBy("symbol", "side", "price").agg(F.sum("change").alias("volume")).filter("volume > 0")


# Streams


def _live_ticks(spark, d):
    e = live.event_stream(spark, d)
    cents = F.lit(6_000_000) + F.floor(F.round(F.col("value") * 100).cast("long") / 10.0).cast("long")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), cents.alias("cents"),
        (cents / 100.0).alias("price"), (F.get_json_object("props", "$.k").cast("long") / 100.0).alias("volume"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


@query("stream_ticks", f"WITH {sql.TICKS} SELECT symbol, seq, ts_ms, CAST(round_even(price, 0) AS BIGINT) AS scaled_price FROM ticks")
def stream_ticks(spark, d):
    rows = _live_ticks(spark, d)
    return live.run_to_table(rows.select("symbol", "seq", "ts_ms", m.whole_price(F.col("price")).alias("scaled_price")))


def _replayed_ticks(spark, d):
    return live.replayed(t.ticks(spark, d).select("symbol", "seq", "ts_ms", "cents", "price"))


@query("stream_mm", ORACLE["mm_sim_live"])
def stream_mm(spark, d):
    return _shown(live.run_to_table(live.quote(_replayed_ticks(spark, d))))


@query("stream_telemetry", f"""WITH RECURSIVE {sql.sim()} SELECT symbol, seq, ts_ms AS timestamp, mid AS mid_price, round(net_worth, 2) AS net_worth, round(inventory, 2) AS inventory_btc, is_quoting,
    CASE WHEN side IS NULL THEN 0 ELSE 1 END AS executions FROM steps""")
def stream_telemetry(spark, d):
    sent = live.run_to_table(live.telemetry(live.quote(_replayed_ticks(spark, d))))
    return sent.withColumn("executions", F.size("latest_executions")).drop("latest_executions")


#: Late ticks: every tenth two hours, every 97th twelve days; six micro-batches in the order of arrival.
_ARRIVED = f"""{sql.TICKS}, late AS (SELECT *, ts_ms + CASE WHEN seq % 97 = 0 THEN 1036800000 WHEN seq % 10 = 0 THEN 7200000 ELSE 0 END AS arrival FROM ticks),
dealt AS (SELECT *, (arrival - min(arrival) OVER ()) * 6 // (max(arrival) OVER () - min(arrival) OVER () + 1) AS batch FROM late),
newest AS (SELECT b.batch, max(d.ts_ms) - 10800000 AS mark FROM (SELECT unnest(range(8)) AS batch) b JOIN dealt d ON d.batch < b.batch GROUP BY b.batch)"""


@query("stream_windows", f"""WITH {_ARRIVED}
SELECT symbol, start, count(*) AS n, CAST(sum(lots) AS BIGINT) AS lots FROM (SELECT *, ts_ms // 21600000 * 21600 AS start FROM dealt) d
LEFT JOIN newest m ON m.batch = d.batch - 1
WHERE (m.mark IS NULL OR (start + 21600) * 1000 > m.mark // 1) AND (start + 21600) * 1000 <= (SELECT mark FROM newest WHERE batch = 7) GROUP BY symbol, start""")
def stream_windows(spark, d):
    """Windows over a stream with late ticks: what comes within the delay counts, what comes after its window does not.

    A row is held against the watermark of the batch before its own; the last windows stay open.
    """
    ticks = t.ticks(spark, d)
    late = F.when(F.col("seq") % 97 == 0, 1_036_800_000).when(F.col("seq") % 10 == 0, 7_200_000).otherwise(0)
    least, most = ticks.select((F.col("ts_ms") + late).alias("a")).agg(F.min("a"), F.max("a")).first()
    batch = F.floor((F.col("ts_ms") + late - least) * 6 / (most - least + 1))
    return live.run_to_table(live.windowed(live.arrivals(ticks, batch, 6)))


from tickforge.plans import extended as _extended  # noqa: E402, F401  (registers its queries here)
