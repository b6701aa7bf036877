"""Streams with state against their rules: control by event time, sessions, what the checkpoint knows, sinks that repeat batches."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tickforge.streaming import control, live, sinks

HOUR = 3_600_000
TICK = "symbol string, seq long, ts_ms long, price double"


def arriving(spark, rows, schema):
    """A stream of the given micro-batches."""
    where = f"{live.folder(spark)}/in"
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where)
    kind = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(where)


def test_toggles_steer_by_event_time_whatever_order_they_arrive_in(spark):
    """Ticks and toggles shuffled over batches within the delay; equal times; a toggle that ends; rows too late; silent symbols."""
    draw = random.Random(8)
    begun = 480_000 * HOUR
    ticks = [("a", k, begun + k * HOUR // 4, 1.0 + k) for k in range(400)] + [("b", 1000 + k, begun + k * HOUR, 2.0) for k in range(10)]
    toggles = [("a", begun + k * 7 * HOUR, k % 2 == 0) for k in range(12)] + [("b", begun + 3 * HOUR, False)]
    batch = lambda at: min(5, max(0, (at - begun + draw.randrange(0, 2 * HOUR)) // (17 * HOUR)))
    came = [[], [], [], [], [], []], [[], [], [], [], [], []]
    for r in ticks:
        came[0][batch(r[2])].append(r)
    for r in toggles:
        came[1][batch(r[1])].append(r)
    came[0][5].append(("a", 9999, begun + 5 * HOUR, 7.0))  # days late
    for side in came:
        for part in side:
            draw.shuffle(part)
    stream = control.steered(arriving(spark, came[0], TICK), arriving(spark, came[1], "symbol string, at_ms long, is_quoting boolean"), "3 hours", holds_ms=20 * HOUR, chart=30)
    where = live.run(stream)
    mark = max(r[2] for r in ticks) - 3 * HOUR

    def rule(symbol, at):
        told = [(t, on) for s, t, on in toggles if s == symbol and t <= at]
        last = max(told, default=(at, True))
        return last[1] if at - last[0] <= 20 * HOUR else True

    want = sorted((s, q, at, p, rule(s, at)) for s, q, at, p in ticks if at <= mark)
    got = [tuple(r) for r in spark.read.schema(control.OUT).parquet(f"{where}/rows").collect()]
    assert sorted(got) == want and {w[4] for w in want if w[0] == "a"} == {True, False}
    # b ended its last toggle's time long before the end: nothing of it is held, and it is not forgotten what it was told before that
    log = f"{where}/log"
    assert [r.operatorName for r in control.operators(spark, log).collect()] == ["transformWithStateInPandasExec"]
    status = {r.symbol: r for r in control.status(spark, log).collect()}
    last = max(w for w in want if w[0] == "a")
    assert tuple(status["a"])[1:6] == (*last[1:], sum(w[0] == "a" for w in want))
    ahead = sum(at > mark for _, _, at, _ in ticks) + sum(at > mark for _, at, _ in toggles)
    assert status["a"].waiting == ahead and "b" not in status
    assert sorted(r.seq for r in control.chart(spark, log).collect()) == [w[1] for w in want if w[0] == "a"][-30:]


def test_a_late_tick_joins_two_sessions(spark):
    """Two sessions that are open are joined by the tick between them; after the watermark has passed, it is dropped."""
    minute = 60_000
    tick = lambda seq, minutes: ("a", seq, minutes * minute, 1.0, 10)
    batches = [
        [tick(1, 0), tick(2, 5), tick(3, 40), tick(4, 50)],  # two sessions
        [tick(5, 22)],  # 17 minutes after the first, 18 before the second
        [tick(6, 600)],
        [tick(7, 601), tick(8, 900)],
        [tick(10, 1500)],
        [tick(9, 630)],  # held against the watermark of the batch before: long closed
        [tick(11, 3000)],
    ]
    got = live.run_to_table(live.sessions(arriving(spark, batches, TICK + ", lots long"), "20 minutes", "1 hour"))
    assert sorted((r.start_ms // minute, r.last_ms // minute, r.n, r.lots) for r in got.collect()) == [(0, 50, 5, 50), (600, 601, 2, 20), (900, 900, 1, 10), (1500, 1500, 1, 10)]


def test_fan_out_writes_each_batch_once_and_drops_what_fails(spark):
    folder = live.folder(spark)
    rows = spark.createDataFrame([(k, k % 2) for k in range(10)], "seq long, side int")
    broken = {"on": True}

    def shaky(x):
        if broken["on"]:
            raise ConnectionError("gone")
        return x

    out = sinks.FanOut(folder, {"first": lambda x: x, "shaky": shaky, "odd": lambda x: x.filter("side = 1"), "late": lambda x: x.select(F.raise_error(F.lit("fails in the tasks")).alias("seq"))})
    count = lambda name: sinks.table(spark, f"{folder}/{name}", "seq long, side int").count()
    out(rows, 0)
    assert set(out.dropped(spark)) == {"shaky", "late"} and (count("first"), count("odd"), count("shaky")) == (10, 5, 0)
    out(rows, 0)  # the batch is run again
    assert (count("first"), count("odd")) == (10, 5)
    broken["on"] = False
    again = sinks.FanOut(folder, out.subscribers)  # a new run of the stream
    again(rows, 1)
    assert (count("first"), count("odd"), count("shaky")) == (20, 10, 0)
    again.readmit(spark, "shaky")
    again(rows, 2)
    assert (count("first"), count("shaky")) == (30, 10) and set(again.dropped(spark)) == {"late"}


def test_conflation_repeats_no_row(spark):
    folder, schema = live.folder(spark), "symbol string, slot_ms long, seq long, price double"
    first = spark.createDataFrame([("a", 0, 1, 1.0), ("b", 0, 2, 2.0)], schema)
    second = spark.createDataFrame([("a", 0, 5, 5.0), ("a", 9, 3, 3.0)], schema)
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sinks.written(rows, folder, batch)
    got = sinks.newest(spark, folder, ["symbol", "slot_ms"], "seq", schema)
    assert rows_of(got) == rows_of(spark.createDataFrame([("a", 0, 5, 5.0), ("b", 0, 2, 2.0), ("a", 9, 3, 3.0)], schema))
    assert sinks.table(spark, f"{folder}-none", schema).count() == 0


@pytest.mark.parametrize("cuts", [1, 2, 5, 9])
def test_candles_are_the_same_after_any_cut(spark, cuts):
    """Ticks dealt to batches at random, batches run again, days compacted between them, and again after that."""
    from tickforge.operators import series

    draw = random.Random(cuts)
    day = 86_400_000
    rows = [("a" if k % 3 else "b", k, k * day // 50, draw.randrange(100, 200) / 10, draw.randrange(9), draw.randrange(cuts)) for k in range(260)]
    df = spark.createDataFrame(rows, "symbol string, seq long, ts_ms long, price double, lots long, part int")
    store = sinks.CandleStore(spark, live.folder(spark), 1800)
    assert store.read().count() == 0
    for k in range(cuts):
        part = df.filter(F.col("part") == k)
        store.add(part, k)
        if k % 2:
            store.compact(F.col("day") < 3)
            store.add(part, k)  # its days are partly compacted
            store.add(df.filter(F.col("part") == k - 1), k - 1)
        if k % 4 == 3:
            store.compact()
    want = rows_of(series.candles(df, 1800))
    assert rows_of(store.read()) == want
    store.compact()
    store.compact()
    assert rows_of(store.read()) == want
    store.add(df.filter("part = 0"), 0)
    assert rows_of(store.read()) == want
