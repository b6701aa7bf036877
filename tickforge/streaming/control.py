"""A control stream beside the tick stream: toggles steer the ticks of their symbol by event time, whatever order they arrive in.

Each symbol's rows wait in the state store until the watermark has passed them, as until then an earlier toggle may still come. An event-time
timer then releases them in the order of their time, toggles before ticks of the same time, so that every tick bears the last toggle at or
before it: the rule of the as-of join. Rows that come later than the watermark are dropped by Spark. A toggle holds for ``HOLDS_MS`` and
no longer; a symbol that is silent for as long is forgotten, so that the state doesn't grow with the symbols that ever were.

The state is kept in four variables, which the state reader can open without running the stream again (``status``, ``chart``):
``waiting`` (rows ahead of the watermark), ``toggle`` (the last one released), ``last`` (the last tick released, and how many there were)
and ``recent`` (the last ``CHART`` ticks released, for whoever comes later).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long a toggle holds, in ms of event time, and how many points a late subscriber gets.
HOLDS_MS, CHART = 30 * 86_400_000, 500
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, seq long, ts_ms long, price double, is_quoting boolean"
ROW = "ts_ms long, toggles boolean, seq long, price double, is_quoting boolean"
COLUMNS = ["ts_ms", "toggles", "seq", "price", "is_quoting"]


class Controlled(StatefulProcessor):
    """Rows of one symbol: ticks and toggles in, ticks with ``is_quoting`` out."""

    def __init__(self, holds_ms: int = HOLDS_MS, chart: int = CHART):
        self.holds_ms, self.chart = holds_ms, chart

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.toggle = handle.getValueState("toggle", "at_ms long, is_quoting boolean")
        self.last = handle.getValueState("last", "seq long, ts_ms long, price double, is_quoting boolean, released long")
        self.recent = handle.getListState("recent", "seq long, ts_ms long, price double, is_quoting boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(int(at), bool(toggles), int(seq), float(price), bool(on)) for at, toggles, seq, price, on in frame[COLUMNS].itertuples(index=False)])
                least = int(frame["ts_ms"].min())
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            # it fires when the watermark is past the row; one for the earliest is enough
            if not any(t <= earliest for t in self.handle.listTimers()):
                self.handle.registerTimer(earliest)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= mark), key=lambda r: (r[0], not r[1], r[2]))
        later = [r for r in rows if r[0] > mark]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        at, quoting = tuple(self.toggle.get()) if self.toggle.exists() else (None, True)
        out = []
        for ts_ms, toggles, seq, price, is_quoting in due:
            if toggles:
                at, quoting = ts_ms, is_quoting
            else:
                out.append((seq, ts_ms, price, bool(quoting) if at is None or ts_ms - at <= self.holds_ms else True))
        if at is not None:
            self.toggle.update((at, bool(quoting)))
        if out:
            released = (self.last.get()[4] if self.last.exists() else 0) + len(out)
            self.last.update((*out[-1], released))
            kept = [*([tuple(r) for r in self.recent.get()] if self.recent.exists() and len(out) < self.chart else []), *out]
            self.recent.put(kept[-self.chart :])
        if later:
            self.handle.registerTimer(min(r[0] for r in later))
        elif due:
            self.handle.registerTimer(due[-1][0] + self.holds_ms + 1)
        else:
            # silent for as long as a toggle holds
            for state in (self.toggle, self.last, self.recent):
                state.clear()
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def steered(ticks: DataFrame, toggles: DataFrame, delay: str = "3 hours", holds_ms: int = HOLDS_MS, chart: int = CHART) -> DataFrame:
    """Ticks (symbol, seq, ts_ms, price) with ``is_quoting`` under toggles (symbol, at_ms, is_quoting), both streams; see the module."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    left = ticks.select("symbol", "ts_ms", F.lit(False).alias("toggles"), "seq", "price", F.lit(True).alias("is_quoting"))
    right = toggles.select("symbol", F.col("at_ms").alias("ts_ms"), F.lit(True).alias("toggles"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("price"), "is_quoting")
    rows = left.union(right).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(Controlled(holds_ms, chart), OUT, "append", "eventTime")


# What a stream knows, read from its checkpoint


def operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a stream: operatorId, operatorName, stateStoreName, numPartitions, minBatchId, maxBatchId."""
    return spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId")


def held(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """symbol and the fields of one state variable, as of the last batch that was committed."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    value = "list_element" if "list_element" in rows.columns else "value"
    return rows.select("key.symbol", f"{value}.*")


def status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row a symbol: where its stream stands. The stream is not run."""
    waiting = held(spark, checkpoint, "waiting").groupBy("symbol").agg(F.count("*").alias("waiting"))
    return held(spark, checkpoint, "last").join(waiting, "symbol", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))


def chart(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last points of each symbol, for a subscriber that comes late. The stream is not run."""
    return held(spark, checkpoint, "recent")
