"""User code in SQL text: table functions over an ordered partition, and the engine's tables as views.

    SELECT symbol, tick, count(*) FROM tick_runs(TABLE(SELECT symbol, seq, timestamp FROM messages) PARTITION BY symbol ORDER BY seq) GROUP BY symbol, tick

Spark deals the rows by the partition and sorts them; a function sees one partition's rows one after the other, with a state of bounded
size. Long series are partitioned by symbol and chunk, and what a chunk must know of those before it comes from a row a chunk (``TICK_RUNS``),
as in the DataFrame forms (``series``). ``tick_runs`` reads whole Arrow batches.
"""

from __future__ import annotations

from collections import deque
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from tickforge.operators import chunks, series
from tickforge.sources import tables


@arrow_udtf(returnType="symbol string, seq long, timestamp long, tick long")
class TickRuns:
    """Numbers the runs of equal timestamps of rows (symbol, seq, timestamp); a row without timestamp is a run of its own."""

    def __init__(self):
        self.last, self.tick = None, 0

    def eval(self, rows: pa.RecordBatch):
        if not rows.num_rows:
            return
        at = rows.column("timestamp")
        before = pa.concat_arrays([pa.array([self.last], at.type), at.slice(0, len(at) - 1)])
        tick = pc.add(pc.cumulative_sum(pc.fill_null(pc.not_equal(at, before), True).cast(pa.int64())), self.tick)
        self.last, self.tick = at[-1].as_py(), tick[-1].as_py()
        yield pa.table([rows.column("symbol"), rows.column("seq"), at, tick], names=["symbol", "seq", "timestamp", "tick"])


@udtf(returnType="symbol string, seq long, n long, sigma double")
class RollingSigma:
    """Deviation of the last 100 prices of rows (symbol, seq, cents), as ``series.rolling_volatility`` gives it."""

    def __init__(self):
        self.ring, self.s1, self.s2 = deque(), 0, 0

    def eval(self, row: Row):
        c = row["cents"]
        self.ring.append(c)
        self.s1, self.s2 = self.s1 + c, self.s2 + c * c
        if len(self.ring) > series.RING:
            old = self.ring.popleft()
            self.s1, self.s2 = self.s1 - old, self.s2 - old * old
        n = len(self.ring)
        slots = n + 1 if 1 < n < series.RING else n
        exact = (slots * self.s2 - self.s1 * self.s1) / (slots * slots)
        yield row["symbol"], row["seq"], n, series.LEAST_SIGMA if n == 1 else max(exact**0.5 / 100.0, series.LEAST_SIGMA)


#: Runs of the whole messages: symbol, tick, timestamp, n, first_seq. Runs are numbered in each chunk of a symbol; a chunk's first run is the last one of the
#: chunk before it if they have the same timestamp.
TICK_RUNS = f"""WITH runs AS (SELECT symbol, seq DIV {chunks.ROWS} AS chunk, tick AS nth, min(timestamp) AS timestamp, count(*) AS n, min(seq) AS first_seq
    FROM tick_runs(TABLE(SELECT symbol, seq, timestamp FROM messages) PARTITION BY (symbol, seq DIV {chunks.ROWS}) ORDER BY seq) GROUP BY ALL),
ends AS (SELECT symbol AS of, chunk AS at, max(nth) AS runs, min_by(timestamp, nth) AS first, max_by(timestamp, nth) AS last FROM runs GROUP BY ALL),
joined AS (SELECT *, CASE WHEN first = lag(last) OVER (PARTITION BY of ORDER BY at) THEN 1 ELSE 0 END AS joins FROM ends),
bases AS (SELECT of, at, coalesce(sum(runs) OVER (PARTITION BY of ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum(joins) OVER (PARTITION BY of ORDER BY at) AS base FROM joined)
SELECT symbol, nth + base AS tick, min(timestamp) AS timestamp, sum(n) AS n, min(first_seq) AS first_seq FROM runs JOIN bases ON symbol <=> of AND chunk <=> at GROUP BY symbol, nth + base"""
FUNCTIONS = {"tick_runs": TickRuns, "rolling_sigma": RollingSigma}
VIEWS = {"ticks": tables.ticks, "raw_ticks": tables.raw_ticks, "messages": partial(tables.messages, by_symbol=False), "registry": tables.registry}


def open_sql(spark: SparkSession, sf_dir: str) -> None:
    """Registers the table functions, and the tables of a folder as temporary views."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    for name, read in VIEWS.items():
        read(spark, sf_dir).createOrReplaceTempView(name)
    series.candles(tables.raw_ticks(spark, sf_dir), 1800).createOrReplaceTempView("candles")
