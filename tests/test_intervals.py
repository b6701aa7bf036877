"""Overlap joins and lots by brute force, sketches within their errors, table functions in SQL text."""

import random
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, rows_of
from tickforge.operators import intervals, sketches
from tickforge.plans import catalog

SPAN = "k string, i long, lo long, hi long"


@pytest.mark.parametrize(("width", "hot"), [(1, 1000), (7, 3), (50, 1), (100_000, 10)])
def test_overlaps_by_brute_force(spark, width, hot):
    draw = random.Random(width)
    make = lambda n: [(draw.choice(["a", "a", "a", "b", None]), i, lo := draw.randrange(-30, 90), lo + draw.randrange(-1, 25)) for i in range(n)]
    left, right = make(70), make(60)
    left += [left[0], ("a", 500, None, 5), ("a", 501, 5, None), ("c", 502, 0, 10)]
    got = intervals.overlapping(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN).selectExpr("k", "i as j", "lo as from", "hi as to"), "k", ("lo", "hi"), ("from", "to"), width, hot)
    ok = lambda r: None not in r and r[2] < r[3]
    want = [(*x, *y[1:]) for x in left for y in right if ok(x) and ok(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3]]
    assert got.columns == ["k", "i", "lo", "hi", "j", "from", "to"] and sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_overlap_plan_pairs_nothing(spark):
    plan = catalog.QUERIES["candle_overlaps"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "NestedLoop" not in (p := catalog.QUERIES["fifo_lots"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()) and "Cartesian" not in p


def plain_lots(trades):
    """First in, first out, by queues: a sale closes the oldest purchase that is open, or opens a short one."""
    held, out = {}, {}
    for symbol, seq, is_buy, qty, cents in sorted(trades, key=lambda r: (r[0], r[1])):
        queue = held.setdefault(symbol, deque())
        while qty and queue and queue[0][0] != is_buy:
            _, other, left, paid = queue[0]
            n = min(qty, left)
            buy, sell = ((seq, cents), (other, paid)) if is_buy else ((other, paid), (seq, cents))
            key = (symbol, buy[0], sell[0], buy[1], sell[1])
            out[key] = out.get(key, 0) + n
            qty -= n
            queue[0] = (not is_buy, other, left - n, paid)
            if left == n:
                queue.popleft()
        if qty:
            queue.append((is_buy, seq, qty, cents))
    return sorted((k[0], k[1], k[2], n, k[3], k[4]) for k, n in out.items())


TRADE = "symbol string, seq long, is_buy boolean, qty long, cents long"


@pytest.mark.parametrize(("rows", "lots"), [(10, 7), (1000, 1_000_000), (3, 1)])
def test_lots_by_queues(spark, rows, lots):
    """Long and short positions, turns from one to the other, no quantity, one-sided symbols, a trade over many chunks."""
    draw = random.Random(rows)
    trades = [(draw.choice("ab"), i, draw.random() < 0.5, draw.choice([0, 1, 2, 5, 9]), draw.randrange(90, 110)) for i in range(120)]
    trades += [("c", 1, True, 3, 100), ("d", 1, False, 4, 100), ("e", 1, False, 60, 100), ("e", 2, True, 100, 90), ("e", 3, False, 70, 95)]
    got = intervals.fifo_lots(spark.createDataFrame(trades, TRADE).repartition(3), rows, lots)
    assert sorted(tuple(r) for r in got.select("symbol", "buy_seq", "sell_seq", "qty", "buy_cents", "sell_cents").collect()) == plain_lots(trades)
    closes = {(r.symbol, r.seq): (r.qty, r.pnl, r.is_win) for r in intervals.realized(got).collect()}
    assert closes[("e", 2)] == (60, 600, True) and closes[("e", 3)] == (40, 200, True)
    assert intervals.fifo_lots(spark.createDataFrame([], TRADE), rows, lots).count() == 0


def test_sketches_merge_within_their_errors(spark):
    """Wide candles from narrow sketches: the counts and ranks of many values within the stated errors, the same as in one go."""
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("symbol"), (F.col("id") * 1000).alias("ts_ms"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("who"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).cast("double").alias("value"))
    found = sketches.estimates(sketches.rolled_up(sketches.by_candle(df, 1800, "who", "value"), 86_400)).collect()
    assert len(found) == 1 and found[0].n == n
    true = df.select("who").distinct().count()
    assert abs(found[0].users / true - 1) < 3 * 0.0163
    for q, r in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(df.filter(F.col("value") <= found[0][q]).count() / n - r) < 0.0175


def test_rollup_equals_sql_beyond_a_sketch(spark, tmp_path):
    """Candles of thousands of rows, users and values, beside ones without symbol, time, user or value."""
    con = duckdb.connect()
    con.execute("""CREATE VIEW events AS SELECT i AS event_id, CASE WHEN i % 501 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (i * 2) SECOND END AS ts, CASE WHEN i % 7 <> 0 THEN hash(i) % 9000 END::BIGINT AS user_id,
        CASE WHEN i % 3 = 0 THEN 'a' WHEN i % 97 <> 0 THEN 'b' WHEN i % 2 = 0 THEN 'c' END AS event_type, CASE WHEN event_type <> 'c' AND i % 11 <> 0 THEN hash(i + 1) % 40000 / 100.0e0 END AS value, '' AS props FROM range(30000) r(i)""")
    con.execute(f"COPY (SELECT * FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["sketch_rollup"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE['sketch_rollup']})").fetchall()
    assert max(r[2] for r in want) > 4000 and None in {r[0] for r in want} and None in {r[1] for r in want} and None in {r[4] for r in want}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_table_functions_read_views(spark):
    from tickforge.functions import table

    table.open_sql(spark, f"{DATA}/sf0.001")
    assert spark.sql("SELECT count(*) AS n FROM candles WHERE symbol = 'click'").first().n > 0
    got = spark.sql("SELECT * FROM tick_runs(TABLE(SELECT * FROM VALUES ('x', 1L, 5L), ('x', 2L, 5L), ('x', 3L, 6L), ('x', 4L, 5L), ('y', 1L, 5L) AS t(symbol, seq, timestamp)) PARTITION BY symbol ORDER BY seq)")
    assert rows_of(got) == rows_of(spark.createDataFrame([("x", 1, 5, 1), ("x", 2, 5, 1), ("x", 3, 6, 2), ("x", 4, 5, 3), ("y", 1, 5, 1)], "symbol string, seq long, timestamp long, tick long"))


@pytest.mark.parametrize("rows", [1, 7, 100, 1_000_000])
def test_tick_runs_of_one_symbol_over_chunks(spark, rows):
    """Runs longer than chunks, numbers that are missing, rows without timestamp or symbol: SQL's runs, whatever the chunks; many tasks."""
    from tickforge.functions import table
    from tickforge.operators import chunks

    draw = random.Random(rows)
    data, at = [], 0
    for seq in sorted(draw.sample(range(1, 2000), 900)):
        at += draw.random() < 0.08
        data.append((draw.choice(["a", "a", "a", "b", None]), seq, None if draw.random() < 0.02 else at % 50))
    want, last = {}, {}
    for symbol, seq, timestamp in data:
        tick, before = last.get(symbol, (0, None))
        last[symbol] = (tick + (before is None or timestamp != before), timestamp)
        at, n, first = want.get((symbol, last[symbol][0]), (timestamp, 0, seq))
        want[symbol, last[symbol][0]] = (at, n + 1, first)
    table.open_sql(spark, f"{DATA}/sf0.001")
    draw.shuffle(data)
    spark.createDataFrame(data, "symbol string, seq long, timestamp long").createOrReplaceTempView("messages")
    got = spark.sql(table.TICK_RUNS.replace(f"DIV {chunks.ROWS}", f"DIV {rows}"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_tick_runs_are_not_bound_to_a_task_a_symbol(spark):
    from tickforge.functions import table

    table.open_sql(spark, f"{DATA}/sf0.001")
    found = spark.sql(table.TICK_RUNS)
    assert found.count() == len(found.collect()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert plan.count("ArrowEvalPythonUDTF") == 1  # once, though its runs are read twice
    assert all(x.split("hashpartitioning(")[1].count("#") > 1 for x in dealt if "partition_by" in x) and any("partition_by" in x for x in dealt)
