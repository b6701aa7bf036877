"""A stream in many micro-batches ends as the batch does; sources round-trip."""

import json
import random
import weakref

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tests.conftest import rows_of
from tests.test_folds import TICK, walk
from tickforge.operators import folds
from tickforge.sources import tables
from tickforge.streaming import live


def test_batch_equals_stream(spark, tmp_path):
    rows = [(s, i, i * 1000, c, c / 100, False) for k, s in enumerate("ab") for i, c in enumerate(walk(250, k))]
    df = spark.createDataFrame(rows, TICK)
    for i in range(5):
        df.filter(F.floor(F.col("seq") / 50) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shown = lambda x: x.select("symbol", "seq", "side", F.round("net_worth", 6), F.round("sigma", 9))
    assert rows_of(shown(live.run_to_table(live.quote(stream)))) == rows_of(shown(folds.simulate(df)))


def test_one_large_batch_is_read_by_parts(spark, tmp_path, monkeypatch):
    """Rows in no order and with times that repeat, many more than are held at once: the steps are the batch's, given by parts."""
    draw = random.Random(4)
    rows = [(s, i, i % 50 * 1000, c, c / 100, False) for k, s in enumerate("ab") for i, c in enumerate(walk(1500, k))]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, TICK)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(live, "in_order", lambda frames, schema, by, order=live.in_order: order(frames, schema, by, held=64))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = live.run_to_table(live.quote(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shown = lambda x: x.select("symbol", "seq", "side", F.round("net_worth", 6), F.round("sigma", 9))
    assert rows_of(shown(got)) == rows_of(shown(folds.simulate(df)))


def test_a_recording_is_played_in_bounded_batches(spark, tmp_path):
    """Files in no order, one of them with most rows: every micro-batch has a bounded number of rows, all of them after the batch before."""
    df = spark.createDataFrame([("a", k * 3, k % 9) for k in range(2000)], "symbol string, seq long, ts_ms long")
    for part in ("seq > 1500", "seq <= 1500 and seq % 2 = 1", "seq <= 1500 and seq % 2 = 0"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = live.replayed(spark.read.parquet(str(tmp_path / "in")), 250)
    sink = lambda rows, batch: seen.append(sorted(r.seq for r in rows.collect()))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert [q for batch in seen for q in batch] == [k * 3 for k in range(2000)] and len(seen) >= 8 and max(map(len, seen)) <= 500
    assert live.replayed(df.filter("false")).isStreaming


def test_order_by_parts_holds_few_rows():
    """Frames are taken as they come, and rows given from files; nulls come last."""
    draw = random.Random(7)
    rows = [(draw.randrange(40), draw.choice([None, *range(9)]), k, float("nan") if k == 5 else k / 2, None if k == 9 else k % 2 == 0) for k in range(3000)]
    rows[17] = (None, 3, 17, 0.0, True)
    taken, most = [], 0

    def frames():
        nonlocal most
        for k in range(0, len(rows), 100):
            frame = pd.DataFrame(rows[k : k + 100], columns=[x.split()[0] for x in live.TICK.split(", ")]).astype({"seq": object, "ts_ms": object})
            frame = frame.where(frame.notna() | (frame.columns == "price"), None)
            taken.append(weakref.ref(frame))
            yield frame
            del frame
            most = max(most, sum(r() is not None for r in taken))

    got = list(live.in_order(frames(), live.TICK, ["seq", "ts_ms"], held=250))
    last = lambda x: (x is None, x or 0)
    assert [g[:2] for g in got] == sorted((r[:2] for r in rows), key=lambda r: [last(x) for x in r]) and most <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, rows)) and got == list(live.in_order(iter([]), live.TICK, ["seq"])) + got


def test_feed_messages(spark):
    lines = spark.createDataFrame([('{"p": "60000.5", "q": "0.25", "m": true, "T": 17}',), ("rubbish",)], "value string")
    assert [tuple(r) for r in live.parse_trades(lines, "X").collect()] == [(17, "X", 17, 6_000_050, 60000.5, 0.25, True)]


def test_message_csv_round_trip(spark, tmp_path):
    rows = [(i, "X", 100 + i, 1, i, i % 2, 50 + i, 3) for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, symbol string, timestamp long, type int, order_id long, side int, price long, qty long")
    tables.write_messages_csv(df, str(tmp_path / "m"))
    good, bad = tables.read_messages_csv(spark, str(tmp_path / "m"), "X")
    assert good.count() == 19 and bad.count() == 0  # the first line is skipped
    assert [r.order_id for r in good.orderBy("seq").collect()] == list(range(1, 20))
    assert tables.read_messages_csv(spark, str(tmp_path / "m"), "X", skip_first_row=False)[0].count() == 20
    (tmp_path / "bad.csv").write_text("1,1,1,0,5,5\n2,x,1,0,5,5\n3,1,2,0,5,5\n")
    good, bad = tables.read_messages_csv(spark, str(tmp_path / "bad.csv"), "X", skip_first_row=False)
    assert (good.count(), bad.count()) == (2, 1)


def test_json_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"a": 7, "T": 1, "p": "2.5", "q": "1", "m": False}) + "\n")
    assert tuple(tables.read_trades_json(spark, str(tmp_path / "t.json")).first()) == (7, 1, 2.5, 1.0, False)
    (tmp_path / "k.json").write_text('[5, "1", "2", "0.5", "1.5", "10"]\n')
    assert tuple(tables.read_klines_json(spark, str(tmp_path / "k.json"), "X").first()) == ("X", 5, 1.0, 2.0, 0.5, 1.5, 10.0)


def test_registry_append(spark, tmp_path):
    for k in (1, 2):
        tables.append_registry(spark.createDataFrame([(k, "A")], "id long, symbol string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).filter("symbol = 'A'").count() == 2


def test_message_path_falls_back(spark, tmp_path):
    (tmp_path / "BTCUSDT.csv").write_text("")
    assert tables.message_path(spark, str(tmp_path), "BTC/USDT").endswith("/BTCUSDT.csv")
    assert tables.message_path(spark, str(tmp_path), "ETH/USDT").endswith("/test_data.csv")


def test_csv_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    rows = [(i, "X", 100 + i, 1, i, i % 2, 50 + i, 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, symbol string, timestamp long, type int, order_id long, side int, price long, qty long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        tables.write_messages_csv(df.repartition(5), str(tmp_path / "m"))
        assert len(list((tmp_path / "m").glob("part-*"))) > 1
        good, bad = tables.read_messages_csv(spark, str(tmp_path / "m"), "X")
        assert spark.read.text(str(tmp_path / "m")).rdd.getNumPartitions() > 4
        assert sorted((r.seq, r.order_id) for r in good.collect()) == [(i, i) for i in range(1, 2000)] and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "blank.csv").write_text("h\n1,1,1,0,5,5\n\n3,1,2,0,5,5\n")
    good, bad = tables.read_messages_csv(spark, str(tmp_path / "blank.csv"), "X")
    assert (good.count(), bad.count()) == (2, 0)


def test_messages_are_numbered_in_chunks(spark, tmp_path, monkeypatch):
    """Days and orders with many lines, repeated lines, lines without day or order: the numbers of one window by symbol, from many tasks."""
    draw = random.Random(3)
    day = lambda: draw.choice([None, *["1995-01-02"] * 3, "1995-01-05", "1996-07-01"])
    rows = [(draw.choice([None, *range(60)]), draw.randrange(4), 1, draw.randrange(8), 2.0, 50.0, draw.choice("AAR"), day()) for _ in range(1500)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, day string")
    lines.withColumn("l_shipdate", F.expr("cast(day as timestamp_ntz)")).drop("day").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(tables, "ROWS", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tables.messages(spark, str(tmp_path), by_symbol=False)
        assert rows_of(got) == rows_of(tables.messages(spark, str(tmp_path))) and got.count() == 1500
        assert got.filter("symbol = 'A'").groupBy(F.spark_partition_id().alias("p")).count().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["csv_messages", "csv_fallback"])
def test_numbered_messages_are_written_in_order_of_file_names(spark, name, monkeypatch):
    """Many small files: what is read back is in the order of seq, and the messages are computed once."""
    from tickforge.plans import catalog

    monkeypatch.setattr(tables, "FILE_ROWS", 300)
    monkeypatch.setattr(DataFrame, "orderBy", lambda *a: pytest.fail("sorts by a sample"))
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    found = catalog.QUERIES[name](spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE[name]})").fetchall())
    assert len(found.inputFiles()) > 6


def test_late_rows_are_dropped_once_their_window_is_closed(spark):
    from tickforge.plans import catalog

    for scale in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{scale}"
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        want = con.execute(catalog.ORACLE["stream_windows"]).fetchall()
        got = catalog.QUERIES["stream_windows"](spark, folder).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        closed = max(r.start for r in got) + 21600
        came = con.execute(f"SELECT count(*) FROM events WHERE epoch_us(ts) // 1000000 < {closed}").fetchall()[0][0]
        assert 0 < sum(r.n for r in got) < came
