"""Paged feeds: cursors, ranges, pushed conditions, failures, and a stream that goes on where it was."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tickforge.sources import feed
from tickforge.streaming import live

IDS = {"A": [3, 4, 9, 10, 11, 40, 41, 99, 100, 250], "B": [0, 7], "C": []}


def trade(i):
    return {"a": i, "T": 1000 + i, "p": str(i / 2), "q": "0.5", "m": i % 2 == 0}


class Exchange:
    """A feed over HTTP that answers as exchanges do, notes what it was asked, and fails where it is told to."""

    def __init__(self):
        self.ids, self.asked, self.broken, self.flaky = {s: list(v) for s, v in IDS.items()}, [], set(), 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                asked = {k: v[0] for k, v in parse_qs(url.query).items()}
                symbol, limit = asked["symbol"], int(asked["limit"])
                cursor = int(asked["fromId"]) if "fromId" in asked else None
                outer.asked.append((symbol, cursor))
                ids = outer.ids[symbol]
                page = ids[-1:] if cursor is None else [i for i in ids if i >= cursor][:limit]
                if outer.flaky and cursor is not None:
                    outer.flaky -= 1
                    return self.send_error(503)
                if cursor is not None and any(i in outer.broken for i in page):
                    return self.send_error(500)
                body = json.dumps([trade(i) for i in page]).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.address = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def exchange():
    one = Exchange()
    yield one
    one.server.shutdown()


@pytest.fixture(params=["http", "recording"])
def place(request, spark, exchange, tmp_path):
    if request.param == "http":
        return exchange.address
    rows = [(s, i, json.dumps(trade(i))) for s, ids in IDS.items() for i in ids]
    value = F.from_json("j", "a long, T long, p string, q string, m boolean")
    feed.record(spark.createDataFrame(rows, "symbol string, a long, j string"), F.col("a"), value, str(tmp_path / "pages"), 50)
    return str(tmp_path / "pages")


def keys(df):
    return sorted((r.symbol, r.a) for r in df.collect())


ALL = sorted((s, i) for s, ids in IDS.items() for i in ids)


@pytest.mark.parametrize(("limit", "per_task"), [(1, 10_000), (3, 7), (1000, 1)])
def test_all_pages_are_read_once(spark, place, limit, per_task):
    got = feed.opened(spark, place, symbols="A, B,C", limit=limit, keys_per_task=per_task)
    assert keys(got) == ALL
    row = got.filter("a = 9").first()
    assert (row.symbol, row["T"], row.p, row.q, row.m) == ("A", 1009, 4.5, 0.5, False)


def test_ranges(spark, place):
    some = dict(symbols="A,B,C", limit=2, keys_per_task=60)
    assert keys(feed.opened(spark, place, start=10, end=100, **some)) == [(s, i) for s, i in ALL if 10 <= i <= 100]
    assert keys(feed.opened(spark, place, last=150, **some)) == [(s, i) for s, i in ALL if i >= {"A": 100, "B": 0}[s]]
    assert keys(feed.opened(spark, place, start=1000, **some)) == [] and keys(feed.opened(spark, place, symbols="C")) == []


def test_conditions_narrow_what_is_fetched(spark, exchange):
    rows, whole = (feed.opened(spark, exchange.address, symbols="A,B,C", limit=1000, keys_per_task=1000, pushdown=p) for p in (True, False))
    for condition, want in [
        ("a > 10 and a <= 99 and symbol = 'A'", [("A", 11), ("A", 40), ("A", 41), ("A", 99)]), ("a = 7", [("B", 7)]), ("symbol in ('B', 'C') and p < 1", [("B", 0)]),
        ("a < 4 and a >= 3", [("A", 3)]), ("symbol = 'A' and symbol = 'B'", []), ("a > 5 or symbol = 'B'", [x for x in ALL if x[1] > 5 or x[0] == "B"]),
    ]:
        exchange.asked.clear()
        assert keys(rows.filter(condition)) == want
        fetched = [(s, c) for s, c in exchange.asked if c is not None]
        if condition.startswith("a > 10 and"):
            assert set(fetched) <= {("A", 11), ("A", 251)} and ("A", 11) in fetched
        if condition.startswith("symbol in"):
            assert {s for s, _ in exchange.asked} <= {"B", "C"}
    assert keys(rows) == ALL
    assert keys(whole.filter("a = 7").union(whole.filter("a = 9")).union(whole)) == sorted([("B", 7), ("A", 9), *ALL])


def test_a_feed_that_stumbles_is_asked_again(spark, exchange):
    exchange.flaky = 2
    assert keys(feed.opened(spark, exchange.address, symbols="A,B,C")) == ALL
    exchange.broken = {41}
    with pytest.raises(Exception, match="500"):
        feed.opened(spark, exchange.address, symbols="A", retries=0, limit=2).collect()


def test_a_killed_stream_goes_on_at_its_cursor(spark, exchange):
    """Batches of bounded ranges; one fails; a new run reads from that batch's start on, nothing before it, and no row twice."""
    where = live.folder(spark)
    later = [i for i in exchange.ids["A"] if i > 41]
    exchange.ids["A"] = [i for i in exchange.ids["A"] if i <= 41]

    def start(trigger, **options):
        rows = feed.followed(spark, exchange.address, symbols="A,B", limit=2, retries=0, **options)
        return rows.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/log").trigger(**trigger).start()

    def done():
        return keys(spark.read.schema(feed.SCHEMAS["trades"]).parquet(f"{where}/rows"))

    running = start({"processingTime": "0 seconds"}, keys_per_batch=59)
    running.processAllAvailable()
    assert done() == [(s, i) for s, i in ALL if i <= 41]
    exchange.broken = {250}
    exchange.ids["A"] += later
    with pytest.raises(Exception, match="500"):
        running.processAllAvailable()
    assert done() == [(s, i) for s, i in ALL if i <= 100]
    exchange.broken.clear()
    exchange.asked.clear()
    exchange.ids["B"].append(300)  # and the feed has gone on
    start({"availableNow": True}).awaitTermination()
    assert min(c for s, c in exchange.asked if s == "A" and c is not None) > 100
    start({"availableNow": True}).awaitTermination()
    assert done() == sorted([*ALL, ("B", 300)])


def test_candles_by_open_time(spark, tmp_path):
    rows = [("X", 60 * k, 1.0 + k, 2.0 + k, 0.5, 1.5, 10.0) for k in range(30)]
    df = spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double")
    feed.record(df, F.col("time") * 1000, feed.candle_record(), str(tmp_path / "k"), 600_000)
    got = feed.opened(spark, str(tmp_path / "k"), kind="candles", limit=4, keys_per_task=300_000)
    assert rows_of(got.withColumn("time", (F.col("open_ms") / 1000).cast("long")).drop("open_ms")) == rows_of(df)
    assert got.filter("open_ms between 600000 and 1200000").count() == 11
