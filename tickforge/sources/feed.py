"""Paged feeds as a Spark data source: ``spark.read.format("paged_feed")`` and ``spark.readStream.format("paged_feed")``.

A feed answers with up to ``limit`` records of a symbol from a cursor on: trades by id, candles by open time. Its pages
come from an address (``http://...``, with the parameters that exchanges use) or from a recording (a folder
written by ``record``, which all executors can open). Tasks read ranges of the cursor, so that a long history is fetched by many tasks at once; each goes on from the last
record's key plus one and stops at an empty page or its range's end. With ``pushdown`` conditions on the key and on the symbol narrow the
ranges before anything is fetched. Spark keeps what was pushed last with the loaded table, so a table that is opened with it takes one condition in a
plan; open it again for another. Without it any number will do.

As a stream the offset of each symbol is its next key. A micro-batch is a range of keys, so one that fails is fetched again
from its own start and nothing before it is. The first of a run reaches up to the newest key; ``keys_per_batch`` bounds those after it, for triggers that go on
(with ``availableNow`` a run would end after one of them).

Options: ``path``; ``kind`` (trades, candles); ``symbols`` (by comma; a recording's own if missing); ``limit`` of a page;
``start`` and ``end`` of the key, both included; ``last``: start so many keys before the newest; ``keys_per_task``; ``retries``; ``pushdown``.
"""

from __future__ import annotations

import glob
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed values of the feeds: where they answer, how they call the cursor, and the place of a record's key.
KINDS = {"trades": ("aggTrades", "fromId", "a"), "candles": ("klines", "startTime", 0)}
SCHEMAS = {
    "trades": "symbol string, a long, T long, p double, q double, m boolean",
    "candles": "symbol string, open_ms long, open double, high double, low double, close double, volume double",
}
KEYS = {"trades": "a", "candles": "open_ms"}


@dataclass
class Pages:
    """A feed's pages, one request at a time."""

    path: str
    kind: str
    limit: int = 1000
    retries: int = 3

    @property
    def recorded(self) -> str | None:
        where = urllib.parse.urlparse(self.path)
        return where.path if where.scheme in ("", "file") else None

    def key(self, record) -> int:
        return int(record[KINDS[self.kind][2]])

    def symbols(self) -> list[str]:
        if not self.recorded:
            raise ValueError(f"name the symbols of {self.path}, which does not list them")
        return sorted(os.path.basename(p).split("=", 1)[1] for p in glob.glob(f"{self.recorded}/symbol=*"))

    def fetch(self, symbol: str, cursor: int | None) -> list:
        """Up to ``limit`` records from the cursor on, in order of their keys; without a cursor the newest."""
        if self.recorded:
            return self._from_files(symbol, cursor)
        name, parameter, _ = KINDS[self.kind]
        asked = {"symbol": symbol, "limit": self.limit if cursor is not None else 1} | ({parameter: cursor} if cursor is not None else {})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(f"{self.path}/{name}?{urllib.parse.urlencode(asked)}", timeout=30) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.retries:
                    raise
                time.sleep(min(5.0, 0.1 * 2**attempt))
        return []

    def _from_files(self, symbol: str, cursor: int | None) -> list:
        pages = sorted(int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{self.recorded}/symbol={symbol}/page=*"))
        with open(f"{self.recorded}/span") as f:
            span = int(f.read())
        out: list = []
        for page in reversed(pages) if cursor is None else [p for p in pages if p >= cursor // span]:
            for name in sorted(glob.glob(f"{self.recorded}/symbol={symbol}/page={page}/part-*")):
                with open(name) as f:
                    out += [r for line in f for r in json.loads(line) if cursor is None or self.key(r) >= cursor]
            if out and (cursor is None or len(out) >= self.limit):
                break
        out.sort(key=self.key)
        return out[-1:] if cursor is None else out[: self.limit]

    def newest(self, symbol: str) -> int | None:
        found = self.fetch(symbol, None)
        return self.key(found[-1]) if found else None

    def range(self, symbol: str, first: int, last: int) -> Iterator:
        """All records with keys from first to last, page by page."""
        cursor = first
        while cursor <= last:
            page = self.fetch(symbol, cursor)
            if not page:
                return
            yield from (r for r in page if self.key(r) <= last)
            cursor = self.key(page[-1]) + 1


@dataclass
class KeyRange(InputPartition):
    symbol: str
    first: int
    last: int


class _Ranges:
    """What the two readers share."""

    def __init__(self, options: dict):
        self.options = options
        self.kind = options.get("kind", "trades")
        self.pages = Pages(options["path"], self.kind, int(options.get("limit", 1000)), int(options.get("retries", 3)))
        self.per_task = int(options.get("keys_per_task", 100_000 if self.kind == "trades" else 7 * 86_400_000))
        self.asked = [s.strip() for s in options["symbols"].split(",")] if options.get("symbols") else None

    def symbols(self) -> list[str]:
        return self.asked if self.asked is not None else self.pages.symbols()

    def first_key(self, newest: int) -> int:
        if "last" in self.options:
            return max(0, newest - int(self.options["last"]))
        return int(self.options.get("start", 0))

    def split(self, symbol: str, first: int, last: int) -> list[KeyRange]:
        return [KeyRange(symbol, at, min(at + self.per_task - 1, last)) for at in range(first, last + 1, self.per_task)]

    def rows(self, part: KeyRange) -> Iterator[tuple]:
        for r in self.pages.range(part.symbol, part.first, part.last):
            if self.kind == "trades":
                yield part.symbol, int(r["a"]), int(r["T"]), float(r["p"]), float(r["q"]), bool(r["m"])
            else:
                yield part.symbol, int(r[0]), *(float(x) for x in r[1:6])


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = _Ranges(options)
        self.least, self.most = None, int(options["end"]) if "end" in options else None
        self.only: set[str] | None = None
        self.narrows = options.get("pushdown") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the key and the symbol become ranges; Spark applies the rest."""
        key = (KEYS[self.ranges.kind],)
        for f in filters:
            if not self.narrows:
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)) and f.attribute == key and isinstance(f.value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    least = f.value + isinstance(f, GreaterThan)
                    self.least = least if self.least is None else max(self.least, least)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    most = f.value - isinstance(f, LessThan)
                    self.most = most if self.most is None else min(self.most, most)
            elif isinstance(f, EqualTo) and f.attribute == ("symbol",):
                self.only = {f.value} & (self.only if self.only is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("symbol",):
                self.only = {*f.value} & (self.only if self.only is not None else {*f.value})
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for symbol in self.ranges.symbols():
            if self.only is not None and symbol not in self.only:
                continue
            newest = self.ranges.pages.newest(symbol)
            if newest is not None:
                first = max(self.ranges.first_key(newest), self.least or 0)
                out += self.ranges.split(symbol, first, newest if self.most is None else min(newest, self.most))
        return out or [KeyRange("", 0, -1)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return self.ranges.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets: the next key of each symbol."""

    def __init__(self, options: dict):
        self.ranges = _Ranges(options)
        self.per_batch = int(options["keys_per_batch"]) if "keys_per_batch" in options else None
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {s: self.ranges.first_key(self.ranges.pages.newest(s) or 0) for s in self.ranges.symbols()}

    def latestOffset(self) -> dict:
        # a run doesn't tell where it starts before it asks where to end, so its first batch has no bound
        end = {}
        for s in self.ranges.symbols():
            newest = self.ranges.pages.newest(s)
            end[s] = 0 if newest is None else newest + 1
            if self.per_batch and s in self.reached:
                end[s] = min(end[s], self.reached[s] + self.per_batch)
            end[s] = max(end[s], self.reached.get(s, 0))
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for s, stop in end.items():
            # a symbol that the feed has only now begins with its first key
            out += self.ranges.split(s, start.get(s, self.ranges.first_key(0)), stop - 1)
        self.reached = dict(end)
        return out

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return self.ranges.rows(partition)

    def commit(self, end: dict) -> None:
        self.reached = {s: max(n, self.reached.get(s, 0)) for s, n in end.items()}


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "trades")]

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeed)


def record(records: DataFrame, key: F.Column, value: F.Column, folder: str, span: int) -> None:
    """Writes a feed's records (symbol, ``key``, and ``value``, the record as the feed gives it) as pages of ``span`` keys each.

    A page is a JSON array in order of the keys, and bounded, as keys are unique in a symbol.
    """
    page = F.floor(key / span).alias("page")
    in_order = F.sort_array(F.collect_list(F.struct(key.alias("key"), value.alias("r"))))
    rows = records.groupBy("symbol", page).agg(F.to_json(F.transform(in_order, lambda x: x["r"])).alias("value"))
    # a page is in one task, so it is one file
    rows.write.partitionBy("symbol", "page").text(folder)
    spark = records.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/span")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(str(span).encode()))
    out.close()


def trade_record() -> F.Column:
    """The ticks' columns as the exchange's trades."""
    return F.struct(F.col("seq").alias("a"), F.col("ts_ms").alias("T"), F.col("price").cast("string").alias("p"), F.col("volume").cast("string").alias("q"), F.col("is_buyer_maker").alias("m"))


def candle_record() -> F.Column:
    """Candles (time in seconds) as the exchange's arrays."""
    return F.array((F.col("time") * 1000).cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])


def opened(spark: SparkSession, folder: str, kind: str = "trades", pushdown: bool = False, **options) -> DataFrame:
    register(spark)
    rows = spark.read.format("paged_feed").options(path=folder, kind=kind, pushdown=str(pushdown).lower(), **options).load()
    # a condition that is always pushed, so that no plan meets what another has pushed
    return rows.filter(F.col(KEYS[kind]) >= 0) if pushdown else rows


def followed(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("paged_feed").options(path=folder, **options).load()
