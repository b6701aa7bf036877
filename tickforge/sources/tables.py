"""Readers and writers of market data, and the tables that the fixtures stand in for.

Prices of ``ticks`` are exact integer cents beside their value, so that sums over windows are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.operators.chunks import CHUNK, ROWS, chunk_of

MESSAGE = "timestamp long, type int, order_id long, side int, price long, qty long, _corrupt_record string"
TRADE = "a long, T long, p string, q string, m boolean"
KLINE = "array<string>"
#: Lines of a CSV file of messages that are numbered without gaps.
FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Readers


def message_path(spark: SparkSession, folder: str, symbol: str, fallback: str = "test_data.csv") -> str:
    """The symbol's file in a folder of any file system Spark knows, or the fallback if it has none."""
    clean = symbol.replace("/", "").replace("-", "")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{clean}.csv")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return f"{folder}/{clean}.csv" if found else f"{folder}/{fallback}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and seq, the number of each line from 0, over the files in the order of their names.

    Lines are numbered in the task that reads them; the lines of earlier splits, a row a split, are summed beside it.
    """
    place = ["__file", "__start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy(*place).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1))
    based = splits.select(*place, "__first", F.coalesce(before, F.lit(0)).alias("__base"))
    return lines.join(F.broadcast(based), place).select((F.col("__id") - F.col("__first") + F.col("__base")).alias("seq"), "value")


def read_messages_csv(spark: SparkSession, path: str, symbol: str, skip_first_row: bool = True) -> tuple[DataFrame, DataFrame]:
    """Six integers a line without header: the messages in file order, and the rejected lines. Blank lines are neither.

    The first line is skipped as the reference loader does, unless told otherwise.
    """
    lines = numbered_lines(spark, path).filter((F.col("seq") >= (1 if skip_first_row else 0)) & (F.trim("value") != ""))
    read = lines.select("seq", "value", F.from_csv("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("m"))
    good = F.col("m._corrupt_record").isNull()
    return read.filter(good).select("seq", F.lit(symbol).alias("symbol"), "m.*").drop("_corrupt_record"), read.filter(~good).select("seq", "value")


def write_messages_csv(messages: DataFrame, path: str, one_file: bool = False, n: int | None = None) -> None:
    """The six integers a line, no header, in the order of seq: in files whose names follow that order, or in one.

    ``n``: the numbers are 1 to n, so that rows are dealt to files by them and needn't be sampled, which would compute them twice.
    """
    if n is None or one_file:
        rows = messages.orderBy("seq")
    else:
        nth = F.floor((F.col("seq") - 1) / FILE_ROWS).cast("int")
        rows = messages.repartitionById(-(-n // FILE_ROWS) or 1, nth).sortWithinPartitions("seq")
    rows = rows.select("timestamp", "type", "order_id", "side", "price", "qty")
    (rows.coalesce(1) if one_file else rows).write.csv(path, header=False)


def read_trades_json(spark: SparkSession, path: str) -> DataFrame:
    """Aggregate trades, a JSON object a line: a id, T ms, p price, q quantity, m buyer is maker."""
    rows = spark.read.schema(TRADE).json(path)
    return rows.select("a", "T", F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q"), "m")


def read_klines_json(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Candles as positional JSON arrays, one a line: open time in ms, open, high, low, close, volume."""
    row = F.from_json("value", KLINE)
    cells = [F.get(row, i).cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    return spark.read.text(path).select(F.lit(symbol).alias("symbol"), F.get(row, 0).cast("long").alias("open_ms"), *cells)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Hyperparameters beside a model file, or beside all of a folder (with what the folder's names tell, such as ``symbol=...``)."""
    return spark.read.option("multiLine", True).schema("max_inventory double, base_trade_size double, kappa double").json(path)


def append_registry(rows: DataFrame, path: str) -> None:
    """Registry rows are only ever added."""
    rows.write.mode("append").partitionBy("symbol").parquet(path)


# Tables made of the fixtures


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, symbol, ts_ms, cents, price, lots (volume in hundredths), volume, is_buyer_maker."""
    e = table(spark, sf_dir, "events")
    cents = F.lit(6_000_000) + F.floor(F.round(F.col("value") * 100).cast("long") / 10.0).cast("long")
    lots = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        cents.alias("cents"), (cents / 100.0).alias("price"), lots.alias("lots"), (lots / 100.0).alias("volume"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the events' own small prices."""
    e = table(spark, sf_dir, "events")
    lots = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("value").alias("price"), lots.alias("lots"), (lots / 100.0).alias("volume"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), F.col("ts").alias("at"),
    )


def _numbered_in_chunks(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds seq, the number of each line of its key in order, by chunks of a value of the first order column and a range of the second.

    A row a chunk tells how many lines of its key are before it. It lies first in its chunk, so that all is dealt once and nothing is joined.
    """
    chunk = [key, order[0], CHUNK]
    dealt = lines.withColumn(CHUNK, chunk_of(order[1], ROWS))
    before = Window.partitionBy(key).orderBy(order[0], CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*chunk).agg(F.count("*").alias("__n")).select(*chunk, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rows = bases.unionByName(dealt, allowMissingColumns=True)
    w = Window.partitionBy(*chunk).orderBy(F.col("__base").isNull(), *order[1:])
    numbered = rows.withColumn("seq", F.first("__base").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(w) - 1)
    return numbered.filter(F.col("__base").isNull()).drop("__base", CHUNK)


def messages(spark: SparkSession, sf_dir: str, by_symbol: bool = True) -> DataFrame:
    """Order messages: lines of an order below 6 add, 6 cancels and 7 executes an earlier message's id.

    ``by_symbol``: a symbol's rows stay together in order, for a fold to read; otherwise they are dealt in chunks.
    """
    x = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", *[c for c in x.columns if c not in ("l_shipdate", "l_returnflag")]]
    if by_symbol:
        seq = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(*order)).cast("long")
        x = x.withColumn("seq", seq)
    else:
        x = _numbered_in_chunks(x, "l_returnflag", order)
    kind = F.when(F.col("l_linenumber") < 6, 1).when(F.col("l_linenumber") == 6, 2).otherwise(3)
    earlier = F.greatest(F.col("seq") - 1 - F.col("l_partkey") % 50, F.lit(0))
    return x.select(
        "seq", F.col("l_returnflag").alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), kind.alias("type"),
        F.when(kind == 1, F.col("seq")).otherwise(earlier).alias("order_id"), (F.col("l_suppkey") % 2).cast("int").alias("side"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("price"), F.col("l_quantity").cast("long").alias("qty"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model registry rows; the JSON of hyperparameters is whole, partial, empty or missing in turn."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    inventory, size, kappa = (key % 7 + 4).cast("string"), (key % 5 + 1).cast("string"), (key % 3 + 1).cast("string")
    whole = F.concat(F.lit('{"max_inventory": '), inventory, F.lit('.0, "base_trade_size": 0.'), size, F.lit(', "kappa": '), kappa, F.lit(".5}"))
    part = F.concat(F.lit('{"max_inventory": '), inventory, F.lit(".0}"))
    return s.select(
        key.alias("id"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string"), F.lit("-usd/t")).alias("raw_symbol"),
        F.concat(F.lit("model_"), key.cast("string")).alias("model_filename"),
        F.when(key % 4 == 0, whole).when(key % 4 == 1, part).when(key % 4 == 2, F.lit("{}")).alias("hyperparameters"),
        (F.lit(1_700_000_000) + key * 7919 % 100_003).alias("created_at"),
    )
