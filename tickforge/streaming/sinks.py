"""What a stream is written to: many subscribers, the newest row by key, candles kept up to date.

All writers go by micro-batch and number, and a batch that is run again after a failure replaces what its first run wrote, so
that no row is there twice. Each is a function for ``foreachBatch`` over a folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(rows: DataFrame, folder: str, batch: int) -> None:
    """Rows of one batch into their own part of a table, in place of any earlier try."""
    rows.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")


def table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All batches of a table, with ``batch``; empty if none was written."""
    path, files = _files(spark, folder)
    kind = spark.createDataFrame([], schema).schema
    if not files.exists(path):
        return spark.createDataFrame([], kind.add(BATCH, "long"))
    return spark.read.schema(kind.add(BATCH, "long")).option("basePath", folder).parquet(folder)


class FanOut:
    """One stream to several subscribers.

    Each has a name and a function that makes its rows from a batch; they go to ``folder/name``. A batch is computed once and kept while it is sent.
    A subscriber that fails is dropped, the rest go on: its name and error lie in ``folder/_dropped``, so a stream that starts anew
    leaves it out too. ``readmit`` lets it come back; it has missed what came meanwhile.
    """

    def __init__(self, folder: str, subscribers: dict[str, Callable[[DataFrame], DataFrame]]):
        self.folder, self.subscribers = folder, subscribers

    def dropped(self, spark: SparkSession) -> dict[str, str]:
        path, files = _files(spark, f"{self.folder}/_dropped")
        if not files.exists(path):
            return {}
        return {r["name"]: r.error for r in spark.read.schema("name string, error string").json(f"{self.folder}/_dropped/*").collect()}

    def readmit(self, spark: SparkSession, name: str) -> None:
        path, files = _files(spark, f"{self.folder}/_dropped/{name}")
        files.delete(path, True)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        gone = self.dropped(spark)
        rows.persist()
        try:
            # what fails here is the stream's own fault, no subscriber's
            rows.count()
            for name, make in self.subscribers.items():
                if name in gone:
                    continue
                try:
                    written(make(rows), f"{self.folder}/{name}", batch)
                except Exception as error:  # whatever a subscriber does, the others get theirs
                    path, files = _files(spark, f"{self.folder}/{name}/{BATCH}={batch}")
                    files.delete(path, True)
                    told = spark.createDataFrame([(name, str(error)[:500])], "name string, error string")
                    told.coalesce(1).write.mode("overwrite").json(f"{self.folder}/_dropped/{name}")
        finally:
            rows.unpersist()


# The newest row by key


def conflated(ticks: DataFrame, millis: int) -> DataFrame:
    """Over a stream of ticks (symbol, seq, ts_ms, price), in update mode: the newest of each symbol and slot of time, whenever it changes.

    The watermark lets the state forget slots that are a day past.
    """
    rows = ticks.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "1 day")
    newest = F.max_by(F.struct("seq", "ts_ms", "price"), "seq").alias("newest")
    return rows.groupBy("symbol", F.window("at", f"{millis} milliseconds").alias("slot")).agg(newest).select("symbol", F.unix_millis("slot.start").alias("slot_ms"), "newest.*")


def newest(spark: SparkSession, folder: str, keys: list[str], order: str, schema) -> DataFrame:
    """The table's newest row for each key: updates that were appended are merged when read, so repeats do no harm."""
    rows = table(spark, folder, schema).drop(BATCH)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


# Candles kept up to date

PARTIAL = "symbol string, time long, open_seq long, open double, high double, low double, close_seq long, close double, lots long"


def partial_candles(ticks: DataFrame, seconds: int) -> DataFrame:
    """What a part of the ticks adds to each candle: enough to merge with other parts, whichever way the ticks are cut."""
    time = (F.floor(F.col("ts_ms") / (seconds * 1000)) * seconds).cast("long").alias("time")
    return ticks.groupBy("symbol", time).agg(
        F.min("seq").alias("open_seq"), F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max("seq").alias("close_seq"), F.max_by("price", "seq").alias("close"), F.sum("lots").alias("lots"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Parts of candles, added up: parts again."""
    return parts.groupBy("symbol", "time").agg(
        F.min("open_seq").alias("open_seq"), F.min_by("open", "open_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("close_seq").alias("close_seq"), F.max_by("close", "close_seq").alias("close"), F.sum("lots").alias("lots"),
    )


class CandleStore:
    """Candles of one width in a folder: parts are appended by batch under their day, merged when read, and compacted by day.

    ``days/day=D/batch=B`` holds what batch B adds to the candles of day D. ``compact`` puts a day's parts together under the number of its latest batch, which
    then stands for all up to it: a batch run again after that is known by its number and left out.
    """

    DAY = 86_400

    def __init__(self, spark: SparkSession, folder: str, seconds: int):
        self.spark, self.folder, self.seconds = spark, folder, seconds

    def add(self, ticks: DataFrame, batch: int) -> None:
        parts = partial_candles(ticks, self.seconds).withColumn("day", F.floor(F.col("time") / self.DAY)).withColumn(BATCH, F.lit(batch).cast("long"))
        # days that are compacted up to this batch or beyond have it already
        if (done := self._compacted()) is not None:
            parts = parts.join(done.filter(F.col("upto") >= batch), "day", "left_anti")
        path = f"{self.folder}/days"
        # one of each day and batch: a rerun replaces exactly what the first run wrote
        parts.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", BATCH).parquet(path)

    __call__ = add

    def _exists(self, name: str) -> bool:
        path, files = _files(self.spark, f"{self.folder}/{name}")
        return files.exists(path)

    def _compacted(self) -> DataFrame | None:
        """day, upto: a row a compacted day."""
        return self.spark.read.schema("upto long, day long").parquet(f"{self.folder}/compacted").select("day", "upto").distinct() if self._exists("compacted") else None

    def parts(self) -> DataFrame:
        """All parts that count: of a compacted day the whole, and what came after it."""
        schema = f"{PARTIAL}, day long, {BATCH} long"
        if not self._exists("days"):
            return self.spark.createDataFrame([], PARTIAL)
        new = self.spark.read.schema(schema).parquet(f"{self.folder}/days")
        if not self._exists("compacted"):
            return new.drop("day", BATCH)
        old = self.spark.read.schema(f"{PARTIAL}, upto long, day long").parquet(f"{self.folder}/compacted")
        ahead = new.join(self._compacted(), "day", "left").filter(F.col("upto").isNull() | (F.col(BATCH) > F.col("upto")))
        return old.drop("upto", "day").unionByName(ahead.drop("upto", "day", BATCH))

    def read(self) -> DataFrame:
        """symbol, time, open, high, low, close, volume, as of the last batch."""
        return merged(self.parts()).select("symbol", "time", "open", "high", "low", "close", (F.col("lots") / 100.0).alias("volume"))

    def compact(self, before: Column | None = None) -> None:
        """Puts together the parts of the days for which ``before`` (over the column ``day``) holds, all if it is missing.

        The whole of a day replaces the last whole of it in one overwrite of its partition; its parts are known from then on by their numbers, so
        a failure in between leaves nothing out and counts nothing twice. Parts that are in a whole are then deleted.
        """
        if not self._exists("days"):
            return
        schema = f"{PARTIAL}, day long, {BATCH} long"
        new = self.spark.read.schema(schema).parquet(f"{self.folder}/days").filter(F.lit(True) if before is None else before)
        upto = new.groupBy("day").agg(F.max(BATCH).alias("upto"))
        known = self._compacted()
        parts = new
        if known is not None:
            upto = upto.join(known.withColumnRenamed("upto", "was"), "day", "left").select("day", F.greatest("upto", "was").alias("upto"))
            parts = new.join(known, "day", "left").filter(F.col("upto").isNull() | (F.col(BATCH) > F.col("upto"))).drop("upto")
            old = self.spark.read.schema(f"{PARTIAL}, upto long, day long").parquet(f"{self.folder}/compacted").drop("upto")
            parts = parts.drop(BATCH).unionByName(old.join(upto.select("day"), "day", "left_semi"))
        whole = merged(parts).withColumn("day", F.floor(F.col("time") / self.DAY)).join(upto, "day")
        # read in full before its partitions are overwritten
        staged = f"{self.folder}/staged"
        whole.write.mode("overwrite").parquet(staged)
        again = self.spark.read.schema(whole.schema).parquet(staged)
        again.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/compacted")
        for r in new.select("day", BATCH).distinct().collect():  # a row a day and batch
            path, files = _files(self.spark, f"{self.folder}/days/day={r.day}/{BATCH}={r[BATCH]}")
            files.delete(path, True)
        path, files = _files(self.spark, staged)
        files.delete(path, True)
