"""Helpers that several corpus operators use: shared storage, global order, whole texts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only separator of words in the corpus contracts.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    It is set to a temporary folder only where it is unset and Spark runs in one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tickforge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_owned: set[str] = set()
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lost executors then cost no recomputation of it.

    All such tables of an application are in one folder that bears its id and that the driver deletes when it ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tickforge-{spark.sparkContext.applicationId}"
    if folder not in _owned:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _owned.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables have been stored."""
    return len(_written)


def dropped(spark: SparkSession, keep: DataFrame, since: int = 0) -> None:
    """Deletes the tables stored since the ``since``-th, but for those that ``keep`` reads.

    For a caller that has stored the outcome of a step and needs nothing that the step wrote on its way.
    """
    read = "\n".join(keep.inputFiles())
    for path in _written[since:]:
        if path.rsplit("/", 1)[-1] not in read:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def running_base(df: DataFrame, group: list[str], order: list[str], count: str, base: str) -> DataFrame:
    """Adds to a table of counts the sum of ``count`` over the earlier rows of its group.

    The groups have a row per file, size or block, never a row per document.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(base, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))


def ordered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` in one global order of ``keys``, stored, with ``shard`` and ``idx`` (ascending over all rows, with gaps).

    Range partitions are cut by sampled quantiles of all keys, so equal leading keys spread over many tasks.
    """
    in_order = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    idx = F.monotonically_increasing_id()
    return stored(in_order.select("*", F.spark_partition_id().alias("shard"), idx.alias("idx")), name)
