"""Token counts by an exact length histogram: what any context limit keeps and cuts, from one pass over the texts.

Defined cases: a null or empty text has length 0 (with ``end_ids`` appended ids, that many); repeated rows count
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encode import encoder, vocabulary
from .shared import running_base, stored, texts

#: Lengths a block: suffix sums run within blocks, and over the few block totals.
BLOCK = 256


def lengths(docs: DataFrame, vocab: str | None = None, end_ids: int = 0) -> DataFrame:
    """doc_id and encoded_length of every document, by whole texts."""
    vocab = vocab or vocabulary("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab).encode
        for batch in batches:
            n = np.fromiter((len(encode(t.as_py())) // 4 for t in batch.column(1)), np.int64, len(batch))
            yield pa.record_batch([batch.column(0), pa.array(n + end_ids)], names=["doc_id", "encoded_length"])

    return texts(docs).mapInArrow(count, "doc_id long, encoded_length long")


def histogram(counted: DataFrame) -> DataFrame:
    """Per encoded length: documents, tokens, and their sums over all lengths at least as long.

    ``tokens_kept`` is what stays when every document is cut at this length, ``share_within`` the share of documents
    that fit uncut. A row stands for every length up to the next one too.
    """
    # stored, as rows and block totals both come from it: the texts are encoded once; a row a length
    sizes = stored(counted.groupBy("encoded_length").agg(F.count("*").alias("n_docs")), "length-histogram")
    sizes = sizes.withColumns({"n_tokens": F.col("encoded_length") * F.col("n_docs"), "__block": F.floor(F.col("encoded_length") / BLOCK)})
    blocks = sizes.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("n_tokens").alias("__t"))
    blocks = blocks.withColumn("__down", -F.col("__block"))
    blocks = running_base(running_base(blocks, [], ["__down"], "__d", "__docs"), [], ["__down"], "__t", "__tokens")
    every = blocks.agg(F.sum("__d").alias("__all"))
    after = Window.partitionBy("__block").orderBy(F.desc("encoded_length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = sizes.join(F.broadcast(blocks.select("__block", "__docs", "__tokens")), "__block").crossJoin(F.broadcast(every))
    docs_ge = F.col("__docs") + F.sum("n_docs").over(after)
    tokens_ge = F.col("__tokens") + F.sum("n_tokens").over(after)
    out = joined.withColumns({"docs_at_least": docs_ge, "tokens_at_least": tokens_ge})
    longer = F.col("docs_at_least") - F.col("n_docs")
    return out.select(
        "encoded_length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("encoded_length") * F.col("docs_at_least")).alias("tokens_of_full_length"),
        longer.alias("docs_cut"), (F.col("tokens_at_least") - F.col("n_tokens") - F.col("encoded_length") * longer).alias("tokens_cut"),
        (1 - longer / F.col("__all")).alias("share_within"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens cut by it, from the histogram alone."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    over = hist.join(F.broadcast(wanted), F.col("encoded_length") > F.col("context_limit"))
    cut = over.groupBy("context_limit").agg(F.sum("n_docs").alias("docs_cut"), F.sum((F.col("encoded_length") - F.col("context_limit")) * F.col("n_docs")).alias("tokens_cut"))
    total = hist.agg(F.sum("n_tokens").alias("tokens_all"))
    out = wanted.join(cut, "context_limit", "left").crossJoin(total).fillna(0)
    return out.withColumn("tokens_kept", F.col("tokens_all") - F.col("tokens_cut"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the smallest length within which at least that share of documents lies."""
    wanted = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return hist.join(F.broadcast(wanted), F.col("share_within") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("encoded_length").alias("encoded_length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
