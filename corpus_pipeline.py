"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again. All
but the last return the columns of documents; the last returns the packed pieces.

Defined cases: a null or empty text is scored as a document of no words and, if kept, has no lines to lose, shares one
fingerprint with all others of its kind (one of them stays), has size 0, so that the mix leaves it out where its source
has no words, and packs as the end id alone. Rows without doc_id or under a shared one are told apart by their text,
and no text is lost to an unlike one; repeated rows are near-duplicates of each other. A null source is a source. Columns
beyond those of documents go along to the mix. With no labels every document scores 0.5 and stays; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import op02_quality, op05_simhash, op06_line_dedup, op07_packing, op09_mixing
from tickforge.llm.shared import dropped, stored, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return op02_quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go."""
    return op06_line_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose SimHash fingerprints link or whose sets of five-word shingles are alike at 0.8 or more."""
    return op05_simhash.keep_one(docs, similar=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return op09_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and place."""
    return op07_packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage and the one before it have left in the shared folder
        dropped(spark, docs, begun)
    return docs
