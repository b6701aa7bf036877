"""Token-ID files: documents as Simple-8b words in ascending doc_id order, and their reader.

A file is a Parquet file of one row per document: shard (the file's place in the order), doc_id, local_start (ids of
the shard before it), n_tokens, words (little-endian 64-bit Simple-8b words), block_offsets (unsigned 32-bit ids
before each block of 128 words) and escapes (raw 64-bit values). Writing through Spark's committed Parquet output
keeps the files whole when executors are lost.

Defined cases: a null or empty text has only the end id; equal doc_ids keep all their rows, ordered by the
hash of the text, then by text; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .encode import encoder, vocabulary
from .shared import running_base, stored, texts

FILE_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, words binary, block_offsets binary, escapes binary"
#: Ids that one pass of the coder holds.
SLICE_IDS = 2_000_000


def _binary(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """Rows of a flat array as a binary column, without copying each."""
    offsets = np.concatenate([[0], np.cumsum(per_row)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(per_row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one flat array and the number of values a row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // size


def write_ids(docs: DataFrame, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` and writes the files; returns them as read back by Spark."""
    vocab = vocab or vocabulary("word_bpe_49k.json")
    end = np.uint32(end_id).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, start = encoder(vocab).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, rows = batch.column(0), []
            size = first = 0
            for i, text in enumerate(batch.column(1)):
                rows.append(encode(text.as_py()) + end)
                size += len(rows[-1]) // 4
                if size >= SLICE_IDS or i + 1 == len(batch):
                    lengths = np.array([len(r) // 4 for r in rows], np.int64)
                    words, n_words, offsets, n_blocks, escapes, n_escapes = simple8b.encode(np.frombuffer(b"".join(rows), "<u4"), lengths)
                    starts = start + np.cumsum(lengths) - lengths
                    start += int(lengths.sum())
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(rows), shard, np.int32)),
                            keys.slice(first, len(rows)),
                            pa.array(starts),
                            pa.array(lengths),
                            _binary(words, n_words),
                            _binary(offsets, n_blocks),
                            _binary(escapes, n_escapes),
                        ],
                        names=["shard", "doc_id", "local_start", "n_tokens", "words", "block_offsets", "escapes"],
                    )
                    rows, size, first = [], 0, i + 1

    # with the hash, rows of one id, or of none, spread over many files
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    in_order = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stored(in_order.mapInArrow(pack, FILE_SCHEMA), "token-files")


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start over all files, n_tokens and the ids' crc32, all from the stored words."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                shard, doc_id, start, lengths = (part.column(k) for k in range(4))
                words, n_words = _flat(part.column(4), "<u8")
                escapes, n_escapes = _flat(part.column(6), "<u8")
                n = lengths.to_numpy()
                ids = simple8b.decode(words, n_words, n, escapes, n_escapes).astype("<u4").tobytes()
                ends = np.cumsum(n) * 4
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n * 4).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([shard, doc_id, start, lengths, pa.array(crcs, pa.int64())], names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(unpack, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    # one row a file: read from the files' own counts, and as many as there are shuffle partitions at most
    totals = running_base(files.groupBy("shard").agg(F.sum("n_tokens").alias("__n")), [], ["shard"], "__n", "__base")
    start = (F.col("local_start") + F.col("__base")).alias("start")
    return rows.join(F.broadcast(totals), "shard").select("doc_id", start, "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")))
