"""Operator 8, token ids as binary output: Simple-8b blocks in ascending document order.

The file format is a folder of Parquet files, one row per block. A block holds whole documents with about
``BLOCK_IDS`` ids in all (a longer document stands alone): ``shard`` and ``block`` give the order, ``before`` the ids of
the shard in front of it, ``doc_ids`` and ``sizes`` its documents, ``words`` the Simple-8b words and ``run_words`` the
first word of each run of 256 ids, so a reader may decode any run by itself.

Documents are dealt into shards by ranges of ``doc_id``, so only the text moves, once; Spark's writer commits whole
files, and a lost executor repeats its own tasks. Null texts are empty, a null ``doc_id`` comes first, rows of one
``doc_id`` follow by text. Other columns are not stored. An empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import bpe_ids, simple8b
from framelake.llm.shared import read, scratch
from framelake.llm.text_blocks import slices

END_ID = 0
BLOCK_IDS = 1 << 18

BLOCK_SCHEMA = ("shard int, block int, before long, n_ids long, doc_ids array<bigint>, sizes array<int>, run_words binary, "
                "words binary")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encodes ``text`` of all rows, appends ``end_id`` to each, and writes the blocks below ``path``."""
    vocabulary = vocabulary or bpe_ids.default_path()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = bpe_ids.encoder(vocabulary)
        end = np.array([end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        number = before = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held
            flat = np.concatenate(ids)
            words, runs = simple8b.encode(flat)
            row = [[shard], [number], [before], [len(flat)], [names[:]], [sizes[:]], [runs.astype("<i4").tobytes()],
                   [words.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(),
                     pa.binary()]
            number, before, held = number + 1, before + len(flat), 0
            ids.clear(), names.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)],
                                              ["shard", "block", "before", "n_ids", "doc_ids", "sizes", "run_words", "words"])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for name, got in zip(part.column("doc_id").to_pylist(), encoder.batch(texts), strict=True):
                    if held and held + len(got) >= block_ids:
                        yield flush()
                    ids += [got, end]
                    names.append(name)
                    sizes.append(len(got) + 1)
                    held += len(got) + 1
        if names:
            yield flush()

    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(blocks, BLOCK_SCHEMA).write.mode("overwrite").parquet(path))


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of every document of a batch of blocks."""
    for row in batch.to_pylist():
        words = np.frombuffer(row["words"], "<u8")
        ids = simple8b.decode(words, np.frombuffer(row["run_words"], "<i4"), row["n_ids"]).astype("<u4")
        at = 0
        for name, size in zip(row["doc_ids"], row["sizes"], strict=True):
            yield name, row["start"] + at, ids[at:at + size]
            at += size


def _read(spark: SparkSession, path: str, schema: str, make: Callable[[list], pa.RecordBatch]) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row per shard, that is per range partition of the writer: a bounded side.
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
              .select("shard", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield make(list(_documents(batch.slice(i, 1))))

    return (blocks.join(F.broadcast(starts), "shard")
            .select((F.col("_ahead") + F.col("before")).alias("start"), "n_ids", "doc_ids", "sizes", "run_words", "words")
            .mapInArrow(documents, schema))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document."""
    def rows(got: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
             pa.array([g[2].astype(np.int64) for g in got], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])
    return _read(spark, path, "doc_id long, start long, ids array<bigint>", rows)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    def rows(got: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
             pa.array([len(g[2]) for g in got], pa.int64()),
             pa.array([zlib.crc32(g[2].tobytes()) for g in got], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)


def store(docs: DataFrame) -> DataFrame:
    """Writes ``docs`` to a new folder and returns the digest read back."""
    path = scratch(docs.sparkSession, "simple8b")
    write_tokens(docs, path)
    return token_digest(docs.sparkSession, path)


def op8_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Simple-8b blocks and read back."""
    return store(read(spark, sf_dir, "documents"))


QUERIES = {"op8_simple8b_tokens": op8_simple8b_tokens}
ORACLES: dict[str, str] = {}
