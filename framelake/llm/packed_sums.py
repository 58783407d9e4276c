"""Sums of large arrays over all tasks, as packed rows: (block, values)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "block int, sums binary"
SALTS = 8


def packed(values: np.ndarray, kind: str, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one task: ``values`` cut into blocks of ``block`` numbers of type ``kind`` (say ``<f8``)."""
    for k in range(0, len(values), block):
        yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([values[k:k + block].astype(kind).tobytes()],
                                                                                      pa.binary())], ["block", "sums"])


def total(rows: DataFrame, size: int, kind: str, block: int, tasks: int | None = None) -> np.ndarray:
    """The sum of the tasks' arrays of ``size`` numbers; ``size`` is fixed by the model, not by the corpus.

    Blocks are added in two steps, one at a time, so that no task holds those of all others. The last step has SALTS rows a block and is
    read task by task: ``tasks`` says how many, else there is one for each shuffle partition, most of them empty where blocks are few.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                got = np.frombuffer(sums.as_buffer(), kind)
                held[number] = held[number] + got if number in held else got
        for number, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([got.tobytes()], pa.binary())], ["block", "sums"])

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(SALTS)).cast("int"))
    some = salted.repartition("block", "salt").select("block", "sums").mapInArrow(add, SCHEMA)
    out = np.zeros(size, np.dtype(kind))
    last = some.repartition("block")
    for row in (last.coalesce(tasks) if tasks else last).mapInArrow(add, SCHEMA).toLocalIterator():
        got = np.frombuffer(row["sums"], kind)
        out[row["block"] * block:row["block"] * block + len(got)] += got
    return out
