"""Words dealt to blocks by hash, in packed rows: the numbers of many words in one binary column each.

A row of a word costs Spark some forty bytes for eight bytes of hash and a few small numbers; a packed row costs the
numbers alone. A block is a range of hashes, so sorted words are in order of blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct words of a block, about.
BLOCK_WORDS = 1 << 15
#: Type of the numbers in each binary column.
KINDS = {"hash": "<u8", "class": "u1", "pairs": "u1", "context": "u1", "n": "u1", "more": "<i8", "token": "u1", "rare": "<u4",
         "size": "<u4", "doc_id": "<i8", "marks": "u1", "known": "<i8", "base": "<f8", "emitted": "<f8"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def edges(block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, first, end) of each run of equal numbers."""
    if len(block):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        yield from zip(block[first].tolist(), first.tolist(), [*first[1:].tolist(), len(block)], strict=True)


def counts(n: np.ndarray) -> dict[str, np.ndarray]:
    """Columns ``n`` (one byte each) and ``more`` (those of 255 and above, whole)."""
    return {"n": np.minimum(n, 255), "more": n[n >= 255]}


def whole(row: dict) -> np.ndarray:
    """The numbers that ``counts`` was given."""
    n = row["n"].astype(np.int64)
    n[n == 255] = row["more"]
    return n


def batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    """Rows of numbers and numpy arrays as a record batch; columns that a row lacks are null."""
    types = dict(c.split() for c in schema.split(", "))

    def cell(row: dict, name: str):
        value = row.get(name)
        return value.astype(KINDS[name]).tobytes() if isinstance(value, np.ndarray) else value

    return pa.RecordBatch.from_arrays([pa.array([cell(r, c) for r in rows], _ARROW[t]) for c, t in types.items()], list(types))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of ``batch``, one at a time; nulls are left out."""
    for got in batches:
        for i in range(got.num_rows):
            row = {}
            for name, column in zip(got.schema.names, got.columns, strict=True):
                cell = column[i]
                if cell.is_valid:
                    row[name] = np.frombuffer(cell.as_buffer(), KINDS[name]) if name in KINDS else cell.as_py()
            yield row


def dealt(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one key in one task, behind each other."""
    return frame.repartition(key).sortWithinPartitions(key, *order)
