"""Prefix scans: ordered recursions whose segments compose.

Where one step of a recursion is a map (y -> a y + b, a gain curve, a change of a stack), a whole segment is a map as well, and maps
compose in any grouping. So a key of any length takes three steps, whatever the data:

1. every segment is summed up as its map, in one pass over its rows in order (``fold_segments``);
2. the maps of all earlier segments are composed for each segment (``prefixes``), in a tree of ``FAN`` segments a node, so that no task
   sees more than ``FAN`` maps of a key at a time;
3. every segment is walked again from its true start.

Nothing is repeated, guessed or warmed up, and the result does not depend on where segments end. Maps are bytes; the first segments of a
key start from None. Both passes stream over Arrow batches: memory holds a batch and a map, not a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import SEG, SEGMENT_ROWS, segment_of, stored

PREFIX, ROW, MAP = "_prefix", "_row", "_map"
FAN = 64

Batches = Iterator[pa.RecordBatch]
#: what becomes of one segment: (its rows in order, map of everything before it or None) -> output batches
Walk = Callable[[Batches, bytes | None], Batches]
Compose = Callable[[bytes, bytes], bytes]


def _slices(batches: Batches, group: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the group changes, with the group's values."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n, bool)
        for name in group:
            c = batch.column(name)
            new = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            empty = c.is_null().to_numpy(zero_copy_only=False)
            changed[1:] |= new | (empty[1:] != empty[:-1])
        starts = [0, *np.flatnonzero(changed).tolist(), n]
        for low, high in zip(starts[:-1], starts[1:]):
            yield tuple(batch.column(name)[low].as_py() for name in group), batch.slice(low, high - low)


def fold_segments(rows: DataFrame, starts: DataFrame | None, group: Sequence[str], order: Sequence[str], walk: Walk, schema: str) -> DataFrame:
    """Walks every group once in order. ``starts`` holds the group's columns and ``_prefix``, which the walk gets.

    The start travels as one more row in front of its group, so that it is not copied to every row.
    """
    group = list(group)
    marked = rows.withColumns({PREFIX: F.lit(None).cast("binary"), ROW: F.lit(1)})
    if starts is not None:
        marked = marked.unionByName(starts.withColumn(ROW, F.lit(0)), allowMissingColumns=True)

    def run(batches: Batches) -> Batches:
        for _, parts in groupby(_slices(batches, group), key=lambda part: part[0]):
            pieces = (batch for _, batch in parts)
            first = next(pieces)
            prefix = None
            if first.column(ROW)[0].as_py() == 0:
                prefix = first.column(PREFIX)[0].as_py()
                first = first.slice(1)
            body = _with_first(first, pieces)
            head = next(body, None)
            if head is not None:
                yield from walk(_with_first(head, body), prefix)

    return marked.repartition(*group).sortWithinPartitions(*group, ROW, *order).mapInArrow(run, schema)


def _with_first(first: pa.RecordBatch, rest: Batches) -> Batches:
    if first.num_rows:
        yield first
    for batch in rest:
        if batch.num_rows:
            yield batch


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def summaries(cut: DataFrame, group: Sequence[str], order: Sequence[str], summarise: Callable[[Batches, bytes | None], bytes],
              starts: DataFrame | None = None) -> DataFrame:
    """One row per segment: its group and its ``_map``."""
    group = list(group)

    def walk(batches: Batches, prefix: bytes | None) -> Batches:
        first = next(batches)
        names = [first.column(n).slice(0, 1) for n in group]
        found = summarise(_with_first(first, batches), prefix)
        yield pa.RecordBatch.from_arrays([*names, pa.array([found], pa.binary())], [*group, MAP])

    return stored(fold_segments(cut, starts, group, order, walk, f"{_fields(cut, group)}, {MAP} binary"))


def prefixes(maps: DataFrame, keys: Sequence[str], compose: Compose, fan: int = FAN) -> DataFrame:
    """keys, ``_seg`` and ``_prefix``: the composition of the maps of all earlier segments (no row for the first of a key)."""
    keys = list(keys)
    width = maps.agg(F.max(SEG) - F.min(SEG)).first()[0]
    parent = "_parent"
    cut = maps.withColumn(parent, F.expr(f"{SEG} div {fan}L"))
    group = keys + [parent]
    starts = None
    if width is not None and width >= fan:
        def whole(batches: Batches, prefix: bytes | None) -> bytes:
            out = None
            for batch in batches:
                for one in batch.column(MAP):
                    out = one.as_py() if out is None else compose(out, one.as_py())
            return out

        above = summaries(cut.select(*group, SEG, MAP), group, [SEG], whole).withColumnRenamed(parent, SEG)
        starts = prefixes(above, keys, compose, fan).withColumnRenamed(SEG, parent)
    elif width is not None:
        cut, group = cut.withColumn(parent, F.lit(0).cast("bigint")), keys + [parent]

    def running(batches: Batches, prefix: bytes | None) -> Batches:
        before = prefix
        for batch in batches:
            found = []
            for one in batch.column(MAP):
                found.append(before)
                before = one.as_py() if before is None else compose(before, one.as_py())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column(SEG), pa.array(found, pa.binary())],
                                             [*keys, SEG, PREFIX])

    out = fold_segments(cut.select(*group, SEG, MAP), starts, group, [SEG], running,
                        f"{_fields(cut, keys + [SEG])}, {PREFIX} binary")
    return out.where(F.col(PREFIX).isNotNull())


def scan(df: DataFrame, keys: Sequence[str], position: str, summarise: Callable[[Batches, bytes | None], bytes], compose: Compose, walk: Walk,
         schema: str, rows: int = SEGMENT_ROWS, fan: int = FAN) -> DataFrame:
    """All three steps. ``df`` should hold only what the recursion needs."""
    keys = list(keys)
    cut = df.withColumn(SEG, segment_of(position, rows))
    group = keys + [SEG]
    starts = prefixes(summaries(cut, group, [position], summarise), keys, compose, fan)
    return fold_segments(cut, starts, group, [position], walk, schema)


# ---- affine maps --------------------------------------------------------------------------

def affine(factor: np.ndarray | float, offset: np.ndarray) -> bytes:
    """The map y -> factor * y + offset; the factor is one number, the offset one per element."""
    return np.concatenate([[factor], np.ravel(offset)]).astype("<f8").tobytes()


def read_affine(held: bytes) -> tuple[float, np.ndarray]:
    values = np.frombuffer(held, "<f8")
    return float(values[0]), values[1:]


def compose_affine(first: bytes, second: bytes) -> bytes:
    """``second`` after ``first``; a factor of 0 forgets what was before, whatever its size."""
    (a, b), (c, d) = read_affine(first), read_affine(second)
    return affine(a * c, c * b + d) if c else second


# ---- rising curves ------------------------------------------------------------------------

class Curve:
    """A continuous, rising, piecewise-linear map on a closed range, by its corners; one corner is a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def __call__(self, x):
        return np.interp(x, self.x, self.y)

    def then(self, other: Curve) -> Curve:
        """``other`` after this one: corners of this curve, and where it passes a corner of the other."""
        if len(self.x) == 1:
            return Curve(self.x, np.atleast_1d(other(self.y)))
        passed = other.x[(other.x > self.y[0]) & (other.x < self.y[-1])]
        x = np.union1d(self.x, np.interp(passed, self.y, self.x))
        y = np.atleast_1d(other(self(x)))
        rising = np.append(True, y[1:] > y[:-1])
        return Curve(x[rising], y[rising])

    def packed(self) -> bytes:
        return np.concatenate([self.x, self.y]).astype("<f8").tobytes()

    @staticmethod
    def read(held: bytes) -> Curve:
        return Curve(*np.split(np.frombuffer(held, "<f8"), 2))

    @staticmethod
    def compose(first: bytes, second: bytes) -> bytes:
        return Curve.read(first).then(Curve.read(second)).packed()
