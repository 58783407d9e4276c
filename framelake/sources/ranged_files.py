"""Containers scanned in place: headers by ranged reads, long archives in byte ranges.

Spark lists the files (their bytes are never a column) and deals them out; tasks then read the few bytes they need through Arrow's file
systems (local paths, HDFS, S3, GCS). A container of any size is therefore no large row, and an archive is many tasks.

*Boxes* of an MP4 file are found by their headers, one after the other, with one small read each.

*Packets* of an IVF archive follow one another without markers. Each byte range looks for the first place from which several packet headers
in a row make sense, walks from there, and reports where it began and which packet begins after it. Ranges are then held against each other:
a range is right if it began where the range before it ended. One that was misled (packets may hold anything, even whole
archives) is walked again from the right place, until all agree. So the result never depends on the guess; the guess only lets the ranges
of a file be read at the same time.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators.ordered import stored
from framelake.sources.media_files import BOX_SCHEMA, boxes_of

RANGE_BYTES = 64 << 20
LOOK_BYTES = 1 << 20
#: packet headers in a row that must make sense where a range begins in the middle
AGREEING = 4
HEADER, PACKET_HEADER = 32, 12
STOPPED = -1

_RANGE = "path string, length bigint, range_no bigint, begin bigint, until bigint, start bigint, next bigint, packets bigint"
PACKETS = "path string, packet_no bigint, offset bigint, length bigint, ts bigint, pts_ms double"


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and length of files; contents are not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def scan_mp4_files(files: DataFrame) -> DataFrame:
    """Top-level boxes of (path, length), as ``scan_mp4_boxes`` gives them; feeds ``audit_mp4``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with _open(path) as file:
                    rows = [{"path": path, **row} for row in boxes_of(lambda offset, n, file=file: file.read_at(n, offset), length)]
                if rows:
                    yield _batch(rows, BOX_SCHEMA)

    return files.select("path", "length").mapInArrow(run, BOX_SCHEMA)


# ---- IVF archives -------------------------------------------------------------------------

Read = Callable[[int, int], bytes]


def _header(read: Read, at: int, length: int) -> tuple[int, int] | None:
    """Size and time of the packet at ``at``; None where no whole packet is."""
    if at + PACKET_HEADER > length:
        return None
    size, ts = struct.unpack("<IQ", read(at, PACKET_HEADER))
    return (size, ts) if size and at + PACKET_HEADER + size <= length else None


def _makes_sense(read: Read, at: int, length: int) -> bool:
    last = -1
    for _ in range(AGREEING):
        found = _header(read, at, length)
        if found is None:
            return at == length and last >= 0
        if found[1] <= last:
            return False
        last, at = found[1], at + PACKET_HEADER + found[0]
    return True


def find_packet(read: Read, begin: int, until: int, length: int) -> int | None:
    """The first place in [begin, until) where packets seem to begin."""
    for at in range(begin, until, LOOK_BYTES):
        look = np.frombuffer(read(at, min(LOOK_BYTES, until - at) + 3), np.uint8).astype(np.int64)
        n = len(look) - 3
        if n <= 0:
            return None
        sizes = look[:n] | look[1:n + 1] << 8 | look[2:n + 2] << 16 | look[3:n + 3] << 24
        fits = (sizes > 0) & (sizes + np.arange(at, at + n) + PACKET_HEADER <= length)
        for place in np.flatnonzero(fits).tolist():
            if _makes_sense(read, at + place, length):
                return at + place
    return None


def _packets(read: Read, start: int, until: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(offset of the header, size, time) of the packets that begin in [start, until); then (next place or STOPPED, 0, 0)."""
    at = start
    while at < until:
        found = _header(read, at, length)
        if found is None:
            yield STOPPED, 0, 0
            return
        yield at, *found
        at += PACKET_HEADER + found[0]
    yield (at if at + PACKET_HEADER <= length else STOPPED), 0, 0


class _Window:
    """Reads of a few bytes served from a larger one, for archives of small packets."""

    def __init__(self, file: pa.NativeFile, size: int = 1 << 16):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def __call__(self, offset: int, n: int) -> bytes:
        low = offset - self.at
        if low < 0 or low + n > len(self.held):
            self.at, low = offset, 0
            self.held = self.file.read_at(max(n, self.size), offset)
        return self.held[low:low + n]


def _walked(ranges: DataFrame) -> DataFrame:
    """Ranges with their ``next`` place and number of ``packets``, from their ``start``, which is looked for where it is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    read = _Window(file)
                    if row["start"] is None:
                        row["start"] = find_packet(read, row["begin"], row["until"], row["length"])
                    row["next"], row["packets"] = None, 0
                    if row["start"] is not None:
                        for place, size, _ in _packets(read, row["start"], row["until"], row["length"]):
                            row["packets"] += size > 0
                            row["next"] = place
                yield _batch([row], _RANGE)

    return stored(ranges.select(*[f.split()[0] for f in _RANGE.split(", ")]).mapInArrow(run, _RANGE))


def settled_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of each archive, each with the place of its first packet."""
    step = F.expr(f"sequence(0L, greatest(0L, (length - {HEADER} - 1) div {range_bytes}L))")
    ranges = (files.select("path", "length", F.explode(step).alias("range_no"))
              .withColumn("begin", F.lit(HEADER) + F.col("range_no") * range_bytes)
              .withColumn("until", F.least(F.col("length"), F.col("begin") + range_bytes))
              .withColumns({"start": F.when(F.col("range_no") == 0, F.col("begin")), "next": F.lit(None).cast("bigint"),
                            "packets": F.lit(0).cast("bigint")}))
    state = _walked(ranges.repartition("path", "range_no"))
    order = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    due = F.when(F.coalesce(F.min("next").over(order), F.lit(0)) == STOPPED, F.lit(None)).otherwise(F.last("next", ignorenulls=True).over(order))
    while True:
        held = state.withColumn("_due", due).withColumn("_due", F.when(F.col("range_no") == 0, F.col("begin")).otherwise(
            F.when(F.col("_due") < F.col("until"), F.col("_due"))))
        wrong = stored(held.where(~F.col("start").eqNullSafe(F.col("_due"))))
        if wrong.isEmpty():
            return state.where("start is not null")
        again = _walked(wrong.where("_due is not null").withColumn("start", F.col("_due")))
        idle = wrong.where("_due is null").withColumns({"start": F.lit(None).cast("bigint"), "next": F.lit(None).cast("bigint"), "packets": F.lit(0).cast("bigint")})
        kept = state.join(wrong.select("path", "range_no"), ["path", "range_no"], "left_anti").select(*state.columns)
        state = stored(kept.unionByName(again).unionByName(idle.select(*state.columns)))


def scan_ivf_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets of IVF archives (path, length); an archive ends at an empty or cut packet, or at the count its header names."""
    ranges = settled_ranges(files, range_bytes)
    earlier = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ready = ranges.select("path", "length", "range_no", "start", "until", F.coalesce(F.sum("packets").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    head = file.read_at(HEADER, 0)
                    if len(head) < HEADER or head[:4] != b"DKIF":
                        raise ValueError(f"not an IVF stream: {row['path']}")
                    rate, scale, count = struct.unpack_from("<III", head, 16)
                    number, rows = row["before"], []
                    for place, size, ts in _packets(_Window(file), row["start"], row["until"], row["length"]):
                        if not size or count and number >= count:
                            break
                        rows.append({"path": row["path"], "packet_no": number, "offset": place + PACKET_HEADER, "length": size, "ts": ts,
                                     "pts_ms": ts * (scale or 1000) / rate * 1000 if rate else None})
                        number += 1
                        if len(rows) == 10_000:
                            yield _batch(rows, PACKETS)
                            rows = []
                    if rows:
                        yield _batch(rows, PACKETS)

    return ready.repartition("path", "range_no").mapInArrow(run, PACKETS)
