"""Media containers to rows: boxes, packets and lookup tables.

Contents held in a column are turned into small rows by Arrow functions; every verdict is then an ordinary query. Only
fixed-size headers are interpreted in Python. Files of any size are better scanned by ``ranged_files``, which reads headers only.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_SAFE_SIZE = 2 ** 53 - 1


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length and content of files."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def _rows_of(files: DataFrame, parse, schema: str, content) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, **row} for p, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist())
                    for row in parse(data)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW[schema])
    return files.select("path", content.alias("content")).mapInArrow(run, schema)


BOX_SCHEMA = "path string, box_no int, type string, offset bigint, size bigint, prefix_bytes bigint, problem string"
PACKET_SCHEMA = "path string, packet_no bigint, offset bigint, length bigint, ts bigint, pts_ms double"
_ARROW = {
    BOX_SCHEMA: pa.schema([("path", pa.string()), ("box_no", pa.int32()), ("type", pa.string()), ("offset", pa.int64()),
                           ("size", pa.int64()), ("prefix_bytes", pa.int64()), ("problem", pa.string())]),
    PACKET_SCHEMA: pa.schema([("path", pa.string()), ("packet_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
                              ("ts", pa.int64()), ("pts_ms", pa.float64())]),
}


def boxes_of(read: Callable[[int, int], bytes], total: int) -> Iterator[dict]:
    """Top-level boxes of ``total`` bytes, of which ``read(offset, n)`` gives only the headers; the last row carries the problem that
    ended the walk, if any."""
    offset, number = 0, 0
    row = lambda kind, size, problem=None: {"box_no": number, "type": kind, "offset": offset, "size": size,
                                            "prefix_bytes": total, "problem": problem}
    if total < 16:
        yield row(None, None, "header_too_short")
        return
    while total - offset >= 8:
        size, kind = struct.unpack(">I4s", read(offset, 8))
        header = 8
        if size == 1:
            if total - offset < 16:
                return
            size, header = struct.unpack(">Q", read(offset + 8, 8))[0], 16
            if size > MAX_SAFE_SIZE:
                yield row(None, None, "box_too_large")
                return
        elif size == 0:
            size = total - offset
        if size < header:
            yield row(None, None, "invalid_box_size")
            return
        yield row(kind.decode("latin-1"), size)
        if size > total - offset:
            return
        offset, number = offset + size, number + 1


def _boxes(data: bytes) -> Iterator[dict]:
    return boxes_of(lambda offset, n: data[offset:offset + n], len(data))


def scan_mp4_boxes(files: DataFrame, prefix: int | None = None) -> DataFrame:
    """Top-level boxes of each file; only those of the first ``prefix`` bytes if that is given."""
    content = F.col("content") if prefix is None else F.substring("content", F.lit(1), F.lit(prefix))
    return _rows_of(files, _boxes, BOX_SCHEMA, content)


def audit_mp4(boxes: DataFrame) -> DataFrame:
    """Verdict per file: valid, reason, fast start (index before data) and whether the index was seen."""
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.col("offset")))
    out = boxes.groupBy("path").agg(F.count("type").alias("boxes"), F.max("problem").alias("_problem"), first("ftyp").alias("_ftyp"),
                                    first("moov").alias("_moov"), first("mdat").alias("_mdat"))
    reason = F.coalesce(F.col("_problem"), F.when(F.col("_ftyp").isNull() | (F.col("_ftyp") != 0), "missing_ftyp"))
    return (out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
            .withColumn("fast_start", F.col("valid") & F.col("_moov").isNotNull()
                        & (F.col("_mdat").isNull() | (F.col("_moov") < F.col("_mdat"))))
            .withColumn("moov_in_prefix", F.col("valid") & F.col("_moov").isNotNull())
            .drop("_problem", "_ftyp", "_moov", "_mdat"))


def _packets(data: bytes) -> Iterator[dict]:
    if len(data) < 32 or data[:4] != b"DKIF":
        raise ValueError("not an IVF stream")
    rate, scale, count = struct.unpack_from("<III", data, 16)
    scale = scale or 1000
    offset, number = 32, 0
    while offset + 12 <= len(data) and (not count or number < count):
        length, ts = struct.unpack_from("<IQ", data, offset)
        if not length or offset + 12 + length > len(data):
            return
        yield {"packet_no": number, "offset": offset + 12, "length": length, "ts": ts,
               "pts_ms": ts * scale / rate * 1000 if rate else None}
        offset, number = offset + 12 + length, number + 1


def scan_ivf_packets(files: DataFrame) -> DataFrame:
    """Packets of IVF archives; stops at an empty or truncated packet. Feeds the pacing audits."""
    return _rows_of(files, _packets, PACKET_SCHEMA, F.col("content"))


# ---- .cube lookup tables ------------------------------------------------------------------

def read_cube_lut(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lattice) of .cube files; ``error`` in the header names the first broken rule."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("lut_id"), F.col("value").alias("text"))
    return parse_cube(texts)


def parse_cube(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and lattice rows of (lut_id, text)."""
    lines = texts.select("lut_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("line <> ''")
    lines = lines.withColumn("words", F.split("line", r"\s+"))
    lines = lines.withColumn("word", F.upper(F.get("words", F.lit(0))))
    number = lambda i: F.get("words", F.lit(i)).try_cast("double")
    finite = lambda i: F.coalesce(number(i).isNotNull() & ~F.isnan(number(i)) & (F.abs(number(i)) != float("inf")), F.lit(False))
    sizes, bounds = F.col("word").isin("LUT_3D_SIZE", "LUT_1D_SIZE"), F.col("word").isin("DOMAIN_MIN", "DOMAIN_MAX")
    triple = lambda start: F.array(*[number(start + k) for k in range(3)])
    last = lambda kind: F.max_by(triple(1), F.when(F.col("word") == kind, F.col("line_no")))
    is_row = ~sizes & ~bounds & (F.col("word") != "TITLE") & F.get("words", F.lit(0)).rlike(r"^[+-]?(\d|\.\d)")
    good_row = finite(0) & finite(1) & finite(2)
    heads = lines.groupBy("lut_id").agg(
        F.count_if(sizes).alias("_sizes"), F.max(F.when(sizes, number(1))).alias("_size"),
        F.max(F.when(sizes, F.when(F.col("word") == "LUT_3D_SIZE", "3d").otherwise("1d"))).alias("type"),
        F.coalesce(last("DOMAIN_MIN"), F.array(*[F.lit(0.0)] * 3)).alias("domain_min"),
        F.coalesce(last("DOMAIN_MAX"), F.array(*[F.lit(1.0)] * 3)).alias("domain_max"),
        F.count_if(bounds & ~(finite(1) & finite(2) & finite(3))).alias("_bad_bounds"),
        F.max(F.when(F.col("word") == "TITLE", F.trim(F.regexp_replace(F.regexp_replace("line", r"^\S+\s*", ""), '^"|"$', "")))).alias("title"),
        F.count_if(is_row).alias("rows"), F.count_if(is_row & ~good_row).alias("_bad_rows"))
    limit = F.when(F.col("type") == "3d", 65).otherwise(65536)
    wanted = F.when(F.col("type") == "3d", F.pow("_size", F.lit(3.0))).otherwise(F.col("_size"))
    wider = F.forall(F.zip_with("domain_max", "domain_min", lambda a, b: a > b), lambda v: v)
    error = (F.when(F.col("_sizes") == 0, "missing_size").when(F.col("_sizes") > 1, "duplicate_size")
             .when(F.col("_size").isNull() | (F.col("_size") != F.floor("_size")) | (F.col("_size") < 2) | (F.col("_size") > limit), "unsupported_size")
             .when(F.col("_bad_bounds") > 0, "invalid_domain").when(F.col("_bad_rows") > 0, "invalid_row")
             .when(F.col("rows") != wanted, "row_count").when(~wider, "domain_order"))
    headers = (texts.select("lut_id").join(heads, "lut_id", "left")
               .withColumn("error", F.when(F.col("rows").isNull(), "empty").otherwise(error))
               .withColumn("size", F.when(F.col("error").isNull(), F.col("_size").cast("int")))
               .drop("_sizes", "_size", "_bad_bounds", "_bad_rows"))
    entry = Window.partitionBy("lut_id").orderBy("line_no")
    lattice = (lines.where(is_row & good_row)
               .select("lut_id", (F.row_number().over(entry) - 1).alias("i"), number(0).alias("r"), number(1).alias("g"), number(2).alias("b")))
    return headers, lattice.join(headers.where("error is null").select("lut_id"), "lut_id", "left_semi")
