"""Registered queries on containers, stage outputs and user code.

Container bytes are built by Spark from the sample documents, so their number and size follow the
tables; the extractors then see them like files.
"""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import retime as rt
from framelake.operators import usercode as uc
from framelake.plans import bindings as b
from framelake.plans.colour_queries import DECODE_SQL, LUT_SQL, _detector_outputs
from framelake.plans.plane_queries import rounded
from framelake.plans.registry import query
from framelake.plans.retime_queries import LAYOUT_SQL
from framelake.plans.timeline_queries import STEPS_SQL
from framelake.session import fresh_dir
from framelake.sources import media_files as mf
from framelake.sources import ranged_files as rf
from framelake.sources.stages import read_index, write_stage_output


def _number(value: Column, size: int, little: bool = False) -> Column:
    """An integer as ``size`` bytes."""
    digits = F.lpad(F.hex(value), size * 2, "0")
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.unhex(digits)


def _box(kind: str, payload: Column) -> Column:
    return F.concat(_number(F.octet_length(payload) + 8, 4), F.encode(F.lit(kind), "utf-8"), payload)


def _mp4(spark, sf_dir):
    """ftyp, moov and mdat around each document's text; the order and some faults depend on the id."""
    text = F.encode("text", "utf-8")
    ftyp, moov, mdat = _box("ftyp", F.encode(F.lit("isom0000"), "utf-8")), _box("moov", F.encode("lang", "utf-8")), _box("mdat", text)
    kind = F.col("doc_id") % 5
    wide = F.concat(_number(F.lit(1), 4), F.encode(F.lit("mdat"), "utf-8"), _number(F.octet_length(text) + 16, 8), text)
    broken = F.concat(ftyp, _number(F.lit(3), 4), F.encode(F.lit("free"), "utf-8"), text)
    content = (F.when(kind == 0, F.concat(ftyp, moov, mdat)).when(kind == 1, F.concat(ftyp, wide, moov))
               .when(kind == 2, F.concat(moov, ftyp, mdat)).when(kind == 3, broken).otherwise(F.substring(text, 1, 12)))
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))


@query("audit_mp4", b.sql("D", """x AS (SELECT doc_id, doc_id % 5 AS k, octet_length(encode(text)) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN k = 3 THEN 1 WHEN k = 4 THEN 0 ELSE 3 END AS boxes,
  CASE k WHEN 2 THEN 'missing_ftyp' WHEN 3 THEN 'invalid_box_size' WHEN 4 THEN 'header_too_short' END AS reason, k < 2 AS valid, k = 0 AS fast_start, k < 2 AS moov_in_prefix FROM x"""))
def audit_mp4(spark, sf_dir):
    return mf.audit_mp4(mf.scan_mp4_boxes(_mp4(spark, sf_dir))).withColumn("boxes", F.col("boxes").cast("int"))


@query("scan_mp4_boxes", b.sql("D", """x AS (SELECT doc_id, doc_id % 5 AS k, octet_length(encode(text)) AS n, octet_length(encode(lang)) AS l FROM documents),
  s AS (SELECT doc_id, k, CASE k WHEN 0 THEN ['ftyp', 'moov', 'mdat'] WHEN 1 THEN ['ftyp', 'mdat', 'moov'] WHEN 2 THEN ['moov', 'ftyp', 'mdat']
      WHEN 3 THEN ['ftyp', NULL] ELSE [NULL] END AS types,
    CASE k WHEN 0 THEN [16, 8 + l, 8 + n] WHEN 1 THEN [16, 16 + n, 8 + l] WHEN 2 THEN [8 + l, 16, 8 + n] WHEN 3 THEN [16, NULL] ELSE [NULL] END AS sizes FROM x),
  r AS (SELECT *, unnest(range(len(types))) AS i FROM s)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS INT) AS box_no, types[i + 1] AS type, CAST(coalesce(list_sum(sizes[1:i]), 0) AS BIGINT) AS offset,
  CAST(sizes[i + 1] AS BIGINT) AS size, CASE WHEN k = 3 AND i = 1 THEN 'invalid_box_size' WHEN k = 4 THEN 'header_too_short' END AS problem FROM r"""))
def scan_mp4_boxes(spark, sf_dir):
    """Boxes of all files, broken ones with what ended the walk."""
    return mf.scan_mp4_boxes(_mp4(spark, sf_dir)).select("path", "box_no", "type", "offset", "size", "problem")


@query("scan_ivf_packets", b.sql("D", r"""l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: p <> '') AS ls FROM documents),
  e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l), z AS (SELECT doc_id, i, CAST(octet_length(encode(line)) AS BIGINT) AS n FROM e)
SELECT CAST(doc_id AS VARCHAR) AS path, i AS packet_no, CAST(32 + coalesce(sum(n + 12) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12 AS BIGINT) AS offset,
  n AS length, i * 2 AS ts, round(i * 2 * 1000 / 30000 * 1000, 6) AS pts_ms FROM z"""))
def scan_ivf_packets(spark, sf_dir):
    """One packet per line of a document, at 30 packets a second."""
    lines = F.filter(F.split("text", "\n"), lambda v: v != "")
    little = lambda v, n: _number(v, n, little=True)
    packets = F.transform(lines, lambda v, i: F.hex(F.concat(
        little(F.octet_length(F.encode(v, "utf-8")), 4), little(i * 2, 8), F.encode(v, "utf-8"))))
    head = F.concat(F.encode(F.lit("DKIF"), "utf-8"), little(F.lit(0), 2), little(F.lit(32), 2), F.encode(F.lit("VP90"), "utf-8"),
                    little(F.lit(64), 2), little(F.lit(64), 2), little(F.lit(30000), 4), little(F.lit(1000), 4), little(F.size(lines), 4), little(F.lit(0), 4))
    files = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.concat(head, F.unhex(F.concat_ws("", packets))).alias("content"))
    return mf.scan_ivf_packets(files).withColumn("pts_ms", F.round("pts_ms", 6))


def _archives(spark, sf_dir, label: str, head: bytes, entry: Column, end: bytes = b"") -> DataFrame:
    """path and length of one container per source, written by the tasks: ``entry`` of each document between head and end."""
    folder = fresh_dir(spark, label)

    def write(batches):
        held: dict[str, object] = {}
        for batch in batches:
            for source, data in zip(batch.column("source").to_pylist(), batch.column("entry").to_pylist()):
                if source not in held:
                    system, inner = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
                    system.create_dir(inner)
                    held[source] = system.open_output_stream(f"{inner}/{source}")
                    held[source].write(head)
                held[source].write(data)
        for file in held.values():
            file.write(end)
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["source"])

    rows = b.table(spark, sf_dir, "documents").select("source", "doc_id", entry.alias("entry"))
    if rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "entry").mapInArrow(write, "source string").count():
        return rf.list_files(spark, folder)
    return spark.createDataFrame([], "path string, length bigint")


def _source() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("source")


@query("scan_mp4_files", b.sql("D", """x AS (SELECT source, doc_id, octet_length(encode(text)) + 8 AS n FROM documents),
  m AS (SELECT source, row_number() OVER w AS box_no, 'mdat' AS type, 16 + sum(n) OVER w - n AS "offset", n AS size FROM x WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
  a AS (SELECT source, 0 AS box_no, 'ftyp' AS type, 0 AS "offset", 16 AS size FROM x GROUP BY source UNION ALL SELECT * FROM m
    UNION ALL SELECT source, count(*) + 1, 'moov', 16 + sum(n), 12 FROM x GROUP BY source)
SELECT source, CAST(box_no AS INT) AS box_no, type, CAST("offset" AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size FROM a"""))
def scan_mp4_files(spark, sf_dir):
    """One file per source, a data box per document; only headers are read back."""
    ftyp, moov = b"\x00\x00\x00\x10ftypisom0000", b"\x00\x00\x00\x0cmoovabcd"
    files = _archives(spark, sf_dir, "mp4", ftyp, _box("mdat", F.encode("text", "utf-8")), moov)
    return rf.scan_mp4_files(files).select(_source(), "box_no", "type", "offset", "size")


@query("scan_ivf_files", b.sql("D", """x AS (SELECT source, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)
SELECT source, row_number() OVER w - 1 AS packet_no, CAST(32 + sum(n + 12) OVER w - n AS BIGINT) AS "offset", n AS length, doc_id AS ts
FROM x WINDOW w AS (PARTITION BY source ORDER BY doc_id)"""))
def scan_ivf_files(spark, sf_dir):
    """One archive per source, a packet per document, read in ranges of 64 KB."""
    text = F.encode("text", "utf-8")
    packet = F.concat(_number(F.octet_length(text), 4, little=True), _number(F.col("doc_id"), 8, little=True), text)
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"VP90", 64, 64, 30000, 1000, 0, 0)
    files = _archives(spark, sf_dir, "ivf", head, packet)
    return rf.scan_ivf_files(files, range_bytes=1 << 16).select(_source(), "packet_no", "offset", "length", "ts")


@query("read_cube_lut", b.sql("P", LUT_SQL + """
SELECT 0 AS lut_id, CAST(i AS INT) AS i, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b FROM cube
UNION ALL SELECT 1, CAST(i AS INT), round(r, 9), round(g, 9), round(b, 9) FROM line"""))
def read_cube_lut(spark, sf_dir):
    from framelake.plans.colour_queries import _cube_texts
    _, lattice = mf.parse_cube(_cube_texts(spark, sf_dir))
    return rounded(lattice, 9)


@query("write_stage_output", b.sql("C", """SELECT 'tier-' || codec AS stage_key, count(*) AS row_count, CAST(7 AS BIGINT) AS created_at_us, CAST(9 AS BIGINT) AS last_access_us FROM C GROUP BY codec"""))
def write_stage_output_query(spark, sf_dir):
    """Writes one stage per codec twice; the second write replaces the first."""
    path, clips = fresh_dir(spark, "stages"), b.clips(spark, sf_dir)
    for now in (7, 9):
        for codec in ("avc1.64002a", "vp09.00.40.08", "avc3.640028"):
            write_stage_output(clips.where(F.col("codec") == codec), path, "sample", f"tier-{codec}", now)
    return read_index(spark, path).select("stage_key", "row_count", "created_at_us", "last_access_us")


@query("map_pairs", b.sql("V", """p AS (SELECT clip_id, frame_no, luma AS a, lead(luma) OVER (PARTITION BY clip_id ORDER BY frame_no) AS c FROM V),
  g AS (SELECT *, unnest([0, 1]) AS slot FROM p)
SELECT clip_id, frame_no * 2 + slot AS out_no, round(CASE WHEN slot = 0 THEN CAST(list_sum(a) AS DOUBLE) ELSE list_sum(list_transform(list_zip(a, c), lambda z: greatest(z[1], z[2]) * 0.5::DOUBLE)) END, 6) AS checksum
FROM g WHERE slot = 0 OR c IS NOT NULL"""))
def map_pairs(spark, sf_dir):
    """The user function takes the larger of both ends, scaled by t."""
    import numpy as np
    planes = b.planes(spark, sf_dir)
    out = uc.map_pairs(planes, rt.interpolation_plan(planes, 2), lambda x, y, t: np.maximum(x, y) * t)
    total = F.aggregate("value", F.lit(0.0), lambda acc, v: acc + v)
    return out.select("clip_id", "out_no", F.round(total, 6).alias("checksum"))


@query("observer_udaf", b.sql("T", f"""{STEPS_SQL}
SELECT clip_id, count(*) AS frames, max(d) AS longest, CAST(sum(CASE WHEN d > 72000000000 THEN 1 ELSE 0 END) AS BIGINT) AS long_steps FROM steps GROUP BY clip_id"""))
def observer_udaf(spark, sf_dir):
    """A user-written monitor: longest step and number of steps over 20 hours."""
    def watch(pdf: pd.DataFrame) -> dict:
        pts = pdf["pts_us"].to_numpy()
        step = pts[1:] - pts[:-1]
        return {"frames": len(pts), "first": pts[0], "last": pts[-1], "longest": step.max(initial=0), "long_steps": int((step > 72_000_000_000).sum())}

    def merge(a: dict, c: dict) -> dict:
        across = c["first"] - a["last"]
        return {"frames": a["frames"] + c["frames"], "first": a["first"], "last": c["last"], "longest": max(a["longest"], c["longest"], across),
                "long_steps": a["long_steps"] + c["long_steps"] + int(across > 72_000_000_000)}

    out = uc.observe(b.timelines(spark, sf_dir).select("clip_id", "frame_no", "pts_us"), watch, merge,
                     "frames bigint, first bigint, last bigint, longest bigint, long_steps bigint")
    return out.select("clip_id", "frames", "longest", "long_steps")


@query("tile_udtf", b.sql("C", LAYOUT_SQL + """
SELECT clip_id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y,
  CAST(least(1280, width - tile_x) AS INT) AS tile_w, CAST(least(1280, height - tile_y) AS INT) AS tile_h FROM h"""))
def tile_udtf(spark, sf_dir):
    uc.register_table_functions(spark)
    b.clips(spark, sf_dir).select("clip_id", "width", "height").createOrReplaceTempView("framelake_clips")
    return spark.sql("SELECT clip_id, t.* FROM framelake_clips, LATERAL tile_layout(width, height, 1280, 64) t")


@query("boxes_udtf", b.sql("V", DECODE_SQL + """
SELECT clip_id, frame_no, CAST(8000000 + i AS BIGINT) AS box_no, round(cx - w / 2, 6) AS x, round(cy - h / 2, 6) AS y, round(w, 6) AS width, round(h, 6) AS height, round(score, 6) AS score FROM bo"""))
def boxes_udtf(spark, sf_dir):
    uc.register_table_functions(spark)
    _detector_outputs(spark, sf_dir).createOrReplaceTempView("framelake_outputs")
    return rounded(spark.sql("SELECT clip_id, frame_no, t.* FROM framelake_outputs, LATERAL decode_boxes(stride, 64, 64, 0.6D, cls, obj, bbox) t"))


@query("time_functions", b.sql("T", """SELECT event_id, CAST(floor(pts_us / 1e6 * 1000000 + 0.5) AS BIGINT) AS back_us, pts_us / 1e6 AS seconds, round(1000000 / (1 + event_id % 60), 6) AS step_us FROM T"""))
def time_functions(spark, sf_dir):
    from framelake.functions import mathx as mx
    return b.table(spark, sf_dir, "events").select(
        "event_id", mx.seconds_to_us(mx.us_to_seconds(mx.micros("ts"))).alias("back_us"), mx.us_to_seconds(mx.micros("ts")).alias("seconds"),
        F.round(mx.step_us(F.lit(1) + F.col("event_id") % 60), 6).alias("step_us"))
