"""Places for user code: functions on frame pairs, custom observers, and table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.chained import groups
from framelake.operators.ordered import SEG, SEGMENT_ROWS, neighbours, segment_of

#: Summaries of segments or keys that a task sends on at a time.
SUMMARIES = 4_096


def map_pairs(frames: DataFrame, plan: DataFrame, fn: Callable[[np.ndarray, np.ndarray, float], np.ndarray],
              plane: str = "luma", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Calls a user function on (a, b, t) for the generated rows of a plan; source rows keep their
    plane and never reach Python. ``fn`` may carry ``load`` to build the model once per worker."""
    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array, t: pa.Array) -> pa.Array:
        call = fn.load() if hasattr(fn, "load") else fn
        out = [np.asarray(call(np.asarray(x, float), np.asarray(y, float), share), float).tolist()
               for x, y, share in zip(a.to_pylist(), b.to_pylist(), t.to_pylist())]
        return pa.array(out, pa.list_(pa.float64()))

    pairs = neighbours(frames.select("clip_id", "frame_no", plane), ["clip_id"], lead={"_b": plane}, rows=rows)
    joined = plan.join(pairs.withColumnRenamed("frame_no", "source_no"), ["clip_id", "source_no"])
    made = joined.where("t > 0 and _b is not null").withColumn("value", run(plane, "_b", "t"))
    kept = joined.where("t = 0 or _b is null").withColumn("value", F.transform(plane, lambda v: v.cast("double")))
    return made.unionByName(kept).drop(plane, "_b")


def observe(df: DataFrame, observer: Callable[[pd.DataFrame], dict], merge: Callable[[dict, dict], dict], partial_schema: str,
            keys: Sequence[str] = ("clip_id",), position: str = "frame_no", rows: int = SEGMENT_ROWS) -> DataFrame:
    """A custom aggregate with a combinable state.

    ``observer`` sums up the ordered rows of one segment as a flat dict, ``merge`` joins two
    neighbouring ones. A key of any length is observed segment by segment; only the one-row
    summaries of a key meet in one place.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    names = [p.strip().split()[0] for p in partial_schema.split(",")]
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    cut = df.withColumn(SEG, segment_of(position, rows))

    def summed(group: list[str], row: Callable[[pd.DataFrame], dict], out: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows: list[dict] = []
            frame = lambda: pd.DataFrame(rows, columns=out, dtype=object).infer_objects()
            for whole in groups(batches, group):
                rows.append({k: whole[k].iloc[0] for k in group} | row(whole))
                if len(rows) >= SUMMARIES:
                    yield frame()
                    rows.clear()
            if rows:
                yield frame()
        return run

    def whole(pdf: pd.DataFrame) -> dict:
        states = pdf[names].to_dict("records")
        total = states[0]
        for state in states[1:]:
            total = merge(total, state)
        return total

    # many keys share a task: their rows are sorted once and parted there, not handed over key by key
    parts = (cut.repartition(*keys, SEG).sortWithinPartitions(*keys, SEG, position)
             .mapInPandas(summed([*keys, SEG], observer, [*keys, SEG, *names]), f"{key_schema}, {SEG} bigint, {partial_schema}"))
    return (parts.repartition(*keys).sortWithinPartitions(*keys, SEG)
            .mapInPandas(summed(keys, whole, [*keys, *names]), f"{key_schema}, {partial_schema}"))


_TILES = """CREATE OR REPLACE TEMPORARY FUNCTION tile_layout(width INT, height INT, tile INT, overlap INT)
RETURNS TABLE(tile_x INT, tile_y INT, tile_w INT, tile_h INT) COMMENT 'the tiles covering a plane'
RETURN SELECT inline(flatten(
  transform(sequence(0, greatest(0, ceil((height - tile) / nullif(tile - overlap, 0)))), line ->
    transform(sequence(0, greatest(0, ceil((width - tile) / nullif(tile - overlap, 0)))), k -> named_struct(
      'tile_x', CAST(IF(tile > overlap, k * (tile - overlap), raise_error('overlap must be smaller than the tile')) AS INT),
      'tile_y', CAST(line * (tile - overlap) AS INT),
      'tile_w', CAST(least(tile, width - k * (tile - overlap)) AS INT),
      'tile_h', CAST(least(tile, height - line * (tile - overlap)) AS INT))))))"""

_SCORE = "sqrt(greatest(0D, least(1D, get(cls, {i}))) * greatest(0D, least(1D, get(obj, {i}))))"
_EXTENT = "exp(greatest(-10D, least(10D, get(bbox, 4 * i + {k})))) * stride"
_BOXES = f"""CREATE OR REPLACE TEMPORARY FUNCTION decode_boxes(stride INT, input_width INT, input_height INT, threshold DOUBLE,
  cls ARRAY<DOUBLE>, obj ARRAY<DOUBLE>, bbox ARRAY<DOUBLE>)
RETURNS TABLE(box_no BIGINT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, score DOUBLE) COMMENT 'boxes of a grid detector'
RETURN SELECT inline(transform(
  filter(sequence(0, (input_width div stride) * (input_height div stride) - 1), i -> {_SCORE.format(i="i")} >= threshold), i -> named_struct(
    'box_no', CAST(stride * 1000000L + i AS BIGINT),
    'x', (i % (input_width div stride) + get(bbox, 4 * i)) * stride - {_EXTENT.format(k=2)} / 2,
    'y', (i div (input_width div stride) + get(bbox, 4 * i + 1)) * stride - {_EXTENT.format(k=3)} / 2,
    'width', {_EXTENT.format(k=2)}, 'height', {_EXTENT.format(k=3)}, 'score', {_SCORE.format(i="i")})))"""


def register_table_functions(spark: SparkSession) -> None:
    """Makes tile_layout(width, height, tile, overlap) and decode_boxes(stride, input_width, input_height, threshold, cls, obj, bbox) available
    in SQL (LATERAL joins). They are SQL functions: a call becomes one generator in the plan of the query, without Python."""
    spark.sql(_TILES)
    spark.sql(_BOXES)
