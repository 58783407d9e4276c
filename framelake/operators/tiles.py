"""Tile layouts, blending weights, reassembly and batch model calls on tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.mathx import dbl


def tile_layout(frames: DataFrame, tile: int, overlap: int, width: str = "width", height: str = "height") -> DataFrame:
    """Tile rectangles covering each plane; edge tiles shrink and no redundant last tile appears."""
    stride = tile - overlap
    if stride <= 0:
        raise ValueError(f"overlap ({overlap}) must be smaller than the tile ({tile})")

    def starts(length: str) -> Column:
        # The first tile that reaches the edge is the last one: smallest k with k*stride + tile >= length.
        last = F.greatest(F.lit(0), F.ceil((F.col(length) - tile) / F.lit(float(stride)))).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)

    return (frames.withColumn("tile_y", F.explode(starts(height))).withColumn("tile_x", F.explode(starts(width)))
            .withColumn("tile_w", F.least(F.lit(tile), F.col(width) - F.col("tile_x")))
            .withColumn("tile_h", F.least(F.lit(tile), F.col(height) - F.col("tile_y"))))


def edge_ramp(pos, length, overlap, has_previous, has_next) -> Column:
    """Linear 0..1 ramp over an overlap that borders another tile, else 1."""
    pos, length = dbl(pos), dbl(length)
    overlap = float(overlap)
    if overlap <= 0:
        return F.lit(1.0)
    rising = F.when(has_previous & (pos < overlap), (pos + 0.5) / overlap).otherwise(1.0)
    falling = F.when(has_next & (pos >= length - overlap), (length - pos - 0.5) / overlap).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), rising, falling))


def tile_merge(tiles: DataFrame, overlap: int, scale: int = 1, keys: Sequence[str] = ("clip_id", "frame_no"),
               width: str = "width", height: str = "height", values: str = "values") -> DataFrame:
    """Weighted reassembly: one output cell per plane position.

    Tiles become (cell, value, weight) rows that are summed before and after the shuffle; a cell
    is covered by at most four tiles, and no plane is gathered in one place.
    """
    tw, th = F.col("tile_w") * scale, F.col("tile_h") * scale
    cells = tiles.select(*keys, width, height, "tile_x", "tile_y", "tile_w", "tile_h",
                         F.posexplode(values).alias("_i", "_v"))
    tx, ty = F.col("_i") % tw, F.floor(F.col("_i") / tw).cast("int")
    wx = edge_ramp(tx, tw, overlap * scale, F.col("tile_x") > 0, F.col("tile_x") + F.col("tile_w") < F.col(width))
    wy = edge_ramp(ty, th, overlap * scale, F.col("tile_y") > 0, F.col("tile_y") + F.col("tile_h") < F.col(height))
    cells = cells.select(*keys, (F.col("tile_x") * scale + tx).cast("int").alias("x"),
                         (F.col("tile_y") * scale + ty).cast("int").alias("y"),
                         (wx * wy).alias("_w"), F.col("_v").cast("double").alias("_v"))
    return (cells.groupBy(*keys, "x", "y")
            .agg(F.sum(F.col("_w") * F.col("_v")).alias("_sum"), F.sum("_w").alias("weight"))
            .withColumn("value", F.try_divide(F.col("_sum"), F.col("weight"))).drop("_sum"))


def cut_tiles(frames: DataFrame, tile: int, overlap: int, plane: str = "luma", width: str = "pw",
              height: str = "ph") -> DataFrame:
    """Tile rows with their own values, cut from plane rows."""
    laid = tile_layout(frames, tile, overlap, width, height)
    index = F.transform(F.sequence(F.lit(0), F.col("tile_w") * F.col("tile_h") - 1), lambda i: F.get(
        F.col(plane), ((F.col("tile_y") + F.floor(i / F.col("tile_w"))) * F.col(width)
                       + F.col("tile_x") + i % F.col("tile_w")).cast("int")))
    return laid.withColumn("values", index).drop(plane)


def map_tiles(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], scale: int = 1) -> DataFrame:
    """Calls a user model on every tile; batches arrive through Arrow.

    ``model`` maps an (h, w) float array to an (h*scale, w*scale) one and is checked for it. A
    factory (``model.load``) is called once per worker batch stream, so weights load lazily.
    """
    fields = [f for f in tiles.schema.fields if f.name != "values"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", `values` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = model.load() if hasattr(model, "load") else model
        for batch in batches:
            table = pa.Table.from_batches([batch])
            widths, heights = table["tile_w"].to_pylist(), table["tile_h"].to_pylist()
            results = []
            for values, w, h in zip(table["values"].to_pylist(), widths, heights):
                out = np.asarray(fn(np.asarray(values, dtype=float).reshape(h, w)))
                if out.shape != (h * scale, w * scale):
                    raise ValueError(f"the model returned {out.shape[1]}x{out.shape[0]}, "
                                     f"expected {w * scale}x{h * scale}")
                results.append(out.ravel().tolist())
            table = table.drop_columns(["values"]).append_column("values", pa.array(results, pa.list_(pa.float64())))
            yield from table.to_batches()

    ordered = tiles.select(*[f.name for f in fields], "values")
    return ordered.mapInArrow(run, schema)


def peak_bytes(jobs: DataFrame, tile: int = 256, batch: int = 1, overlap: int = 16, scale: str = "scale") -> DataFrame:
    """Bytes held at once: the destination plus a batch of source and output tiles."""
    tile, batch = max(64, int(tile)), max(1, int(batch))
    source = float(tile * tile * 4)
    s = dbl(scale)
    return jobs.withColumn("peak_bytes", (dbl("width") * dbl("height") * s * s * 4
                                          + (F.lit(source) + F.lit(source) * s * s) * batch).cast("bigint"))
