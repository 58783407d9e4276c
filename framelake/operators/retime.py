"""Re-timing: constant-rate resampling, interpolation plans, shutter windows and blending."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.mathx import byte, js_round
from framelake.operators.ordered import (
    SEG, SEGMENT_ROWS, attach, explode_range, key_totals, neighbours, segment_of,
)

CLIP = ["clip_id"]


def resample_cfr(frames: DataFrame, step_us: float | None = None, target_fps: float | None = None,
                 interpolate: bool = False, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Constant-rate output ticks per clip.

    A tick lies between its left and right neighbour; each frame emits the ticks it is the left
    neighbour of, so no tick grid is joined. ``frame_no`` orders the frames in time and may have holes. Columns:
    source_no (frame shown, or left frame of a generated one), t, generated.
    """
    step = float(step_us) if step_us else 1_000_000.0 / float(target_fps)
    if not step > 0:
        raise ValueError("the output step must be positive")
    base = frames.select("clip_id", "frame_no", "pts_us", "dur_us")
    base = neighbours(base, CLIP, lead={"_next": "pts_us", "_next_no": "frame_no"}, rows=rows)
    base = key_totals(base, CLIP, {"_first": ("first", F.col("pts_us"))}, rows=rows)
    start = F.ceil((F.col("pts_us") - 0.5 - F.col("_first")) / step)
    # The last tick of a pair is the largest one more than half a microsecond before the next frame.
    stop = F.ceil((F.col("_next") - 0.5 - F.col("_first")) / step) - 1
    inner = explode_range(base.where("_next is not null"), start, stop, "tick_no")
    tau = F.col("_first") + F.col("tick_no") * step
    span = F.greatest(F.lit(1), F.col("_next") - F.col("pts_us"))
    inner = inner.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tau - F.col("pts_us")) / span)))
    exact = F.col("t") < 1e-6
    left = exact | (F.col("t") < 0.5) | F.lit(interpolate)
    inner = inner.select(
        "clip_id", "tick_no", js_round(tau).cast("bigint").alias("pts_us"),
        F.when(left, F.col("frame_no")).otherwise(F.col("_next_no")).alias("source_no"),
        "t", (F.lit(interpolate) & ~exact).alias("generated"))
    last = base.where("_next is null").withColumn("tick_no", start.cast("bigint"))
    tau = F.col("_first") + F.col("tick_no") * step
    last = last.where(tau <= F.col("pts_us") + F.col("dur_us")).select(
        "clip_id", "tick_no", js_round(F.greatest(tau, F.col("pts_us").cast("double"))).cast("bigint").alias("pts_us"),
        F.col("frame_no").alias("source_no"), F.lit(0.0).alias("t"), F.lit(False).alias("generated"))
    return (inner.unionByName(last)
            .withColumn("dur_us", F.lit(math.floor(step + 0.5)).cast("bigint")))


def estimate_output_count(source_frames: Column, source_fps: Column, target_fps: Column) -> Column:
    count = F.greatest(F.lit(1.0), js_round((source_frames - 1) * target_fps / source_fps) + 1)
    return F.when(source_frames <= 0, F.lit(0)).otherwise(count).cast("bigint")


def conversion_factor(from_fps: float, to_fps: float) -> int | None:
    """2 or 4 when the rates are in that ratio (within .01), else None."""
    ratio = to_fps / from_fps
    return next((factor for factor in (2, 4) if abs(ratio - factor) < 0.01), None)


def interpolation_plan(frames: DataFrame, factor: int, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Source rows and the generated rows between consecutive frames, in output order."""
    if factor not in (2, 4):
        raise ValueError(f"unsupported interpolation factor {factor}: only 2 or 4")
    base = neighbours(frames.select("clip_id", "frame_no"), CLIP, lead={"_next": "frame_no"}, rows=rows)
    last_slot = F.when(F.col("_next").isNull(), 0).otherwise(factor - 1)
    out = base.withColumn("slot", F.explode(F.sequence(F.lit(0), last_slot)))
    return out.select(
        "clip_id", (F.col("frame_no") * factor + F.col("slot")).alias("out_no"),
        F.when(F.col("slot") == 0, "source").otherwise("generated").alias("type"),
        F.col("frame_no").alias("source_no"), (F.col("slot") / F.lit(float(factor))).alias("t"))


def union_outputs(source: DataFrame, generated: DataFrame, rows_order: Sequence[str] = ("clip_id", "pts_us")) -> DataFrame:
    """One output timeline of source and generated rows; columns missing on one side are null."""
    return (source.withColumn("generated", F.lit(False))
            .unionByName(generated.withColumn("generated", F.lit(True)), allowMissingColumns=True))


def window_samples(in_step_us: float, out_step_us: float, amount: float, maximum: int | None = None) -> tuple[int, int]:
    """Requested and active number of frames in a shutter window."""
    if not (in_step_us > 0 and out_step_us > 0 and amount > 0):
        return 0, 0
    requested = max(1, math.floor(out_step_us / in_step_us * amount + 0.5))
    return requested, requested if maximum is None else min(requested, maximum)


def shutter_window(frames: DataFrame, in_step_us: float, out_step_us: float, amount: float = 1.0,
                   max_samples: int | None = None, scene: str | None = None, duplicate: str | None = None,
                   duplicate_method: str = "skip", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Frames that form each output tick's shutter window.

    A frame belongs to a tick when it starts before the tick ends, ends after the window starts,
    and no earlier frame of the scene had already covered the tick. The ticks of a frame follow
    in closed form from its times, so each frame emits its own ticks: no join against a grid and
    nothing is gathered per scene. Per tick the last ``n`` frames stay; only
    a given ``max_samples`` limits n.
    """
    _, n = window_samples(in_step_us, out_step_us, amount, max_samples)
    if n == 0:
        raise ValueError("amount and steps must be positive")
    width = max(in_step_us, n * in_step_us)
    keys = ["clip_id", "scene_id"]
    base = frames.select(
        "clip_id", "frame_no", "pts_us",
        F.when(F.col("dur_us") > 0, F.col("dur_us")).otherwise(F.lit(in_step_us)).cast("double").alias("_dur"),
        (F.col(scene) if scene else F.lit(0)).cast("bigint").alias("scene_id"),
        (F.col(duplicate) if duplicate else F.lit(False)).alias("_dup"))
    base = base.withColumn("_end", F.col("pts_us") + F.col("_dur")).withColumn(SEG, segment_of("frame_no", rows))
    base = _scene_bounds(base, keys)
    local = (Window.partitionBy(*keys, SEG).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1))
    base = base.withColumn("_covered", F.greatest(F.max("_end").over(local), F.col("_carry_end")))
    origin, step = F.col("_origin"), F.lit(float(out_step_us))
    # Tick k covers [origin + k*step, origin + (k+1)*step).
    low = F.greatest(
        F.lit(0.0),
        F.floor((F.col("pts_us") - 0.5 - origin) / step),                       # starts before the tick ends
        F.coalesce(F.floor((F.col("_covered") + 0.5 - origin) / step), F.lit(0.0)))  # not covered earlier
    high = F.least(
        F.ceil((F.col("_end") + width + 0.5 - origin) / step) - 2,               # ends after the window starts
        F.ceil((F.col("_limit") - 0.5 - origin) / step) - 1)                     # tick starts inside the scene
    out = explode_range(base, low, high, "tick_no")
    last = Window.partitionBy(*keys, "tick_no").orderBy(F.col("frame_no").desc())
    out = out.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= n)
    if duplicate:
        tick = Window.partitionBy(*keys, "tick_no")
        uniques = F.sum(F.when(F.col("_dup"), 0).otherwise(1)).over(tick)
        lone = (F.col("_rank") == 1) if duplicate_method == "nearest" else F.lit(True)
        out = (out.withColumn("_uniques", uniques)
               .where(F.when(F.col("_uniques") > 0, ~F.col("_dup")).otherwise(lone)))
    ordered = Window.partitionBy(*keys, "tick_no").orderBy("frame_no")
    size = Window.partitionBy(*keys, "tick_no")
    return out.select(
        *keys, "tick_no",
        js_round(F.greatest(F.lit(0.0), origin + F.col("tick_no") * step)).cast("bigint").alias("tick_us"),
        "frame_no", (F.row_number().over(ordered) - 1).alias("pos"),
        F.count(F.lit(1)).over(size).cast("int").alias("n"))


def _scene_bounds(base: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the scene's first pts, its drain limit (next scene's first pts, or the clip's last end)
    and the running end of earlier segments, all computed on one row per (scene, segment)."""
    def derive(summary: DataFrame) -> DataFrame:
        scene = Window.partitionBy(*keys)
        earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        order = Window.partitionBy("clip_id").orderBy("scene_id")
        by_seg = summary.select(
            *keys, SEG,
            F.min_by("_first", SEG).over(scene).alias("_origin"),
            F.max("_end_p").over(earlier).alias("_carry_end"))
        bounds = (summary.groupBy(*keys).agg(F.min_by("_first", SEG).alias("_o"), F.max("_end_p").alias("_e"))
                  .withColumn("_after", F.lead("_o").over(order))
                  .select(*keys, F.coalesce(F.col("_after").cast("double"), F.col("_e")).alias("_limit")))
        return by_seg.join(bounds, keys)
    return attach(base, keys, [F.min_by("pts_us", "frame_no").alias("_first"), F.max("_end").alias("_end_p")],
                  derive)


# Weighting names a window can use (fixed values).
WEIGHT_METHODS = ("equal", "ascending", "descending", "pyramid", "vegas", "gaussian", "gaussian_sym",
                  "gaussian_reverse", "custom")


def window_weights(windows: DataFrame, method: str = "gaussian_sym", custom: Sequence[float] | None = None,
                   std_dev: float = 1.0, mean: float = 0.0, bound: tuple[float, float] = (-2.0, 2.0),
                   keys: Sequence[str] = ("clip_id", "scene_id", "tick_no")) -> DataFrame:
    """Adds the normalised weight of position ``pos`` among ``n``. Windows are small (``n`` frames)."""
    method = method.lower().replace("-", "_")
    if method not in WEIGHT_METHODS:
        raise ValueError(f"unsupported weighting {method}")
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    if method == "equal":
        raw = F.lit(1.0)
    elif method == "ascending":
        raw = pos + 1
    elif method == "descending":
        raw = n - pos
    elif method == "pyramid":
        half = (n - 1) / 2
        raw = half - F.abs(pos - half) + 1
    elif method == "vegas":
        edge = (pos == 0) | (pos == n - 1)
        raw = F.when(n % 2 == 1, 1.0).otherwise(F.when(edge, 1.0).otherwise(2.0))
    elif method == "custom":
        raw = _stretched(custom, pos, n)
    else:
        if bound[0] == bound[1]:
            raise ValueError("the gaussian bound needs two distinct numbers")
        widest = max(abs(bound[0]), abs(bound[1]))
        start, end = (-widest, widest) if method == "gaussian_sym" else bound
        at = n - 1 - pos if method == "gaussian_reverse" else pos
        x = F.when(n == 1, F.lit(float(start))).otherwise(
            F.lit(float(start)) + at * (end - start) / F.greatest(F.lit(1.0), n - 1))
        raw = F.exp(-F.pow(x - mean, F.lit(2.0)) / (2 * max(0.001, std_dev) ** 2))
    group = Window.partitionBy(*keys)
    out = windows.withColumn("_raw", raw)
    lowest = F.min("_raw").over(group)
    out = out.withColumn("_raw", F.when(lowest < 0, F.col("_raw") - lowest + 1).otherwise(F.col("_raw")))
    out = out.withColumn("_raw", F.greatest(F.lit(0.0), F.col("_raw")))
    return out.withColumn("weight", F.try_divide(F.col("_raw"), F.sum("_raw").over(group))).drop("_raw")


def _stretched(custom: Sequence[float] | None, pos: Column, n: Column) -> Column:
    """Custom weights read at ``pos`` after linear stretching to ``n`` entries."""
    values = [float(v) for v in (custom or [])]
    if not values:
        raise ValueError("custom weights need at least one number")
    table = F.array(*[F.lit(v) for v in values])
    at = F.when(n == 1, 0.0).otherwise(pos * (len(values) - 1) / F.greatest(F.lit(1.0), n - 1))
    left = F.floor(at)
    low = F.get(table, left.cast("int"))
    high = F.get(table, F.least(F.lit(len(values) - 1), left.cast("int") + 1))
    return low + (high - low) * (at - left)


def weighted_window_blend(windows: DataFrame, planes: DataFrame, gamma: float = 1.0, vector: str = "luma",
                          keys: Sequence[str] = ("clip_id", "scene_id", "tick_no")) -> DataFrame:
    """Weighted mean of the window's planes in gamma space, back to bytes.

    A window holds at most ``max_samples`` frames, so its planes are folded as one small array.
    """
    joined = windows.join(planes.select("clip_id", "frame_no", F.col(vector).alias("_plane")), ["clip_id", "frame_no"])
    gathered = joined.groupBy(*keys).agg(
        F.min("tick_us").alias("tick_us"),
        F.array_sort(F.collect_list(F.struct("pos", "weight", "_plane"))).alias("_window"))
    zeros = F.transform(F.get("_window", F.lit(0))["_plane"], lambda v: F.lit(0.0))
    total = F.aggregate("_window", zeros, lambda acc, w: F.zip_with(
        acc, w["_plane"], lambda a, v: a + F.pow(v / F.lit(255.0), F.lit(gamma)) * w["weight"]))
    out = F.transform(total, lambda v: byte(F.pow(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), F.lit(1.0 / gamma)) * 255).cast("int"))
    return gathered.select(*keys, "tick_us", F.size("_window").alias("n"), out.alias(vector))
