"""Motion between consecutive planes, camera paths and history blending."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import pixels
from framelake.operators.ordered import HOME, SEG, SEGMENT_ROWS, neighbours, with_halo

CLIP = ["clip_id"]
FIELD_TYPE = ("struct<global_dx: double, global_dy: double, confidence: double, motion: double, "
              "vectors: array<struct<x: int, y: int, dx: int, dy: int, error: double, confidence: double>>>")
SHIFT_TYPE = "struct<dx: int, dy: int, normalized_error: double>"


def _block_vectors(previous, current, block: int, radius: int):
    """Best shift per block (first minimum in dy, dx order) for a batch of plane pairs."""
    _, height, width = previous.shape
    half = max(2, block // 2)
    cys = np.arange(half + radius, height - half - radius, block)
    cxs = np.arange(half + radius, width - half - radius, block)
    offsets = np.arange(-half, half, 2)
    ys, xs = (cys[:, None] + offsets).ravel(), (cxs[:, None] + offsets).ravel()
    shape = (len(previous), len(cys), len(cxs))
    best = np.full(shape, np.inf)
    dx_best, dy_best = np.zeros(shape, int), np.zeros(shape, int)
    if len(cys) and len(cxs):
        cells = (len(previous), len(cys), len(offsets), len(cxs), len(offsets))
        for dy, dx, diff in pixels.plane_shifts(previous, current, ys, xs, radius):
            error = diff.reshape(cells).mean(axis=(2, 4))
            better = error < best
            best[better], dx_best[better], dy_best[better] = error[better], dx, dy
    return cys, cxs, dx_best, dy_best, best


def _field(dx, dy, error) -> dict:
    confidence = np.clip(1 - error / 48, 0, 1)
    pool = confidence >= 0.18
    if pool.sum() < 3:
        pool = np.ones_like(pool)
    if not pool.any():
        return {"global_dx": 0.0, "global_dy": 0.0, "confidence": 0.0, "motion": 0.0}
    return {"global_dx": float(np.median(dx[pool])), "global_dy": float(np.median(dy[pool])),
            "confidence": float(confidence[pool].mean()), "motion": float(np.hypot(dx, dy)[pool].mean())}


def motion_field(frames: DataFrame, block: int = 8, radius: int = 3, plane: str = "luma",
                 vectors: bool = True, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Block motion against the previous plane: vectors, medians, mean confidence and mean length."""
    @F.arrow_udf(FIELD_TYPE)
    def run(previous: pa.Array, current: pa.Array, pw: pa.Array, ph: pa.Array) -> pa.Array:
        out = [None] * len(pw)
        for width, height, index in pixels.same_size(pw, ph):
            cys, cxs, dx, dy, error = _block_vectors(
                pixels.stacked(previous, index, width, height), pixels.stacked(current, index, width, height),
                block, radius)
            for i, row in enumerate(index):
                summary = _field(dx[i].ravel(), dy[i].ravel(), error[i].ravel())
                listed = [
                    {"x": int(x), "y": int(y), "dx": int(dx[i, a, c]), "dy": int(dy[i, a, c]), "error": float(error[i, a, c]),
                     "confidence": float(np.clip(1 - error[i, a, c] / 48, 0, 1))}
                    for a, y in enumerate(cys) for c, x in enumerate(cxs)] if vectors else []
                out[row] = {**summary, "vectors": listed}
        kind = pa.struct([("global_dx", pa.float64()), ("global_dy", pa.float64()), ("confidence", pa.float64()),
                          ("motion", pa.float64()), ("vectors", pa.list_(pa.struct([
                              ("x", pa.int32()), ("y", pa.int32()), ("dx", pa.int32()), ("dy", pa.int32()),
                              ("error", pa.float64()), ("confidence", pa.float64())])))])
        return pa.array(out, kind)

    pairs = neighbours(frames, CLIP, lag={"_prev": plane}, rows=rows)
    measured = pairs.withColumn("_f", run(F.coalesce("_prev", plane), plane, "pw", "ph"))
    ready = F.col("_prev").isNotNull()
    fields = ["global_dx", "global_dy", "confidence", "motion"]
    return measured.select(
        *[c for c in frames.columns], ready.alias("ready"),
        *[F.when(ready, F.col(f"_f.{f}")).otherwise(0.0).alias(f) for f in fields],
        F.when(ready, F.col("_f.vectors")).alias("vectors"))


def global_shift(frames: DataFrame, radius: int = 2, plane: str = "luma", rows: int = SEGMENT_ROWS) -> DataFrame:
    """One translation per consecutive pair by smallest mean difference, error normalised by 255."""
    @F.arrow_udf(SHIFT_TYPE)
    def run(previous: pa.Array, current: pa.Array, pw: pa.Array, ph: pa.Array) -> pa.Array:
        dx, dy = np.zeros(len(pw), np.int32), np.zeros(len(pw), np.int32)
        error = np.zeros(len(pw))
        margin = radius + 2
        for width, height, index in pixels.same_size(pw, ph):
            ys, xs = np.arange(margin, height - margin, 2), np.arange(margin, width - margin, 2)
            best = np.full(len(index), np.inf)
            before, now = pixels.stacked(previous, index, width, height), pixels.stacked(current, index, width, height)
            for sy, sx, diff in pixels.plane_shifts(before, now, ys, xs, radius):
                value = diff.sum(axis=(1, 2)) / max(1, len(ys) * len(xs))
                better = value < best
                best[better] = value[better]
                dx[index[better]], dy[index[better]] = sx, sy
            error[index] = best / 255
        return pa.StructArray.from_arrays([pa.array(dx), pa.array(dy), pa.array(error)],
                                          names=["dx", "dy", "normalized_error"])

    pairs = neighbours(frames, CLIP, lag={"_prev": plane}, rows=rows).where("_prev is not null")
    keep = [c for c in frames.columns if c != plane]
    return pairs.select(*keep, run("_prev", plane, "pw", "ph").alias("_s")).select(*keep, "_s.*")


def stabilize_path(shifts: DataFrame, strength: float = 0.55, smoothing: float = 0.88, crop: float = 0.035,
                   scene_threshold: float = 0.20, scale_x=1.0, scale_y=1.0) -> DataFrame:
    """Correction that follows a smoothed camera path; a large error restarts the path.

    With camera c and smoothed path p the wanted p - c obeys e[t] = a (e[t-1] - d[t]): a decaying
    sum of past shifts. It is a plain window sum with weights a^-r, restarted per cut, and the
    decay bounds how many earlier rows can matter, so long clips split into segments.
    Rows: clip_id, frame_no, dx, dy, normalized_error (null shift on a clip's first frame).
    """
    a = min(0.98, max(0.5, smoothing))
    amount = min(1.0, max(0.0, strength))
    back = math.ceil(math.log(1e-30) / math.log(a))
    rows = math.floor(600 / -math.log(a)) - back
    out = with_halo(shifts, CLIP, back=back, rows=rows)
    w = Window.partitionBy(*CLIP, SEG).orderBy("frame_no")
    cut = F.coalesce(F.col("normalized_error") > scene_threshold, F.lit(False))
    out = out.withColumn("scene_cut", cut)
    out = out.withColumn("_run", F.sum(F.when(F.col("scene_cut"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*CLIP, SEG, "_run").orderBy("frame_no")
    out = out.withColumn("_r", F.row_number().over(inside).cast("double"))
    moves = ~F.col("scene_cut") & F.col("normalized_error").isNotNull()
    for axis, scale in (("dx", scale_x), ("dy", scale_y)):
        step = F.when(moves, F.col(axis) * scale).otherwise(0.0)
        total = F.sum(step * F.pow(F.lit(a), -F.col("_r"))).over(inside)
        out = out.withColumn(f"correction_{axis[1]}", F.when(
            moves, -F.pow(F.lit(a), F.col("_r") + 1) * total * amount).otherwise(0.0))
    zoom = 1 + min(0.12, max(0.0, crop)) * amount
    return (out.where(HOME).drop(SEG, HOME, "_run", "_r")
            .withColumn("zoom", F.when(moves, F.lit(zoom)))
            .withColumn("applied", (F.abs("correction_x") > 0.05) | (F.abs("correction_y") > 0.05)))


HISTORY_WARMUP = 256


def history_blend(frames: DataFrame, strength: float = 0.45, history: int = 3, protection: float = 0.75,
                  align: bool = False, plane: str = "luma", cut: str | None = None,
                  rows: int = 4096) -> DataFrame:
    """Blends up to three already blended planes into each frame, oldest first.

    Needs global_dx, global_dy, confidence, motion and ready (see ``motion_field``). The recursion
    keeps less than half of its past per step, so ``HISTORY_WARMUP`` extra frames in front of a
    segment give the same state as the whole clip would.
    """
    if history not in (1, 2, 3):
        raise ValueError("history must be 1, 2 or 3")
    keep = ["clip_id", "frame_no", "pw", "ph"]
    base = frames.select(*keep, F.col(plane).alias("plane"), "global_dx", "global_dy", "confidence", "motion", "ready",
                         (F.col(cut) if cut else F.lit(False)).alias("cut"))
    spread = with_halo(base, CLIP, back=HISTORY_WARMUP, rows=rows)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        kept, out, applied = [], [], []
        for row in pdf.itertuples(index=False):
            if row.cut:
                kept = []
            plane_now = np.asarray(row.plane, dtype=float)
            gate = max(0.0, 1 - row.motion / max(0.5, 4 * max(0.15, protection)))
            base_alpha = min(0.32, max(0.0, strength) * 0.28 * gate * row.confidence)
            on = bool(row.ready and not row.cut and kept and row.confidence > 0.12 and base_alpha > 0.002)
            if on:
                for age, old in zip(range(len(kept), 0, -1), kept):
                    plane_now = _blend_shifted(plane_now, old, base_alpha / age, row, age if align else 0)
            kept = (kept + [plane_now])[-history:]
            out.append(plane_now.tolist())
            applied.append(on)
        result = pdf[["clip_id", "frame_no", HOME]].copy()
        result["blended"], result["applied"] = out, applied
        return result[result[HOME]][["clip_id", "frame_no", "blended", "applied"]]

    return spread.groupBy("clip_id", SEG).applyInPandas(
        fold, "clip_id bigint, frame_no bigint, blended array<double>, applied boolean")


def _blend_shifted(plane, old, alpha, row, age):
    if not age:
        return plane * (1 - alpha) + old * alpha
    dx, dy = int(math.floor(row.global_dx * age + 0.5)), int(math.floor(row.global_dy * age + 0.5))
    now, past = plane.reshape(row.ph, row.pw).copy(), old.reshape(row.ph, row.pw)
    y0, y1, x0, x1 = max(0, dy), min(row.ph, row.ph + dy), max(0, dx), min(row.pw, row.pw + dx)
    if y1 > y0 and x1 > x0:
        now[y0:y1, x0:x1] = now[y0:y1, x0:x1] * (1 - alpha) + past[y0 - dy:y1 - dy, x0 - dx:x1 - dx] * alpha
    return now.ravel()
