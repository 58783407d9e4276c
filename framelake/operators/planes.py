"""Analysis planes: scene cuts, differences, duplicates, blending plans, interpolation and metrics.

Differences and scores are array expressions; neighbourhood scans over whole planes run as Arrow
UDFs on batches of planes.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import pixels
from framelake.functions.mathx import clamp_zero, js_round, smoothstep
from framelake.operators import scans
from framelake.operators.ordered import (
    HOME, SEG, SEGMENT_ROWS, local_window, neighbours, running, upper_median, with_halo,
)

CLIP = ["clip_id"]


# ---- difference measures ------------------------------------------------------------------

def array_sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def mean_abs_difference(a, b) -> Column:
    """Mean |a - b| / 255 of two byte planes; 1 when a side is missing, empty or of another length."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    total = array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits, total / (F.size(a) * 255)).otherwise(1.0)


def scene_score(a, b) -> Column:
    """0..1 score of pixel and histogram change between byte planes of equal length.

    The summed distance of two cumulative 32-bin histograms equals the distance of the sorted bin
    numbers, so no histogram is built.
    """
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    bins = lambda p: F.sort_array(F.transform(p, lambda v: F.least(F.lit(31), F.shiftright(v, 3))))
    n = F.size(a)
    pixel = array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))) / (n * 255)
    histogram = array_sum(F.zip_with(bins(a), bins(b), lambda x, y: F.abs(x - y).cast("double"))) / (n * 31)
    score = F.least(F.lit(1.0), pixel * 0.68 + histogram * 0.32)
    equal = (n > 0) & (n == F.size(b))
    return F.when(equal, score).otherwise(F.raise_error(F.lit("planes must have equal, non-zero length")).cast("double"))


def frame_difference(frames: DataFrame, plane: str = "luma", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Difference to the previous frame of the clip; null on the first frame."""
    out = neighbours(frames, CLIP, lag={"_prev": plane}, rows=rows)
    return out.withColumn("difference", F.when(F.col("_prev").isNotNull(), mean_abs_difference(plane, "_prev"))).drop("_prev")


def scene_segments(frames: DataFrame, threshold: float = 0.34, plane: str = "luma",
                   rows: int = SEGMENT_ROWS) -> DataFrame:
    """Score against the previous frame, cut flag and running scene number."""
    out = neighbours(frames, CLIP, lag={"_prev": plane}, rows=rows)
    out = out.withColumn("score", F.when(F.col("_prev").isNotNull(), scene_score("_prev", plane)))
    out = out.withColumn("cut", F.coalesce(F.col("score") >= threshold, F.lit(False))).drop("_prev", plane)
    out = running(out, CLIP, {"scene_id": ("sum", F.when(F.col("cut"), 1).otherwise(0), True)}, rows=rows)
    return out.withColumn("scene_id", F.col("scene_id").cast("bigint"))


def duplicate_flags(frames: DataFrame, look_back: int = 2, threshold: float = 0.006,
                    cut_threshold: float = 0.24, plane: str = "luma", rows: int = SEGMENT_ROWS) -> DataFrame:
    """A frame is a duplicate when it equals one of the last ``look_back`` frames of its scene
    within the threshold. One shuffle: cuts are counted inside the same halo."""
    look_back = max(1, int(look_back))
    w = local_window(CLIP)
    out = with_halo(frames, CLIP, back=look_back, rows=rows)
    out = out.withColumn("_prev", F.lag(plane).over(w))
    out = out.withColumn("_cut", F.when(F.col("_prev").isNotNull()
                                        & (mean_abs_difference(plane, "_prev") >= cut_threshold), 1).otherwise(0))
    out = out.withColumn("_cuts", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.collect_list(F.struct(F.col("_cuts").alias("cuts"), F.col(plane).alias("plane"))).over(
        w.rowsBetween(-look_back, -1))
    out = out.withColumn("_before", before).where(HOME)
    same = F.exists("_before", lambda p: (p["cuts"] == F.col("_cuts"))
                    & (mean_abs_difference(p["plane"], F.col(plane)) <= threshold))
    return out.withColumn("duplicate", same).drop(SEG, HOME, "_prev", "_cut", "_cuts", "_before")


# ---- temporal plan ------------------------------------------------------------------------

def temporal_blend(difference, strength: float, scene_threshold: float = 0.22) -> Column:
    return _gated(difference, strength, scene_threshold, 0.018, 0.12, 0.42)


def temporal_detail_blend(difference, strength: float, scene_threshold: float = 0.22) -> Column:
    return _gated(difference, strength, scene_threshold, 0.012, 0.075, 0.2)


def _gated(difference, strength, scene_threshold, low, high, most) -> Column:
    amount = clamp_zero(F.lit(strength), 0, 1)
    gate = F.lit(1.0) - smoothstep(low, min(high, scene_threshold), difference)
    off = (amount == 0) | (difference >= scene_threshold)
    return F.when(off, 0.0).otherwise(clamp_zero(amount * most * gate, 0, most))


def exposure_correction(current, previous, strength: float, difference) -> Column:
    amount = clamp_zero(F.lit(strength), 0, 1)
    limit = amount * 0.08
    raw = F.try_divide(previous, current)
    off = (amount == 0) | previous.isNull() | (current < 0.02) | (difference > 0.12)
    return F.when(off, 1.0).otherwise(clamp_zero((raw - 1) * amount + 1, F.lit(1.0) - limit, limit + 1))


def temporal_blend_plan(frames: DataFrame, denoise: float = 0, anti_flicker: float = 0, stability: float = 0,
                        scene_threshold: float = 0.22, plane: str = "luma", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per frame: difference, cut, blend, detail blend and exposure correction; the first frame
    and cuts get 0, 0 and 1."""
    out = frames.withColumn("_mean", array_sum(plane) / (F.size(plane) * 255))
    out = neighbours(out, CLIP, lag={"_prev": plane, "_prev_mean": "_mean"}, rows=rows)
    first = F.col("_prev").isNull()
    out = out.withColumn("difference", F.when(first, 0.0).otherwise(mean_abs_difference(plane, "_prev")))
    out = out.withColumn("cut", ~first & (F.col("difference") >= scene_threshold))
    active = ~first & ~F.col("cut")
    if not (denoise or anti_flicker or stability):
        active = F.lit(False)
        out = out.withColumn("difference", F.lit(0.0)).withColumn("cut", F.lit(False))
    detail = temporal_detail_blend(F.col("difference"), stability, scene_threshold)
    blend = F.greatest(temporal_blend(F.col("difference"), denoise, scene_threshold), detail)
    correction = exposure_correction(F.col("_mean"), F.col("_prev_mean"), anti_flicker, F.col("difference"))
    return (out.withColumn("blend", F.when(active, blend).otherwise(0.0))
            .withColumn("detail_blend", F.when(active, detail).otherwise(0.0))
            .withColumn("exposure_correction", F.when(active, correction).otherwise(1.0))
            .drop("_mean", "_prev", "_prev_mean"))


BLEND_ROWS = 512
#: below these the canvas is left as it is
LEAST_BLEND, LEAST_CORRECTION, MOST_CORRECTION = 0.001, 0.002, 0.08


def temporal_blend_planes(frames: DataFrame, denoise: float = 0, anti_flicker: float = 0, stability: float = 0,
                          scene_threshold: float = 0.22, plane: str = "luma", rows: int = BLEND_ROWS, fan: int = 64) -> DataFrame:
    """The plan's frames with their exposure corrected and blended over the blended frame before: ``blended`` per frame.

    A correction lays white or black over the plane. Every frame is then y = (1 - blend) x + blend y_before, an affine map of
    the plane before it with one factor, so segments compose (see ``scans``); a frame without blend forgets all before it, and a change of
    the plane's size or a null plane differs so much that the plan has no blend there. Values keep their fractions; null planes stay null.
    """
    planned = temporal_blend_plan(frames, denoise, anti_flicker, stability, scene_threshold, plane, rows)
    shift = F.col("exposure_correction") - 1
    veil = F.when(F.abs(shift) > LEAST_CORRECTION, F.signum(shift) * F.least(F.lit(MOST_CORRECTION), F.abs(shift))).otherwise(0.0)
    steps = planned.select("clip_id", "frame_no", F.col(plane).cast("array<double>").alias("plane"), veil.alias("veil"),
                           F.when(F.col("blend") > LEAST_BLEND, F.col("blend")).otherwise(0.0).alias("mix"))

    def stepped(batch: pa.RecordBatch):
        for x, veil, mix in zip(batch.column("plane"), batch.column("veil").to_pylist(), batch.column("mix").to_pylist()):
            if x.is_valid:
                values = x.values.to_numpy(zero_copy_only=False)
                values = values * (1 - abs(veil)) + (255 * veil if veil > 0 else 0)
                yield values, mix
            else:
                yield np.zeros(0), 0.0

    def summarise(batches, prefix):
        factor, offset = 1.0, np.zeros(0)
        for batch in batches:
            for x, mix in stepped(batch):
                before = offset if len(offset) else 0.0
                factor, offset = (factor * mix, (1 - mix) * x + mix * before) if mix else (0.0, x)
        return scans.affine(factor, offset)

    def walk(batches, prefix):
        last = scans.read_affine(prefix)[1] if prefix else np.zeros(0)
        for batch in batches:
            done = []
            for x, mix in stepped(batch):
                last = (1 - mix) * x + mix * last if mix else x
                done.append(last)
            sizes = np.cumsum([0] + [len(d) for d in done])
            kept = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(done)), mask=batch.column("plane").is_null())
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("frame_no"), kept], ["clip_id", "frame_no", "blended"])

    kinds = dict(steps.dtypes)
    done = scans.scan(steps, CLIP, "frame_no", summarise, scans.compose_affine, walk,
                      f"clip_id {kinds['clip_id']}, frame_no {kinds['frame_no']}, blended array<double>", rows, fan)
    return planned.drop(plane).join(done, ["clip_id", "frame_no"])


# ---- interpolation ------------------------------------------------------------------------

def artifact_guard(a, b, c) -> Column:
    """Struct: endpoint difference, differences of the candidate to both ends, clipped share, safe."""
    a, b, c = [F.col(x) if isinstance(x, str) else x for x in (a, b, c)]
    ab, ac, bc = mean_abs_difference(a, b), mean_abs_difference(a, c), mean_abs_difference(b, c)
    clipped = array_sum(F.transform(c, lambda v: F.when((v <= 2) | (v >= 253), 1.0).otherwise(0.0))) / F.size(c)
    limit = F.greatest(F.lit(0.24), ab * 2.8 + 0.05)
    bad = (clipped > 0.86) | ((ab < 0.35) & (ac > limit) & (bc > limit))
    return F.struct(ab.alias("endpoint_difference"), ac.alias("first_difference"), bc.alias("second_difference"),
                    clipped.alias("clipped"), (~bad).alias("safe"))


def dyadic_time(t, depth: int = 3) -> Column:
    """The time a recursive midpoint model really renders for t (fixed tolerances .001, .999, .04)."""
    t = F.col(t) if isinstance(t, str) else t
    if depth <= 0:
        inner = F.lit(0.5)
    else:
        inner = (F.when(F.abs(t - 0.5) < 0.04, 0.5)
                 .when(t < 0.5, dyadic_time(t * 2, depth - 1) / 2)
                 .otherwise(dyadic_time((t - 0.5) * 2, depth - 1) / 2 + 0.5))
    return F.when(t <= 0.001, 0.0).when(t >= 0.999, 1.0).otherwise(inner)


def interpolate_vectors(frames: DataFrame, plan: DataFrame, guard: bool = True, dyadic: bool = False,
                        cut_threshold: float = 0.34, plane: str = "luma", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Planes of a plan's rows (clip_id, source_no, t, ...): the source plane, the nearer end at a
    scene cut or when the guard rejects, else the blend of both ends."""
    pairs = neighbours(frames.select("clip_id", "frame_no", plane), CLIP, lead={"_b": plane}, rows=rows)
    cut = F.when(F.col("_b").isNotNull(), scene_score(plane, "_b") >= cut_threshold)
    pairs = pairs.select("clip_id", F.col("frame_no").alias("source_no"), F.col(plane).alias("_a"), "_b", cut.alias("_cut"))
    out = plan.join(pairs, ["clip_id", "source_no"])
    at = dyadic_time("t") if dyadic else F.col("t")
    out = out.withColumn("_t", at)
    blended = F.zip_with("_a", "_b", lambda x, y: x + (y - x) * F.col("_t"))
    out = out.withColumn("_c", F.when((F.col("t") > 0) & F.col("_b").isNotNull(), blended))
    if guard:
        bytes_c = F.transform("_c", lambda v: js_round(v).cast("int"))
        out = out.withColumn("_safe", artifact_guard(F.col("_a"), F.col("_b"), bytes_c)["safe"])
    else:
        out = out.withColumn("_safe", F.lit(True))
    doubles = lambda c: F.transform(c, lambda v: v.cast("double"))
    nearer = F.when(F.col("t") < 0.5, doubles(F.col("_a"))).otherwise(doubles(F.col("_b")))
    mode = (F.when(F.col("_c").isNull(), "source").when(F.col("_cut"), "cut")
            .when(~F.col("_safe"), "rejected").otherwise("blend"))
    value = (F.when(F.col("mode") == "source", doubles(F.col("_a")))
             .when(F.col("mode") == "blend", F.col("_c")).otherwise(nearer))
    return out.withColumn("mode", mode).withColumn("value", value).drop("_a", "_b", "_c", "_cut", "_t", "_safe")


# ---- per-frame metrics --------------------------------------------------------------------

AUDIT_TYPE = "mean_luma double, clipping_ratio double, detail_index double, high_frequency_index double"
QUALITY_TYPE = ("exposure double, contrast double, noise double, detail double, blocking double, banding double, "
                "clipped_shadows double, clipped_highlights double, saturation double")
AUTOFIX_TYPE = ("exposure double, contrast double, saturation double, noise double, detail double, "
                "clipped_shadows double, clipped_highlights double, skin_presence double")


def _metric_udf(return_type: str, measure, channels: int):
    """Arrow UDF over one grey or three colour planes with pw, ph; ``measure`` maps batches of
    r, g, b planes to a dict of arrays. A grey plane crosses to Python once."""
    names = [part.split()[0] for part in return_type.split(", ")]

    def measured(planes: list[pa.Array], pw: pa.Array, ph: pa.Array) -> pa.Array:
        out = {name: np.empty(len(pw)) for name in names}
        for width, height, rows in pixels.same_size(pw, ph):
            stacked = [pixels.stacked(c, rows, width, height) for c in planes]
            for name, values in measure(*(stacked if len(stacked) == 3 else stacked * 3)).items():
                out[name][rows] = values
        return pa.StructArray.from_arrays([pa.array(out[name]) for name in names], names=names)

    if channels == 1:
        @F.arrow_udf(f"struct<{return_type}>")
        def run(grey: pa.Array, pw: pa.Array, ph: pa.Array) -> pa.Array:
            return measured([grey], pw, ph)
    else:
        @F.arrow_udf(f"struct<{return_type}>")
        def run(r: pa.Array, g: pa.Array, b: pa.Array, pw: pa.Array, ph: pa.Array) -> pa.Array:
            return measured([r, g, b], pw, ph)
    return run


def _luma(r, g, b):
    return r if r is g and g is b else 0.2126 * r + 0.7152 * g + 0.0722 * b


def _audit(r, g, b):
    luma = _luma(r, g, b)
    s = pixels.stencil(luma)
    n, flat = max(1, s["centre"][0].size), (1, 2)
    return {
        "mean_luma": luma.mean(flat) / 255,
        "clipping_ratio": ((luma <= 2) | (luma >= 253)).mean(flat),
        "detail_index": (np.abs(s["centre"] - s["left"]) + np.abs(s["centre"] - s["top"])).sum(flat) / (n * 2) / 255,
        "high_frequency_index": s["laplacian"].sum(flat) / n / 255,
    }


def _saturation(r, g, b, ys, xs):
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    share = np.divide(top - low, top, out=np.zeros_like(top), where=top > 0)
    return share[:, ys[:, None], xs[None, :]]


def _quality(r, g, b, stride=1):
    luma = _luma(r, g, b)
    s = pixels.stencil(luma, stride)
    c, gradient, flat = s["centre"], s["gradient"], (1, 2)
    n = max(1, c[0].size)
    mean = c.sum(flat) / n
    deviation = np.sqrt(np.maximum(0, (c * c).sum(flat) / n - mean * mean))
    border = (s["xs"][None, :] % 8 <= 1) | (s["ys"][:, None] % 8 <= 1)
    return {
        "exposure": mean / 255,
        "contrast": np.clip(deviation / 86, 0, 1.5),
        "noise": np.clip(np.where(gradient < 20, s["laplacian"], 0).sum(flat) / n / 20, 0, 1),
        "detail": np.clip(gradient.sum(flat) / n / 68, 0, 1),
        "blocking": np.clip(np.where(border & (gradient > 12), gradient, 0).sum(flat) / n / 34, 0, 1),
        "banding": np.clip(((gradient < 3).sum(flat) / n - 0.38) / 0.5, 0, 1),
        "clipped_shadows": (c <= 4).sum(flat) / n,
        "clipped_highlights": (c >= 251).sum(flat) / n,
        "saturation": _saturation(r, g, b, s["ys"], s["xs"]).sum(flat) / n,
    }


def _autofix(r, g, b, stride=1):
    luma = _luma(r, g, b)
    s = pixels.stencil(luma, stride)
    c, gradient, flat = s["centre"], s["gradient"], (1, 2)
    n = max(1, c[0].size)
    mean = c.sum(flat) / n
    spread = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    skin = (r > 95) & (g > 40) & (b > 20) & (spread > 15) & (np.abs(r - g) > 15) & (r > g) & (r > b)
    return {
        "exposure": mean / 255,
        "contrast": np.sqrt(np.maximum(0, (c * c).sum(flat) / n - mean * mean)) / 90,
        "saturation": _saturation(r, g, b, s["ys"], s["xs"]).sum(flat) / n,
        "noise": np.minimum(1, np.where(gradient < 18, s["laplacian"], 0).sum(flat) / n / 18),
        "detail": np.minimum(1, gradient.sum(flat) / n / 62),
        "clipped_shadows": (c < 18).sum(flat) / n,
        "clipped_highlights": (c > 238).sum(flat) / n,
        "skin_presence": skin[:, s["ys"][:, None], s["xs"][None, :]].sum(flat) / n,
    }


def _measured(frames: DataFrame, return_type: str, measure, colour: tuple[str, str, str], keep: list[str]) -> DataFrame:
    inputs = colour[:1] if len(set(colour)) == 1 else colour
    run = _metric_udf(return_type, measure, len(inputs))
    return frames.select(*keep, run(*inputs, "pw", "ph").alias("_m")).select(*keep, "_m.*")


def frame_audit(frames: DataFrame, colour=("luma", "luma", "luma"), keep=("clip_id", "frame_no")) -> DataFrame:
    """Mean luma, clipping, detail and high-frequency index of every plane."""
    return _measured(frames, AUDIT_TYPE, _audit, colour, list(keep))


def frame_quality(frames: DataFrame, colour=("luma", "luma", "luma"), keep=("clip_id", "frame_no"), stride: int = 1) -> DataFrame:
    """Nine quality metrics per plane, over every ``stride``-th pixel of every ``stride``-th line."""
    return _measured(frames, QUALITY_TYPE, partial(_quality, stride=stride), colour, list(keep))


def frame_autofix(frames: DataFrame, colour=("luma", "luma", "luma"), keep=("clip_id", "frame_no"), stride: int = 1) -> DataFrame:
    """Eight metrics with the correction thresholds, skin share included."""
    return _measured(frames, AUTOFIX_TYPE, partial(_autofix, stride=stride), colour, list(keep))


def luma_histogram(frames: DataFrame, bins: int = 32, plane: str = "luma", keys=("clip_id", "frame_no")) -> DataFrame:
    """Dense histogram and cumulative counts per frame."""
    shift = int(math.log2(256 // bins))

    @F.arrow_udf("array<struct<bin: int, n: bigint, cumulative: bigint>>")
    def counted(planes: pa.Array) -> pa.Array:
        flat, size = pixels.flat_values(planes)
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.minimum(bins - 1, flat.astype(np.int64) >> shift)
        n = np.bincount(owner * bins + inside, minlength=len(size) * bins).reshape(-1, bins)
        rows = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(bins, dtype=np.int32), len(size))), pa.array(n.ravel()),
                                           pa.array(n.cumsum(axis=1).ravel())], names=["bin", "n", "cumulative"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bins), rows)

    return frames.select(*keys, F.inline(counted(plane)))


# Warning codes of the clip summary with their thresholds (fixed values).
SUMMARY_WARNINGS = (("CLIPPING", "clipping_ratio", ">", 0.035), ("TOO_DARK", "mean_luma", "<", 0.12),
                    ("TOO_BRIGHT", "mean_luma", ">", 0.88), ("EXCESS_SHARPNESS_OR_NOISE", "high_frequency_index", ">", 0.32))


def clip_quality_summary(metrics: DataFrame, keys=("clip_id",), clips: DataFrame | None = None) -> DataFrame:
    """Means of the audit metrics, a 0..100 score and warning codes per clip.

    With ``clips`` given, clips without samples appear with a null score and NO_SAMPLES.
    """
    names = ["clipping_ratio", "mean_luma", "detail_index", "high_frequency_index"]
    out = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("sampled_frames"), *[F.avg(n).alias(n) for n in names])
    if clips is not None:
        out = clips.select(*keys).join(out, list(keys), "left")
    c = {n: F.col(n) for n in names}
    zero = F.lit(0.0)
    raw = (F.lit(100.0) - c["clipping_ratio"] * 420 - F.greatest(zero, c["high_frequency_index"] - 0.28) * 90
           - F.greatest(zero, F.lit(0.1) - c["mean_luma"]) * 120 - F.greatest(zero, c["mean_luma"] - 0.9) * 120)
    tests = [F.when(c[n] > limit if op == ">" else c[n] < limit, code) for code, n, op, limit in SUMMARY_WARNINGS]
    empty = F.col("sampled_frames").isNull()
    return (out.withColumn("score", F.when(~empty, js_round(F.greatest(zero, F.least(F.lit(100.0), raw)))))
            .withColumn("warnings", F.when(empty, F.array(F.lit("NO_SAMPLES"))).otherwise(
                F.filter(F.array(*tests), lambda w: w.isNotNull())))
            .withColumn("clipping_percent", c["clipping_ratio"] * 100)
            .withColumn("sampled_frames", F.coalesce("sampled_frames", F.lit(0))))


def merge_metrics(metrics: DataFrame, columns, keys=("clip_id",)) -> DataFrame:
    """Per clip the upper median of every metric; null and NaN count as 0."""
    return upper_median(metrics, list(keys), list(columns))


def noop_stage_report(before: DataFrame, after: DataFrame, plane: str = "luma") -> DataFrame:
    """Frames whose content fingerprint is the same before and after a stage."""
    mark = lambda df, name: df.select("clip_id", "frame_no", F.xxhash64(plane).alias(name))
    return (mark(before, "fingerprint").join(mark(after, "_after"), ["clip_id", "frame_no"])
            .where(F.col("fingerprint") == F.col("_after")).drop("_after"))
