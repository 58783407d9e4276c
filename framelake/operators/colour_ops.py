"""Tone mapping, grading, curves and lookup tables over tables of colour samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import colour as co
from framelake.functions.mathx import byte, clamp01, dbl

# Neutral parameters of the two chains (fixed values).
TONE_NEUTRAL = {"temperature": 0.0, "tint": 0.0, "lift": 0.0, "exposure": 0.0, "shadows": 0.0, "highlights": 0.0,
                "blacks": 0.0, "whites": 0.0, "dehaze": 0.0, "gamma": 1.0, "gain": 1.0, "contrast": 1.0,
                "brightness": 0.0, "saturation": 1.0, "vibrance": 0.0}
GRADE_LIMITS = {"tint": (0.0, -1.0, 1.0), "lift": (0.0, -0.5, 0.5), "gamma": (1.0, 0.1, 3.0), "gain": (1.0, 0.1, 3.0),
                "offset": (0.0, -0.5, 0.5), "hue_rotate": (0.0, -180.0, 180.0), "shadow_sat": (1.0, 0.0, 2.5),
                "mid_sat": (1.0, 0.0, 2.5), "highlight_sat": (1.0, 0.0, 2.5), "red_sat": (1.0, 0.0, 2.5),
                "green_sat": (1.0, 0.0, 2.5), "blue_sat": (1.0, 0.0, 2.5)}
IDENTITY_MIXER = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
IDENTITY_CURVE = ((0.0, 0.0), (1.0, 1.0))

RGB = ("r", "g", "b")


def _set(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Replaces several columns at once; each step stays its own projection, so no term is repeated."""
    return df.withColumns(values)


def _step(low: float, high: float, v: Column) -> Column:
    t = clamp01((v - low) / (high - low))
    return t * t * (F.lit(3.0) - t * 2)


def tone_map(samples: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """Point part of the effect chain on byte samples; returns bytes.

    Order: temperature/tint/lift, exposure, zones, dehaze, gamma, gain, contrast, brightness,
    saturation, vibrance. Luma is taken after brightness and not again after saturation. Neutral
    steps add no expression.
    """
    p = {**TONE_NEUTRAL, **(params or {})}
    df = _set(samples, {c: dbl(c) / 255 for c in RGB})
    t, tint, lift = p["temperature"], p["tint"], p["lift"]
    if t or tint or lift or p["exposure"]:
        scale = 2.0 ** p["exposure"]
        shift = {"r": t * 0.08 + tint * 0.025 + lift, "g": -tint * 0.05 + lift, "b": -t * 0.08 + tint * 0.025 + lift}
        df = _set(df, {c: (F.col(c) + shift[c]) * scale for c in RGB})
    if any(p[k] for k in ("shadows", "highlights", "blacks", "whites")):
        df = df.withColumn("_l", co.luma709(*RGB))
        l, bounded = F.col("_l"), clamp01("_l")
        zone = (F.pow(F.lit(1.0) - bounded, F.lit(2.0)) * p["shadows"] * 0.28 + F.pow(bounded, F.lit(2.0)) * p["highlights"] * 0.24
                + (F.lit(1.0) - _step(0.08, 0.38, l)) * p["blacks"] * 0.16 + _step(0.62, 0.94, l) * p["whites"] * 0.14)
        df = df.withColumn("_z", zone)
        df = _set(df, {c: F.col(c) + F.col("_z") for c in RGB})
    if p["dehaze"]:
        d = p["dehaze"]
        df = _set(df, {c: (F.col(c) - 0.5) * (1 + d * 0.34) + 0.5 for c in RGB}).withColumn("_l", co.luma709(*RGB))
        df = _set(df, {c: F.col("_l") + (F.col(c) - F.col("_l")) * (1 + d * 0.18) for c in RGB})
    df = _set(df, {c: (F.pow(clamp01(c), F.lit(1 / p["gamma"])) * p["gain"] - 0.5) * p["contrast"] + 0.5 + p["brightness"] for c in RGB})
    df = df.withColumn("_l", co.luma709(*RGB))
    df = _set(df, {c: F.col("_l") + (F.col(c) - F.col("_l")) * p["saturation"] for c in RGB})
    df = df.withColumn("_v", (F.lit(1.0) - clamp01(F.greatest(*RGB) - F.least(*RGB))) * p["vibrance"] + 1)
    df = _set(df, {c: byte((F.col("_l") + (F.col(c) - F.col("_l")) * F.col("_v")) * 255).cast("int") for c in RGB})
    return df.drop("_l", "_z", "_v")


# ---- curves -------------------------------------------------------------------------------

def parse_curve(text: str) -> list[tuple[float, float]]:
    """Points of an ``x:y,x:y`` text; must run from x=0 to x=1 with increasing x, all within 0..1."""
    try:
        points = sorted(tuple(float(v) for v in part.strip().split(":")[:2]) for part in str(text).split(","))
        valid = len(points) >= 2 and all(len(p) == 2 and all(math.isfinite(v) and 0 <= v <= 1 for v in p) for p in points)
    except ValueError:
        valid = False
    if not valid:
        raise ValueError("curve points must be x:y pairs between 0 and 1")
    if points[0][0] != 0 or points[-1][0] != 1:
        raise ValueError("a curve must start at x=0 and end at x=1")
    if any(b[0] <= a[0] for a, b in zip(points, points[1:])):
        raise ValueError("curve x values must be unique and increasing")
    return points


def points_literal(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def curve_value(v, points: Sequence[tuple[float, float]] | Column) -> Column:
    """Piecewise-linear curve read at v bounded to 0..1: through fixed points, or through a per-row
    array of (x, y) structs."""
    x = clamp01(v)
    if isinstance(points, Column):
        left = F.element_at(F.filter(points, lambda p: p["x"] <= x), -1)
        right = F.get(F.filter(points, lambda p: p["x"] > x), F.lit(0))
        share = F.try_divide(x - left["x"], right["x"] - left["x"])
        return F.when(right.isNull(), left["y"]).otherwise(clamp01(left["y"] + (right["y"] - left["y"]) * share))
    if [tuple(map(float, p)) for p in points] == list(IDENTITY_CURVE):
        return x
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, (x - x0) / (x1 - x0) * (y1 - y0) + y0).otherwise(out)
    return out


def curve_apply(samples: DataFrame, curve: str | Column, value: str = "value", out: str = "mapped") -> DataFrame:
    """Maps a 0..1 column through a curve text, or through a per-row array of points.

    A curve has few segments: they are cases of one expression, or an array in the row, so the
    range lookup needs no join.
    """
    points = curve if isinstance(curve, Column) else parse_curve(curve)
    return samples.withColumn(out, curve_value(value, points))


# ---- lookup tables ------------------------------------------------------------------------

def lattice_rows_to_luts(headers: DataFrame, lattice: DataFrame) -> DataFrame:
    """One row per table: type, size, domain and the colours in file order as an array.

    The format bounds a table at 65^3 entries, so a row stays small.
    """
    ordered = lattice.groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("i", *RGB))).alias("_e"))
    channel = lambda c: F.transform("_e", lambda e: e[c]).alias(f"data_{c}")
    colours = ordered.select("lut_id", *[channel(c) for c in RGB])
    return headers.select("lut_id", "type", "size", "domain_min", "domain_max").join(colours, "lut_id")


def lut_apply(samples: DataFrame, luts: DataFrame, strength: float | Column = 1.0, key: str = "lut_id") -> DataFrame:
    """Trilinear (3d) or linear (1d) table lookup of 0..1 samples, blended by strength.

    An equi-join on the table id; the table side has one bounded row per id, and adaptive
    execution broadcasts it when its measured size allows. The eight corners are array reads.
    """
    df = samples.join(luts, key)
    last = F.col("size") - 1
    for i, c in enumerate(RGB):
        low, high = F.get("domain_min", F.lit(i)), F.get("domain_max", F.lit(i))
        df = df.withColumn(f"_p{c}", clamp01((dbl(c) - low) / (high - low)) * last)
        df = df.withColumn(f"_l{c}", F.floor(f"_p{c}").cast("int"))
        df = df.withColumns({f"_m{c}": F.col(f"_p{c}") - F.col(f"_l{c}"), f"_h{c}": F.least(last, F.col(f"_l{c}") + 1)})
    size = F.col("size")
    # Row starts of the four (green, blue) corners, shared by the channels.
    df = _set(df, {f"_s{g}{b}": (F.col(f"_{b}b") * size + F.col(f"_{g}g")) * size for g in "lh" for b in "lh"})

    def mix3(c):
        along = lambda start: _between(F.get(f"data_{c}", F.col(start) + F.col("_lr")), F.get(f"data_{c}", F.col(start) + F.col("_hr")), "_mr")
        return _between(_between(along("_sll"), along("_shl"), "_mg"), _between(along("_slh"), along("_shh"), "_mg"), "_mb")

    def mix1(c):
        return _between(F.get(f"data_{c}", F.col(f"_l{c}")), F.get(f"data_{c}", F.col(f"_h{c}")), f"_m{c}")

    amount = strength if isinstance(strength, Column) else F.lit(float(strength))
    df = _set(df, {f"_o{c}": clamp01(F.when(F.col("type") == "3d", mix3(c)).otherwise(mix1(c))) for c in RGB})
    df = _set(df, {c: dbl(c) + (F.col(f"_o{c}") - dbl(c)) * amount for c in RGB})
    helpers = [f"_{kind}{c}" for kind in "plmho" for c in RGB] + [f"_s{g}{b}" for g in "lh" for b in "lh"]
    return df.drop("type", "size", "domain_min", "domain_max", *[f"data_{c}" for c in RGB], *helpers)


def _between(low: Column, high: Column, share: str) -> Column:
    return low * (F.lit(1.0) - F.col(share)) + high * F.col(share)


# ---- grading ------------------------------------------------------------------------------

def compile_grade(params: dict | None = None) -> dict:
    """Bounded parameters. As in the rest of the chain a 0 means "not set": a saturation of 0
    becomes 1."""
    params = params or {}
    out = {k: min(high, max(low, float(params.get(k) or neutral))) for k, (neutral, low, high) in GRADE_LIMITS.items()}
    mixer = [float(v) for v in params.get("mixer") or IDENTITY_MIXER]
    out["mixer"] = [min(2.5, max(0.0 if i in (0, 4, 8) else -1.5, v)) for i, v in enumerate(mixer)]
    curves = params.get("curves") or {}
    out["curves"] = {k: parse_curve(curves[k]) if curves.get(k) else list(IDENTITY_CURVE) for k in ("luma", "red", "green", "blue")}
    out["lut_strength"] = min(1.0, max(0.0, float(params.get("lut_strength") or 0) / 100))
    return out


def needs_pass(params: dict | None) -> bool:
    """False when every parameter is neutral, so that callers can skip the whole step."""
    if params is not None and params.get("enabled") is False:
        return False
    p = compile_grade(params)
    plain = all(abs(p[k] - neutral) <= 1e-4 for k, (neutral, _, _) in GRADE_LIMITS.items())
    mixer = all(abs(a - b) < 1e-4 for a, b in zip(p["mixer"], IDENTITY_MIXER))
    return not (plain and mixer and all(tuple(map(tuple, c)) == IDENTITY_CURVE for c in p["curves"].values()) and not p["lut_strength"])


def color_grade(samples: DataFrame, params: dict | None = None, luts: DataFrame | None = None) -> DataFrame:
    """Tint, lift, gamma, gain, offset, hue and saturation bands, mixer, curves and lookup table on
    byte samples; returns bytes."""
    p = compile_grade(params)
    tint = p["tint"] * 0.055
    shift = {"r": p["lift"] + tint * 0.45, "g": p["lift"] - tint, "b": p["lift"] + tint * 0.45}
    df = _set(samples, {c: clamp01(F.pow(clamp01(dbl(c) / 255 + shift[c]), F.lit(1 / p["gamma"])) * p["gain"] + p["offset"]) for c in RGB})
    bands = ("shadow_sat", "mid_sat", "highlight_sat", "red_sat", "green_sat", "blue_sat")
    if abs(p["hue_rotate"]) > 1e-4 or any(p[k] != 1 for k in bands):
        df = _saturation_bands(df, p)
    if tuple(p["mixer"]) != IDENTITY_MIXER:
        m = p["mixer"]
        df = _set(df, {c: F.col("r") * m[3 * i] + F.col("g") * m[3 * i + 1] + F.col("b") * m[3 * i + 2] for i, c in enumerate(RGB)})
    df = df.withColumn("_y", co.luma709(*RGB))
    df = df.withColumn("_d", curve_value("_y", p["curves"]["luma"]) - F.col("_y"))
    names = dict(zip(RGB, ("red", "green", "blue")))
    df = _set(df, {c: curve_value(F.col(c) + F.col("_d"), p["curves"][names[c]]) for c in RGB}).drop("_y", "_d")
    if luts is not None and p["lut_strength"] > 0:
        df = lut_apply(df, luts, p["lut_strength"])
    return _set(df, {c: byte(F.col(c) * 255).cast("int") for c in RGB})


def _saturation_bands(df: DataFrame, p: dict) -> DataFrame:
    df = df.withColumns({"_h": (co.hue(*RGB) + p["hue_rotate"] / 360 + 1) % 1, "_s": co.saturation(*RGB),
                         "_top": F.greatest(*RGB), "_y": co.luma709(*RGB)})
    weights = [(p["shadow_sat"], co.smooth_band("_y", 0.0, 0.0, 0.45)), (p["mid_sat"], co.smooth_band("_y", 0.15, 0.5, 0.85)),
               (p["highlight_sat"], co.smooth_band("_y", 0.55, 1.0, 1.0))]
    hues = [(p["red_sat"], co.hue_weight("_h", 0.0)), (p["green_sat"], co.hue_weight("_h", 1 / 3)),
            (p["blue_sat"], co.hue_weight("_h", 2 / 3))]
    ratio = lambda pairs: (sum((w * k for k, w in pairs), F.lit(0.0))
                           / F.greatest(F.lit(1e-6), sum((w for _, w in pairs), F.lit(0.0))))
    df = df.withColumn("_s", clamp01(F.col("_s") * ratio(weights) * ratio(hues)))
    return _set(df, {c: co.hsv_channel("_h", "_s", "_top", c) for c in RGB}).drop("_h", "_s", "_top", "_y")
