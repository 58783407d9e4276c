"""Colour arithmetic as column expressions; channels are 0..1 unless named as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.mathx import clamp01, dbl


def luma709(r, g, b) -> Column:
    return dbl(r) * 0.2126 + dbl(g) * 0.7152 + dbl(b) * 0.0722


def luma601(r, g, b) -> Column:
    return dbl(r) * 0.299 + dbl(g) * 0.587 + dbl(b) * 0.114


def integer_luma(r, g, b) -> Column:
    """(54 r + 183 g + 19 b) >> 8 on bytes."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.shiftright((c(r) * 54 + c(g) * 183 + c(b) * 19).cast("int"), 8)


def chroma_blue(r, g, b, centre: float = 0.5) -> Column:
    return dbl(r) * -0.168736 - dbl(g) * 0.331264 + dbl(b) * 0.5 + centre


def chroma_red(r, g, b, centre: float = 0.5) -> Column:
    return dbl(r) * 0.5 - dbl(g) * 0.418688 - dbl(b) * 0.081312 + centre


def ycbcr_to_rgb(y, cb, cr) -> Column:
    y, cb, cr = dbl(y), dbl(cb) - 0.5, dbl(cr) - 0.5
    return F.struct((y + cr * 1.402).alias("r"), (y - cb * 0.344136 - cr * 0.714136).alias("g"),
                    (y + cb * 1.772).alias("b"))


def hue(r, g, b) -> Column:
    """Hue 0..1; grey has hue 0."""
    r, g, b = dbl(r), dbl(g), dbl(b)
    top = F.greatest(r, g, b)
    d = top - F.least(r, g, b)
    # The red branch keeps the sign of its remainder; one turn is added below.
    raw = (F.when(top == r, F.try_divide(g - b, d) % 6).when(top == g, F.try_divide(b - r, d) + 2)
           .otherwise(F.try_divide(r - g, d) + 4)) / 6
    return F.when(d == 0, 0.0).otherwise(F.when(raw < 0, raw + 1).otherwise(raw))


def saturation(r, g, b) -> Column:
    r, g, b = dbl(r), dbl(g), dbl(b)
    top = F.greatest(r, g, b)
    return F.when(top == 0, 0.0).otherwise(F.try_divide(top - F.least(r, g, b), top))


def hsv_channel(h, s, v, channel: str) -> Column:
    """One RGB channel of an HSV colour: v - v s max(0, min(k, 4 - k, 1)), k = (n + 6 h) mod 6."""
    n = {"r": 5.0, "g": 3.0, "b": 1.0}[channel]
    k = (dbl(h) * 6 + n) % 6
    return dbl(v) - dbl(v) * dbl(s) * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))


def hue_weight(h, centre: float) -> Column:
    d = F.abs(dbl(h) - centre)
    d = F.least(d, F.lit(1.0) - d)
    return F.greatest(F.lit(0.0), F.lit(1.0) - d / 0.34)


def smooth_band(x, left: float, centre: float, right: float) -> Column:
    """Triangle weight; a side whose ends meet counts as fully inside."""
    x = dbl(x)
    rising = F.lit(1.0) if centre == left else clamp01((x - left) / max(1e-6, centre - left))
    falling = F.lit(1.0) if centre == right else clamp01((F.lit(right) - x) / max(1e-6, right - centre))
    below = x <= centre if centre == left else x < centre
    return F.when(below, rising).otherwise(falling)


# ---- skin rules: three different ones, on bytes ----------------------------------------------

def _range(r, g, b):
    return F.greatest(r, g, b) - F.least(r, g, b)


def skin_strict(r, g, b) -> Column:
    r, g, b = dbl(r), dbl(g), dbl(b)
    return ((r > 95) & (g > 40) & (b > 20) & (_range(r, g, b) > 15) & (F.abs(r - g) > 15) & (r > g) & (r > b))


def skin_loose(r, g, b) -> Column:
    r, g, b = dbl(r), dbl(g), dbl(b)
    return (r > 80) & (g > 30) & (b > 15) & (_range(r, g, b) > 12) & (r > g * 0.92) & (r > b)


def skin_chroma(r, g, b) -> Column:
    r, g, b = dbl(r), dbl(g), dbl(b)
    cb, cr = chroma_blue(r, g, b, 128.0), chroma_red(r, g, b, 128.0)
    return (r + g + b > 90) & cb.between(72, 138) & cr.between(126, 184)
