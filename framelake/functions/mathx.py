"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def dbl(c) -> Column:
    return col(c).cast("double")


def js_round(c) -> Column:
    """Round half up, also for negative halves: floor(x + 0.5)."""
    return F.floor(dbl(c) + 0.5).cast("double")


def round_to(c, digits: int) -> Column:
    """Half-up rounding to a number of decimals through js_round."""
    scale = float(10 ** digits)
    return js_round(dbl(c) * scale) / scale


def clamp(c, low, high) -> Column:
    """Bounds a value; null and NaN give the lower bound."""
    low, high = dbl(low), dbl(high)
    value = F.nanvl(dbl(c), low)
    return F.least(high, F.greatest(low, F.coalesce(value, low)))


def clamp_zero(c, low, high) -> Column:
    """Bounds a value; null and NaN count as zero *before* bounding."""
    value = F.coalesce(F.nanvl(dbl(c), F.lit(0.0)), F.lit(0.0))
    return F.least(dbl(high), F.greatest(dbl(low), value))


def clamp01(c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dbl(c)))


def falsy_to(c, default) -> Column:
    """null, NaN and 0 become the default."""
    value = dbl(c)
    return F.when(value.isNull() | F.isnan(value) | (value == 0), dbl(default)).otherwise(value)


def finite_or(c, default) -> Column:
    value = dbl(c)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, dbl(default)).otherwise(value)


def smoothstep(edge0, edge1, c) -> Column:
    x = clamp_zero((dbl(c) - dbl(edge0)) / F.greatest(F.lit(1e-6), dbl(edge1) - dbl(edge0)), 0, 1)
    return x * x * (F.lit(3.0) - x * 2)


def lerp(a, b, t) -> Column:
    return dbl(a) + (dbl(b) - dbl(a)) * dbl(t)


def even_size(c) -> Column:
    """Nearest even integer, at least 2."""
    return F.greatest(F.lit(2.0), js_round(dbl(c) / 2) * 2)


def db_to_gain(db) -> Column:
    return F.pow(F.lit(10.0), dbl(db) / 20)


def hash_noise(x, y) -> Column:
    """Repeatable 0..1 noise of a pixel position."""
    v = F.sin(dbl(x) * 12.9898 + dbl(y) * 78.233) * 43758.5453
    return v - F.floor(v)


def byte(c) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), js_round(c)))


# ---- time -------------------------------------------------------------------------------

def seconds_to_us(c) -> Column:
    return F.floor(dbl(c) * 1_000_000 + 0.5).cast("bigint")


def us_to_seconds(c) -> Column:
    return dbl(c) / 1_000_000


def step_us(fps) -> Column:
    return F.lit(1_000_000.0) / dbl(fps)


def micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(col(c).cast("timestamp"))


def normalize_fps(c) -> Column:
    """30 for missing or non-positive rates, else 3 decimals within 1..240."""
    value = finite_or(c, 0.0)
    return F.when(value <= 0, F.lit(30.0)).otherwise(
        F.greatest(F.lit(1.0), F.least(F.lit(240.0), round_to(value, 3))))
