"""Box geometry as column expressions over struct or plain columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.mathx import dbl


def iou(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """Intersection over union of two box structs; ``floor`` bounds the union from below."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    common = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    return common / F.greatest(F.lit(floor), a["width"] * a["height"] + b["width"] * b["height"] - common)


def expand_box(box: Column, max_width, max_height, ratio: float) -> Column:
    """Grows a box by a share of its size and clips it to the frame, on whole pixels."""
    grow_x, grow_y = box["width"] * ratio / 2, box["height"] * ratio / 2
    x = F.greatest(F.lit(0.0), F.floor(box["x"] - grow_x).cast("double"))
    y = F.greatest(F.lit(0.0), F.floor(box["y"] - grow_y).cast("double"))
    right = F.least(dbl(max_width), F.ceil(box["x"] + box["width"] + grow_x).cast("double"))
    bottom = F.least(dbl(max_height), F.ceil(box["y"] + box["height"] + grow_y).cast("double"))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"))


def roll_radians(first_x, first_y, second_x, second_y, max_degrees: float = 35.0) -> Column:
    """In-plane roll from two eye positions, bounded; 0 when unknown or less than 2 pixels apart."""
    dx, dy = dbl(second_x) - dbl(first_x), dbl(second_y) - dbl(first_y)
    most = max_degrees * math.pi / 180
    angle = F.greatest(F.lit(-most), F.least(F.lit(most), F.atan2(dy, dx)))
    return F.when(dx.isNull() | dy.isNull() | (F.hypot(dx, dy) < 2), 0.0).otherwise(angle)
