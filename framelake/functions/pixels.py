"""Numpy helpers that Arrow UDFs call on batches of small planes.

A batch is an (n, height, width) array; every step works on all planes of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def same_size(pw: pa.Array, ph: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row indices of a batch grouped by plane size."""
    sizes = np.stack([pw.to_numpy(zero_copy_only=False), ph.to_numpy(zero_copy_only=False)], axis=1)
    for width, height in np.unique(sizes, axis=0):
        yield int(width), int(height), np.flatnonzero((sizes[:, 0] == width) & (sizes[:, 1] == height))


def stacked(planes: pa.Array, rows: np.ndarray, width: int, height: int) -> np.ndarray:
    """The chosen rows as float planes; a null or wrongly sized plane is an error."""
    chosen = planes.take(pa.array(rows))
    flat = chosen.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(rows) * width * height:
        raise ValueError(f"planes must hold {width}x{height} values")
    return flat.astype(np.float64).reshape(len(rows), height, width)


def flat_values(planes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch in a row, and how many each plane has; a null plane has none."""
    size = np.zeros(len(planes), np.int64)
    valid = np.flatnonzero(planes.is_valid().to_numpy(zero_copy_only=False))
    if len(valid):
        size[valid] = planes.take(pa.array(valid)).value_lengths().to_numpy(zero_copy_only=False)
    return planes.flatten().to_numpy(zero_copy_only=False), size


def interior(stride: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns visited by an interior scan with a stride, starting at 1."""
    return np.arange(1, height - 1, stride), np.arange(1, width - 1, stride)


def stencil(plane: np.ndarray, stride: int = 1) -> dict[str, np.ndarray]:
    """Centre, gradient and Laplacian of the visited interior pixels."""
    _, height, width = plane.shape
    ys, xs = interior(stride, height, width)
    at = lambda dy, dx: plane[:, ys[:, None] + dy, xs[None, :] + dx]
    centre, left, right, top, bottom = at(0, 0), at(0, -1), at(0, 1), at(-1, 0), at(1, 0)
    return {"centre": centre, "left": left, "top": top,
            "gradient": np.abs(right - left) + np.abs(bottom - top),
            "laplacian": np.abs(4 * centre - left - right - top - bottom), "ys": ys, "xs": xs}


def plane_shifts(previous: np.ndarray, current: np.ndarray, ys: np.ndarray, xs: np.ndarray,
                 radius: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Absolute differences at the sampled positions for every shift, in (dy, dx) order."""
    before = previous[:, ys[:, None], xs[None, :]]
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            yield dy, dx, np.abs(before - current[:, ys[:, None] + dy, xs[None, :] + dx])


def linear_recurrence(keep: np.ndarray, add: np.ndarray, start: float) -> np.ndarray:
    """y[i] = keep[i] * y[i-1] + add[i] for 0 < keep <= 1, without a per-element Python step.

    Works in stretches short enough that the running product of ``keep`` stays a normal float.
    """
    out = np.empty(len(add))
    if not len(add):
        return out
    smallest = float(keep.min())
    if smallest <= 1e-30:  # a factor of (almost) zero forgets everything before it
        cuts = np.flatnonzero(keep <= 1e-30)
        bounds = np.concatenate([[0], cuts, [len(add)]])
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high <= low:
                continue
            if keep[low] <= 1e-30:
                out[low] = keep[low] * start + add[low]
                start, low = out[low], low + 1
            if high > low:
                out[low:high] = linear_recurrence(keep[low:high], add[low:high], start)
            start = out[high - 1]
        return out
    stretch = len(add) if smallest >= 1 else max(1, int(500 / -np.log(smallest)))
    for low in range(0, len(add), stretch):
        part = slice(low, low + stretch)
        product = np.cumprod(keep[part])
        out[part] = product * (start + np.cumsum(add[part] / product))
        start = out[part][-1]
    return out
