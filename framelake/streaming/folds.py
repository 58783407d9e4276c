"""Per-key steps of the streaming operators.

A fold takes the state so far (a dict of JSON values, or None) and the new rows of one key in
order, and returns output rows and the next state. The folds are plain functions: the same code
can be tested without a stream.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from framelake.operators.audio import FALL, LEAST_GAIN, MOST_GAIN, RISE, Passes, filter_block, gain_of


def _missing(delta: np.ndarray, expected: float) -> int:
    late = delta[delta > expected * 1.5]
    return int(np.maximum(1, np.floor(late / expected + 0.5) - 1).sum())


def pacing_fold(expected_us: float, tolerance: float = 0.08):
    limit = max(2.0, expected_us * tolerance)

    def fold(state, pdf):
        state = state or {"frames": 0, "last": None, "non_monotonic": 0, "irregular": 0, "missing": 0, "min": None, "max": None}
        pts = pdf["pts_us"].to_numpy()
        delta = np.diff(pts if state["last"] is None else np.concatenate([[state["last"]], pts]))
        ahead = delta[delta > 0]
        state["non_monotonic"] += int((delta <= 0).sum())
        state["irregular"] += int((np.abs(ahead - expected_us) > limit).sum())
        state["missing"] += _missing(ahead.astype(float), expected_us)
        if len(ahead):
            low, high = int(ahead.min()), int(ahead.max())
            state["min"] = low if state["min"] is None else min(low, state["min"])
            state["max"] = high if state["max"] is None else max(high, state["max"])
        state["frames"] += len(pts)
        state["last"] = int(pts[-1])
        out = {"frames": state["frames"], "non_monotonic": state["non_monotonic"], "irregular": state["irregular"],
               "missing": state["missing"], "min_delta_us": state["min"], "max_delta_us": state["max"]}
        return pd.DataFrame([out]), state

    return fold


PACING_OUT = ("frames bigint, non_monotonic bigint, irregular bigint, missing bigint, min_delta_us bigint, max_delta_us bigint")


def integrity_fold(expected_us: float, tolerance_us: float = 2500):
    """Source gaps against the running end, order against the previous pts, and output gaps."""
    tolerance = max(250.0, float(tolerance_us) or 2500.0)

    def fold(state, pdf):
        state = state or {"decoded": 0, "last": None, "end": None, "gaps": 0, "gap_us": 0, "back": 0, "stuck": 0, "missing": 0}
        pts = pdf["pts_us"].to_numpy()
        ends = pts + np.maximum(1, pdf["dur_us"].to_numpy())
        first = state["end"] is None
        reach = np.maximum.accumulate(ends if first else np.concatenate([[state["end"]], ends]))
        before = reach[:-1]
        late = pts[1:] if first else pts
        gap = late > before + tolerance
        state["gaps"] += int(gap.sum())
        state["gap_us"] += int((late - before)[gap].sum())
        delta = np.diff(pts if state["last"] is None else np.concatenate([[state["last"]], pts]))
        state["back"] += int((delta < 0).sum())
        state["stuck"] += int((delta <= 0).sum())
        state["missing"] += _missing(delta[delta > 0].astype(float), expected_us)
        state.update(decoded=state["decoded"] + len(pts), last=int(pts[-1]), end=int(reach[-1]))
        out = {"decoded": state["decoded"], "source_gaps": state["gaps"], "source_gap_us": state["gap_us"],
               "source_non_monotonic": state["back"], "output_non_monotonic": state["stuck"], "output_missing": state["missing"]}
        return pd.DataFrame([out]), state

    return fold


INTEGRITY_OUT = ("decoded bigint, source_gaps bigint, source_gap_us bigint, source_non_monotonic bigint, "
                 "output_non_monotonic bigint, output_missing bigint")


def plane_score(a: np.ndarray, b: np.ndarray) -> float:
    """Pixel and histogram change of two byte planes, as in the batch operator."""
    if len(a) != len(b) or not len(a):
        raise ValueError("planes must have equal, non-zero length")
    pixel = np.abs(a - b).sum() / (len(a) * 255)
    moved = np.abs(np.sort(np.minimum(31, a >> 3)) - np.sort(np.minimum(31, b >> 3))).sum() / (len(a) * 31)
    return min(1.0, pixel * 0.68 + moved * 0.32)


def scene_fold(threshold: float = 0.34, order: str = "frame_no", plane: str = "luma"):
    def fold(state, pdf):
        state = state or {"plane": None, "scene": 0}
        previous = None if state["plane"] is None else np.asarray(state["plane"])
        out = []
        for number, raw in zip(pdf[order], pdf[plane]):
            current = np.asarray(raw, dtype=np.int64)
            score = None if previous is None else plane_score(previous, current)
            cut = score is not None and score >= threshold
            state["scene"] += int(cut)
            out.append((number, score, cut, state["scene"]))
            previous = current
        state["plane"] = previous.tolist()
        return pd.DataFrame(out, columns=[order, "score", "cut", "scene_id"]), state

    return fold


def duplicate_fold(look_back: int = 2, threshold: float = 0.006, cut_threshold: float = 0.24, order: str = "frame_no",
                   plane: str = "luma"):
    def fold(state, pdf):
        kept = [np.asarray(p) for p in (state or {"planes": []})["planes"]]
        out = []
        for number, raw in zip(pdf[order], pdf[plane]):
            current = np.asarray(raw, dtype=np.int64)
            distance = [np.abs(current - old).sum() / (len(current) * 255) if len(old) == len(current) else 1.0 for old in kept]
            if distance and distance[-1] >= cut_threshold:
                kept, distance = [], []
            out.append((number, any(d <= threshold for d in distance)))
            kept = (kept + [current])[-look_back:]
        return pd.DataFrame(out, columns=[order, "duplicate"]), {"planes": [p.tolist() for p in kept]}

    return fold


def hysteresis_fold(value: str = "status", high: float = 4, low: float = 2, order: str = "frame_no"):
    def fold(state, pdf):
        on = (state or {"on": False})["on"]
        level = pdf[value].to_numpy()
        mark = pd.Series(np.where(level >= high, 1.0, np.where(level <= low, 0.0, np.nan)))
        now = mark.ffill().fillna(float(on)).to_numpy().astype(bool)
        before = np.concatenate([[on], now[:-1]])
        moved = now != before
        out = pdf.loc[moved, [order, "pts_us"]].copy()
        out["action"] = np.where(now[moved], "autopause", "autoresume")
        return out, {"on": bool(now[-1])}

    return fold


def audio_fold(highpass_hz=70, lowpass_hz=16000, gate_db=-48, noise_reduction=0.18, target_db=-16, limiter_db=-1.5, user_db=0):
    """Filter chain and adaptive gain over interleaved blocks, with running totals."""
    passes = Passes(highpass_hz, lowpass_hz)
    gate, target, limit, user = gain_of(gate_db), gain_of(target_db), gain_of(limiter_db), gain_of(user_db)

    def fold(state, pdf):
        state = state or {"channels": [], "gain": 1.0, "blocks": 0, "frames": 0, "clipped": 0, "peak": 0.0, "squares": 0.0}
        out = []
        for row in pdf.itertuples(index=False):
            samples = np.asarray(row.samples, dtype=float).reshape(-1, row.channels)
            while len(state["channels"]) < row.channels:
                state["channels"].append([0.0, 0.0, 1.0])
            done = np.empty_like(samples)
            for c in range(row.channels):
                done[:, c], state["channels"][c] = filter_block(samples[:, c], float(row.rate), passes, gate, noise_reduction, state["channels"][c])
            rms = math.sqrt(float((done * done).sum()) / max(1, done.size))
            if rms > gate:
                wanted = min(MOST_GAIN, max(LEAST_GAIN, target / max(rms, 1e-6)))
                state["gain"] += (wanted - state["gain"]) * (FALL if wanted < state["gain"] else RISE)
            raised = done * state["gain"] * user
            state["clipped"] += int((np.abs(raised) > limit).sum())
            final = np.clip(raised, -limit, limit)
            state["peak"] = max(state["peak"], float(np.abs(final).max(initial=0)))
            state.update(blocks=state["blocks"] + 1, frames=state["frames"] + len(samples), squares=state["squares"] + rms * rms)
            out.append((row.block_no, rms, state["gain"], final.ravel().tolist(), state["clipped"], state["peak"],
                        math.sqrt(state["squares"] / state["blocks"])))
        return pd.DataFrame(out, columns=["block_no", "block_rms", "gain", "samples", "clipped_total", "peak_total", "average_rms"]), state

    return fold


AUDIO_OUT = ("block_no bigint, block_rms double, gain double, samples array<double>, clipped_total bigint, peak_total double, "
             "average_rms double")


def resample_fold(step_us: float):
    """Ticks of every completed pair; the last frame waits in the state until it is flushed."""
    def fold(state, pdf):
        state = state or {"first": None, "last": None, "dur": 0, "number": -1}
        out = []
        for pts, dur in zip(pdf["pts_us"], pdf["dur_us"]):
            pts = int(pts)
            if state["first"] is None:
                state["first"] = pts
            else:
                out += _pair_ticks(state["first"], state["last"], pts, state["number"], step_us)
            state.update(last=pts, dur=int(dur), number=state["number"] + 1)
        return pd.DataFrame(out, columns=RESAMPLE_COLUMNS), state

    return fold


RESAMPLE_COLUMNS = ["tick_no", "pts_us", "source_no", "t"]
RESAMPLE_OUT = "tick_no bigint, pts_us bigint, source_no bigint, t double"


def _pair_ticks(first: int, a: int, b: int, number: int, step: float) -> list[tuple]:
    low, high = math.ceil((a - 0.5 - first) / step), math.ceil((b - 0.5 - first) / step) - 1
    rows = []
    for k in range(low, high + 1):
        tau = first + k * step
        t = min(1.0, max(0.0, (tau - a) / max(1, b - a)))
        rows.append((k, math.floor(tau + 0.5), number if t < 0.5 else number + 1, t))
    return rows


def resample_flush(step_us: float):
    """The tick after the last frame, when it still lies within the frame's duration."""
    def flush(state):
        if not state or state["last"] is None:
            return pd.DataFrame(columns=RESAMPLE_COLUMNS)
        k = math.ceil((state["last"] - 0.5 - state["first"]) / step_us)
        tau = state["first"] + k * step_us
        rows = [(k, math.floor(max(tau, state["last"]) + 0.5), state["number"], 0.0)] if tau <= state["last"] + state["dur"] else []
        return pd.DataFrame(rows, columns=RESAMPLE_COLUMNS)

    return flush
