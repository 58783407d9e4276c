"""Audio blocks: statistics, drift, normalisation, recursive gain and filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.pixels import linear_recurrence
from framelake.operators import scans
from framelake.operators.ordered import SEG, SEGMENT_ROWS, key_totals, segment_of, stored
from framelake.operators.planes import array_sum

CLIP = ["clip_id"]


def gain_of(db: float) -> float:
    return 10.0 ** (db / 20)


def block_rms(samples="samples") -> Column:
    return F.sqrt(array_sum(F.transform(samples, lambda x: x * x)) / F.greatest(F.lit(1), F.size(samples)))


def audio_block_stats(blocks: DataFrame, limiter_db: float = -1.5) -> DataFrame:
    """Per clip: blocks, frames, average RMS over blocks, peak and samples above the limiter."""
    limit = gain_of(limiter_db)
    one = blocks.select(
        "clip_id", block_rms().alias("_rms"), F.array_max(F.transform("samples", lambda x: F.abs(x))).alias("_peak"),
        (F.size("samples") / F.greatest(F.lit(1), F.col("channels"))).cast("bigint").alias("_frames"),
        F.size(F.filter("samples", lambda x: F.abs(x) > limit)).alias("_clipped"))
    return one.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("_frames").alias("frames"),
        F.sqrt(F.avg(F.col("_rms") * F.col("_rms"))).alias("average_rms"),
        F.coalesce(F.max("_peak"), F.lit(0.0)).alias("peak"), F.sum("_clipped").cast("bigint").alias("clipped_samples"))


def peak_normalize(blocks: DataFrame, peak_db: float = -1.5, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Scales a clip so that its peak reaches the target; a silent clip stays as it is."""
    loud = blocks.withColumn("_peak", F.array_max(F.transform("samples", lambda x: F.abs(x))))
    out = key_totals(loud, CLIP, {"clip_peak": ("max", F.col("_peak"))}, position="block_no", rows=rows)
    gain = F.when(F.col("clip_peak") > 0, F.lit(gain_of(peak_db)) / F.col("clip_peak")).otherwise(1.0)
    out = out.withColumn("gain", gain)
    scaled = F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.col("gain"))))
    return (out.withColumn("samples", F.when(F.col("clip_peak") > 0, scaled).otherwise(F.col("samples")))
            .drop("_peak"))


def av_drift(clips: DataFrame, blocks: DataFrame, tolerance_s: float | None = None, key: str = "clip_id") -> DataFrame:
    """Audio span against the video duration of each clip, with mode and verdict.

    Spans are aggregated per track first, so the join meets one row per track.
    """
    end = F.col("ts_us") + F.greatest(F.lit(0.0), F.floor(
        F.size("samples") / F.greatest(F.lit(1), F.col("channels")) / F.col("rate") * 1_000_000 + 0.5))
    spans = blocks.groupBy(F.col("clip_id").alias(key)).agg(
        ((F.max(end) - F.min_by("ts_us", "block_no")) / F.lit(1e6)).alias("measured_audio_s"))
    out = clips.join(spans, key, "left")
    tolerance = (F.lit(float(tolerance_s)) if tolerance_s is not None
                 else F.greatest(F.lit(0.12), F.least(F.lit(0.5), F.col("duration_s") * 0.0025)))
    heard, measured = F.coalesce("has_audio", F.lit(False)), F.col("measured_audio_s") > 0
    out = out.withColumn("tolerance_s", tolerance)
    out = out.withColumn("mode", F.when(~heard, "no-audio").when(F.coalesce(measured, F.lit(False)), "decoded-audio-timeline")
                         .otherwise("container-duration-only"))
    decoded = F.col("mode") == "decoded-audio-timeline"
    return (out.withColumn("measured_audio_s", F.when(decoded, F.col("measured_audio_s")))
            .withColumn("drift_s", F.when(~heard, 0.0).when(decoded, F.col("measured_audio_s") - F.col("duration_s")))
            .withColumn("valid", F.coalesce(F.abs("drift_s") <= F.col("tolerance_s"), F.lit(True))))


#: every wanted gain lies between these, and so does the first one, 1
LEAST_GAIN, MOST_GAIN = 0.35, 4.0
FALL, RISE = 0.28, 0.035


def _toward(gain, wanted):
    """One step of the recursion: quick down, slow up."""
    return gain + (wanted - gain) * np.where(gain > wanted, FALL, RISE)


def _gain_curve(wanted: np.ndarray) -> scans.Curve:
    """End gain of a run of blocks as a function of the gain before them.

    Every step is a rising line with a bend at its wanted gain and pulls all gains together, so bends whose ends have become one double
    are dropped; after about a thousand loud blocks one constant is left.
    """
    x = y = np.array([LEAST_GAIN, MOST_GAIN])
    for w in wanted.tolist():
        if y[0] < w < y[-1] and len(y) > 1:
            at = int(np.searchsorted(y, w))
            if y[at] != w:
                x, y = np.insert(x, at, np.interp(w, y, x)), np.insert(y, at, w)
        y = _toward(y, w)
        rising = np.append(True, y[1:] > y[:-1])
        if not rising.all():
            x, y = x[rising], y[rising]
    return scans.Curve(x, y)


def adaptive_gain(blocks: DataFrame, target_db: float = -16, gate_db: float = -48, limiter_db: float = -1.5,
                  user_db: float = 0, rows: int = SEGMENT_ROWS, fan: int = scans.FAN) -> DataFrame:
    """Recursive per-clip gain towards a target RMS, applied and limited.

    Blocks below the gate hold the gain. A segment is a piecewise-linear curve from the gain before it to the gain after it; curves
    compose exactly (see ``scans``), so a clip of any length splits without warm-up.
    """
    gate, target, limit, user = gain_of(gate_db), gain_of(target_db), gain_of(limiter_db), gain_of(user_db)
    out = blocks.withColumn("block_rms", block_rms())
    steps = out.select("clip_id", "block_no", "block_rms")

    def wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rms = batch.column("block_rms").to_numpy(zero_copy_only=False).astype(float)
        loud = rms > gate
        return loud, np.clip(target / np.maximum(rms, 1e-6), LEAST_GAIN, MOST_GAIN)

    def summarise(batches, prefix):
        curve = None
        for batch in batches:
            loud, goal = wanted(batch)
            one = _gain_curve(goal[loud])
            curve = one if curve is None else curve.then(one)
        return curve.packed()

    def walk(batches, prefix):
        gain = float(scans.Curve.read(prefix)(1.0)) if prefix else 1.0
        for batch in batches:
            loud, goal = wanted(batch)
            gains = np.empty(len(goal))
            for i, (on, w) in enumerate(zip(loud.tolist(), goal.tolist())):
                if on:
                    gain += (w - gain) * (FALL if gain > w else RISE)
                gains[i] = gain
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("block_no"), pa.array(gains)], ["clip_id", "block_no", "gain"])

    kinds = dict(steps.dtypes)
    gains = scans.scan(steps, CLIP, "block_no", summarise, scans.Curve.compose, walk,
                       f"clip_id {kinds['clip_id']}, block_no {kinds['block_no']}, gain double", rows, fan)
    out = out.join(gains, ["clip_id", "block_no"])
    raised = F.transform("samples", lambda x: x * F.col("gain") * user)
    return (out.withColumn("_raised", raised)
            .withColumn("clipped_samples", F.size(F.filter("_raised", lambda x: F.abs(x) > limit)))
            .withColumn("samples", F.transform("_raised", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))
            .withColumn("peak", F.array_max(F.transform("samples", lambda x: F.abs(x)))).drop("_raised"))


def split_channels(blocks: DataFrame) -> DataFrame:
    """One row per block and channel, samples de-interleaved."""
    return (blocks.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
            .withColumn("samples", F.filter("samples", lambda x, i: i % F.col("channels") == F.col("channel"))))


def join_channels(rows: DataFrame) -> DataFrame:
    """Interleaves channel rows again; a block has few channels."""
    grouped = rows.groupBy("clip_id", "block_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda c: c["samples"]).alias("_c"))
    frames = F.sequence(F.lit(0), F.size(F.col("_c")[0]) - 1)
    return grouped.select("clip_id", "block_no", F.size("_c").alias("channels"), F.flatten(
        F.transform(frames, lambda i: F.transform("_c", lambda c: F.get(c, i)))).alias("samples"))


def _runs(batch: pa.RecordBatch):
    """(rate, samples) of the batch's blocks, those of one rate together; what is not a number is silence."""
    rates = batch.column("rate").to_numpy(zero_copy_only=False).astype(float)
    bounds = [0, *(np.flatnonzero(rates[1:] != rates[:-1]) + 1).tolist(), len(rates)]
    for low, high in zip(bounds[:-1], bounds[1:]):
        x = batch.column("samples").slice(low, high - low).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield rates[low], np.where(np.isfinite(x), x, 0.0)


def _with_samples(batch: pa.RecordBatch, values: list[np.ndarray]) -> pa.RecordBatch:
    """The batch's blocks with other samples; empty blocks stay empty, missing ones missing."""
    held = batch.column("samples")
    at = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(held), 0).to_numpy()))
    samples = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0)), mask=held.is_null())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BLOCK), samples], [*_BLOCK, "samples"])


_BLOCK = ["clip_id", "block_no", "channel"]
CHANNEL = ["clip_id", "channel"]
CHANNEL_ROWS = 4096


def _channels(blocks: DataFrame) -> DataFrame:
    return split_channels(blocks.select("clip_id", "block_no", "rate", "channels", "samples")).select(*_BLOCK, "rate", "samples")


def _channel_schema(channels: DataFrame) -> str:
    return ", ".join(f"{n} {k}" for n, k in channels.dtypes if n in _BLOCK) + ", samples array<double>"


class Passes:
    """High-pass and low-pass in a row over one channel, with state (high-pass output less last sample, low-pass output)."""

    def __init__(self, highpass_hz: float, lowpass_hz: float):
        self.highpass, self.lowpass = min(1000, max(10, highpass_hz)), min(22000, max(1000, lowpass_hz))

    def factors(self, rate: float) -> tuple[float, float]:
        return 1 / (1 + 2 * math.pi * self.highpass / rate), 1 - math.exp(-2 * math.pi * min(self.lowpass, rate * 0.48) / rate)

    def step(self, rate: float, samples: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered samples and the state after them."""
        if not len(samples):
            return samples, state
        a, b = self.factors(rate)
        over = linear_recurrence(np.full(len(samples), a), (a - 1) * samples, state[0])
        low = linear_recurrence(np.full(len(samples), 1 - b), b * (over + samples), state[1])
        return low, np.array([over[-1], low[-1]])

    def matrix(self, rate: float, n: int) -> np.ndarray:
        """What ``n`` samples make of a state, but for what the samples add."""
        a, b = self.factors(rate)
        return np.linalg.matrix_power(np.array([[a, 0.0], [b * a, 1 - b]]), n)

    def summary(self, batches, prefix) -> bytes:
        turn, end = np.eye(2), np.zeros(2)
        for batch in batches:
            for rate, x in _runs(batch):
                turn = self.matrix(rate, len(x)) @ turn
                _, end = self.step(rate, x, end)
        return np.append(turn.ravel(), end).tobytes()

    @staticmethod
    def compose(first: bytes, second: bytes) -> bytes:
        f, g = np.frombuffer(first), np.frombuffer(second)
        turn = g[:4].reshape(2, 2)
        return np.append((turn @ f[:4].reshape(2, 2)).ravel(), turn @ f[4:] + g[4:]).tobytes()


def soft_gate(low: np.ndarray, rate: float, gate: float, reduction: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the gate's level per sample: towards 1 where the signal reaches the gate, else towards 1 - reduction."""
    attack, release = 1 - math.exp(-1 / (rate * 0.006)), 1 - math.exp(-1 / (rate * 0.09))
    wanted = np.where(np.abs(low) >= gate, 1.0, 1 - reduction)
    # The level stays within [1 - reduction, 1], so an open target always attacks, a closed one releases.
    k = np.where(wanted == 1.0, attack, release)
    return 1 - k, k * wanted


def filter_block(x: np.ndarray, rate: float, passes: Passes, gate: float, reduction: float, state: Sequence[float]) -> tuple[np.ndarray, list[float]]:
    """One block of one channel from a state of three numbers (see ``Passes``, and the gate's level); samples and the state after it."""
    x = np.where(np.isfinite(x), x, 0.0)
    low, end = passes.step(rate, x, np.array(state[:2]))
    levels = linear_recurrence(*soft_gate(low, rate, gate, reduction), state[2])
    return low * levels, [float(end[0]), float(end[1]), float(levels[-1]) if len(x) else state[2]]


def _level(keep: np.ndarray, add: np.ndarray, held: tuple[float, float]) -> tuple[float, float]:
    """A gate's level after more samples, as factor and offset of the level before the segment."""
    if not len(keep):
        return held
    with np.errstate(under="ignore"):
        return held[0] * float(np.prod(keep)), float(linear_recurrence(keep, add, held[1])[-1])


def audio_filter_chain(blocks: DataFrame, highpass_hz: float = 70, lowpass_hz: float = 16000, gate_db: float = -48,
                       noise_reduction: float = 0.18, rows: int = CHANNEL_ROWS, fan: int = scans.FAN) -> DataFrame:
    """One-pole high-pass, low-pass and soft gate per channel, state carried across blocks.

    The passes are linear: a segment is a matrix and an offset, and the state before any segment follows from those of the segments
    before it. With that state a segment's filtered samples are known, hence where its gate opens and closes, which makes the gate's level an
    affine map in turn. Three passes over the samples, whatever the blocks' sizes (see ``scans``).
    """
    passes = Passes(highpass_hz, lowpass_hz)
    gate, reduction = gain_of(gate_db), min(1.0, max(0.0, noise_reduction))
    channels = _channels(blocks)
    cut = channels.withColumn(SEG, segment_of("block_no", rows))
    group = CHANNEL + [SEG]

    def gate_summary(batches, prefix):
        state = np.frombuffer(prefix)[4:] if prefix else np.zeros(2)
        held = (1.0, 0.0)
        for batch in batches:
            for rate, x in _runs(batch):
                low, state = passes.step(rate, x, state)
                held = _level(*soft_gate(low, rate, gate, reduction), held)
        return scans.affine(held[0], np.array([held[1]]))

    def walk(batches, prefix):
        state, level = np.zeros(2), 1.0
        if prefix:
            known = np.frombuffer(prefix)
            state, level = known[4:6], known[6] + known[7]
        for batch in batches:
            done = []
            for rate, x in _runs(batch):
                low, state = passes.step(rate, x, state)
                if len(x):
                    levels = linear_recurrence(*soft_gate(low, rate, gate, reduction), level)
                    level = levels[-1]
                    done.append(low * levels)
            yield _with_samples(batch, done)

    before = stored(scans.prefixes(scans.summaries(cut, group, ["block_no"], passes.summary), CHANNEL, passes.compose, fan))
    gates = scans.prefixes(scans.summaries(cut, group, ["block_no"], gate_summary, before), CHANNEL, scans.compose_affine, fan)
    starts = (before.join(gates.withColumnRenamed(scans.PREFIX, "_gate"), group)
              .select(*group, F.concat(scans.PREFIX, "_gate").alias(scans.PREFIX)))
    return scans.fold_segments(cut, starts, group, ["block_no"], walk, _channel_schema(channels))


def noise_gate(blocks: DataFrame, threshold_db: float, attack_ms: float = 5, release_ms: float = 80,
               rows: int = CHANNEL_ROWS, fan: int = scans.FAN) -> DataFrame:
    """Hard gate with an attack/release envelope per channel; a segment is an affine map of the envelope's level."""
    threshold = gain_of(threshold_db)
    channels = _channels(blocks)

    def opened(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        attack = max(1, math.floor(rate * attack_ms / 1000 + 0.5))
        release = max(1, math.floor(rate * release_ms / 1000 + 0.5))
        target = (np.abs(x) >= threshold).astype(float)
        k = np.where(target > 0, 1 / attack, 1 / release)
        return 1 - k, k * target

    def summarise(batches, prefix):
        held = (1.0, 0.0)
        for batch in batches:
            for rate, x in _runs(batch):
                held = _level(*opened(x, rate), held)
        return scans.affine(held[0], np.array([held[1]]))

    def walk(batches, prefix):
        level = float(np.frombuffer(prefix).sum()) if prefix else 1.0
        for batch in batches:
            done = []
            for rate, x in _runs(batch):
                if len(x):
                    levels = linear_recurrence(*opened(x, rate), level)
                    level = levels[-1]
                    done.append(x * levels)
            yield _with_samples(batch, done)

    return scans.scan(channels, CHANNEL, "block_no", summarise, scans.compose_affine, walk, _channel_schema(channels), rows, fan)
