"""Prefix scans against plain sequential models, at any segment size and fan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import audio, planes, scans, stacks, storage

BLOCKS = "clip_id bigint, block_no bigint, rate int, channels int, samples array<double>"
SIZES = [dict(rows=1, fan=2), dict(rows=3, fan=2), dict(rows=7, fan=3), dict(rows=10 ** 6)]


def blocks_of(spark, seed=3):
    rng = random.Random(seed)
    data = [(c, i * (1 + c), 1000, c + 1, [rng.uniform(-1, 1) * (1 if i % 40 < 6 else 1e-3) for _ in range((1 if i % 9 == 0 else 16) * (c + 1))]
             if i % 25 else []) for c in range(2) for i in range(90)]
    data.append((1, 1000, 1000, 2, [0.5, float("nan")]))  # a last block of one frame
    return data, spark.createDataFrame(data, BLOCKS).repartition(5)


def channel_samples(data, clip, channel):
    for _, no, rate, n, samples in sorted(d for d in data if d[0] == clip):
        yield no, rate, samples[channel::n]


@pytest.mark.parametrize("size", SIZES)
def test_filter_chain(spark, size):
    data, df = blocks_of(spark)
    got = {(r.clip_id, r.channel, r.block_no): r.samples for r in audio.audio_filter_chain(df, gate_db=-30, **size).collect()}
    assert len(got) == 90 + 2 * 91
    for clip, channel in ((0, 0), (1, 0), (1, 1)):
        last, high, low, level = 0.0, 0.0, 0.0, 1.0
        for no, rate, samples in channel_samples(data, clip, channel):
            want = []
            a, k = 1 / (1 + 2 * math.pi * 70 / rate), 1 - math.exp(-2 * math.pi * .48)
            for x in samples:
                x = x if math.isfinite(x) else 0.0
                high, last = a * (high + x - last), x
                low += k * (high - low)
                target = 1 if abs(low) >= 10 ** (-30 / 20) else 1 - .18
                level += (target - level) * (1 - math.exp(-1 / (rate * (.006 if target > level else .09))))
                want.append(low * level)
            assert got[clip, channel, no] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_noise_gate(spark, size):
    data, df = blocks_of(spark, 4)
    got = {(r.clip_id, r.channel, r.block_no): r.samples for r in audio.noise_gate(df, -20, attack_ms=4, release_ms=9, **size).collect()}
    for clip, channel in ((0, 0), (1, 0), (1, 1)):
        level = 1.0
        for no, _, samples in channel_samples(data, clip, channel):
            want = []
            for x in samples:
                x = x if math.isfinite(x) else 0.0
                target = 1.0 if abs(x) >= .1 else 0.0
                level += (target - level) / (4 if target else 9)
                want.append(x * level)
            assert got[clip, channel, no] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_adaptive_gain(spark, size):
    rng = random.Random(9)
    data = [(c, i, 8, 1, [rng.choice([1e-4, .02, .1, .3, .9])] * 4) for c in range(3) for i in range(60)]
    got = {(r.clip_id, r.block_no): r.gain for r in audio.adaptive_gain(spark.createDataFrame(data, BLOCKS), gate_db=-40, **size).collect()}
    for clip in range(3):
        gain = 1.0
        for _, no, _, _, samples in (d for d in data if d[0] == clip):
            if samples[0] > 10 ** (-40 / 20):
                wanted = min(4, max(.35, 10 ** (-16 / 20) / samples[0]))
                gain += (wanted - gain) * (.28 if wanted < gain else .035)
            assert got[clip, no] == pytest.approx(gain, rel=1e-12)


def test_gain_curves_end_as_a_constant():
    rng = np.random.default_rng(2)
    curve = audio._gain_curve(rng.uniform(.35, 4, 5000))
    assert len(curve.x) < 50
    parts = [audio._gain_curve(w) for w in np.split(rng.uniform(.35, 4, 300), 30)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.then(part)
    for start in (.35, .9, 1.0, 4.0):
        step = start
        for part in parts:
            step = float(part(step))
        assert float(whole(start)) == pytest.approx(step, rel=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_blended_planes(spark, size):
    rng = random.Random(5)
    data = []
    for clip in range(2):
        plane = [120] * 12
        for i in range(50):
            plane = [min(255, max(0, v + rng.choice([-2, 0, 1, 3]))) for v in plane]
            shown = None if i == 17 else plane[:9] if 30 <= i < 34 else [rng.randrange(256) for _ in plane] if i == 40 else plane
            data.append((clip, 2 * i, shown))
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, luma array<int>").repartition(4)
    options = dict(denoise=.8, anti_flicker=.9, stability=1.0)
    got = {(r.clip_id, r.frame_no): r for r in planes.temporal_blend_planes(df, **options, **size).collect()}
    plan = {(r.clip_id, r.frame_no): r for r in planes.temporal_blend_plan(df, **options).collect()}
    blended = 0
    for clip in range(2):
        last = None
        for _, no, x in (d for d in data if d[0] == clip):
            r = plan[clip, no]
            if x is None:
                assert got[clip, no].blended is None
                continue
            alpha = min(.08, abs(r.exposure_correction - 1))
            if alpha > .002:
                x = [v * (1 - alpha) + (255 * alpha if r.exposure_correction > 1 else 0) for v in x]
            if r.blend > .001:
                blended += 1
                x = [(1 - r.blend) * v + r.blend * w for v, w in zip(x, last, strict=True)]
            last = x
            assert got[clip, no].blended == pytest.approx(x, rel=1e-12)
    assert blended > 50


def test_idle_blend_leaves_planes_alone(spark):
    df = spark.createDataFrame([(1, i, [i, 2 * i]) for i in range(5)], "clip_id bigint, frame_no bigint, luma array<int>")
    assert {r.frame_no: r.blended for r in planes.temporal_blend_planes(df).collect()} == {i: [i, 2 * i] for i in range(5)}


# ---- stacks -------------------------------------------------------------------------------

def play(stack, events):
    stack = list(stack)
    for action, stage in events:
        if action in ("apply", "adopt"):
            stack.append(stage)
        elif action == "undo":
            stack = stack[:-1]
        elif action == "clear":
            stack = []
        elif action == "rewind" and stage in stack:
            del stack[stack.index(stage):]
    return stack


def some_events(rng, n, stages, clears=.02):
    return [(rng.choices(["apply", "adopt", "undo", "rewind", "clear", "look"], [5, 1, 3, 3, 12 * clears, .3])[0], rng.choice(stages)) for _ in range(n)]


@pytest.mark.parametrize("ways", [0, 5, 1 << 14])
@pytest.mark.parametrize("stages", [["a"], ["a", "b", None], list("abcdefgh")])
def test_effects_compose(stages, ways, monkeypatch):
    monkeypatch.setattr(stacks, "WAYS", ways)
    rng = random.Random(len(stages))
    for _ in range(120):
        runs = [some_events(rng, rng.randrange(0, 12), stages) for _ in range(rng.randrange(1, 6))]
        below = [rng.choice(stages) for _ in range(rng.randrange(0, 7))]
        whole = stacks.effect(runs[0])
        for run in runs[1:]:
            whole = stacks.read(stacks.compose(stacks.packed(whole), stacks.packed(stacks.effect(run))))
        events = [e for run in runs for e in run]
        want = play(below, events)
        kept, height, first = stacks.land(whole, len(below), {s: below.index(s) for s in set(below)})
        assert height == len(want) and first == {s: want.index(s) for s in set(want)}
        low = len(below)
        for k in range(len(events) + 1):
            low = min(low, len(play([(i, s) for i, s in enumerate(below)], [])), _common(below, events[:k]))
        assert kept == low


def _common(below, events):
    """How many entries of the stack below have never been taken off, by marking them."""
    stack = [(s, True) for s in below]
    for action, stage in events:
        names = [s for s, _ in stack]
        if action in ("apply", "adopt"):
            stack.append((stage, False))
        elif action == "undo":
            stack = stack[:-1]
        elif action == "clear":
            stack = []
        elif action == "rewind" and stage in names:
            stack = stack[:names.index(stage)]
    return sum(mark for _, mark in stack)


def test_effects_stay_small():
    rng = random.Random(1)
    whole = stacks.effect(some_events(rng, 400, list("abc"), clears=0))
    for _ in range(40):
        whole = stacks.then(whole, stacks.effect(some_events(rng, 400, list("abc"), clears=0)))
    assert len(whole) < 40
    pushes = stacks.effect([("apply", "a")] * 100_000)
    assert len(stacks.packed(pushes)) < 200 and pushes[0].size == 100_000


@pytest.mark.parametrize("size", SIZES)
def test_lineage(spark, size):
    rng = random.Random(6)
    stages = ["restore", "detail", "color", "blur", None]
    data = [(s, 3 * i, *e) for s in range(5) for i, e in enumerate(some_events(rng, 3 + 30 * s, stages))]
    df = spark.createDataFrame(data, "session_id bigint, seq bigint, action string, stage_id string").repartition(4)
    got = {r.session_id: (r.stack, r.depth, r.last_seq) for r in storage.lineage_stack(df, **size).collect()}
    for s in range(5):
        events = [d[2:] for d in data if d[0] == s]
        want = play([], events)
        assert got[s] == (want, len(want), 3 * (len(events) - 1))


def test_one_long_session_comes_from_many_tasks(spark):
    """200 000 pushes: entries arrive in as many partitions as there are (unless small ones are put together)."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    events = spark.range(200_000).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("seq"), F.lit("apply").alias("action"),
                                         (F.col("id") % 5).cast("string").alias("stage_id"))
    out = storage.lineage_entries(events, rows=2000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) < 200_000
    last = out.where("level = 199999").first()
    assert last.stage_id == "4"


def test_affine_maps_forget_other_sizes():
    assert scans.compose_affine(scans.affine(.5, np.ones(3)), scans.affine(0.0, np.ones(2))) == scans.affine(0.0, np.ones(2))
