"""Cutting a clip into small segments must not change any result."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import audio, motion, ordered, planes, retime, storage, timeline
from framelake.operators.chained import chained_fold
from framelake.plans import bindings as b


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, c):
    assert len(a) == len(c)
    for x, y in zip(a, c):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9) if not any(isinstance(v, (str, list)) or v is None for v in x) else repr(x) == repr(y)


@pytest.fixture(scope="module")
def frames(spark):
    """One clip with most of the rows, jitter, repeats and steps back, next to short ones."""
    rng = random.Random(5)
    out = []
    for clip, n in ((1, 500), (2, 3), (3, 1), (4, 40)):
        at = 0
        for i in range(n):
            at += rng.choice([1000, 1000, 1000, 1040, 2000, 5000, 0, -300])
            out.append((clip, i, max(0, at), rng.choice([1000, 900, 1]), rng.random() * 500, rng.randint(0, 5), rng.random()))
    return spark.createDataFrame(out, "clip_id bigint, frame_no bigint, pts_us bigint, dur_us bigint, value double, status int, heap_ratio double").cache()


OPERATORS = {
    "pacing": lambda f, n: timeline.pacing_report(f, 1000, rows=n),
    "gaps": lambda f, n: timeline.source_gap_report(f, rows=n),
    "output_gaps": lambda f, n: timeline.output_gap_report(f, 1000, rows=n),
    "fps": lambda f, n: timeline.estimate_fps(f, rows=n),
    "rolling": lambda f, n: timeline.rolling_rate(f, F.col("pts_us") / 1000.0, window=7, max_delta_ms=3, rows=n).select("clip_id", "frame_no", F.round("fps", 6)),
    "progress": lambda f, n: timeline.progress_eta(f, F.col("value") / 500, rows=n).select("clip_id", "frame_no", "progress", "elapsed_s"),
    "transitions": lambda f, n: timeline.hysteresis_transitions(f, rows=n),
    "intervals": lambda f, n: timeline.hysteresis_intervals(f, rows=n),
    "hold": lambda f, n: timeline.sample_and_hold(f, F.col("value"), 9, rows=n).select("clip_id", "frame_no", "held"),
    "resample": lambda f, n: retime.resample_cfr(timeline.ordered_timeline(f, 5000).drop("frame_no").withColumnRenamed("order_no", "frame_no"), step_us=730, rows=n),
    "plan": lambda f, n: retime.interpolation_plan(f, 4, rows=n),
    "shutter": lambda f, n: retime.shutter_window(
        timeline.ordered_timeline(f, 5000).drop("frame_no").withColumnRenamed("order_no", "frame_no"), 1000, 2500, 1.2,
        scene="scene", rows=n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_segment_size_does_not_matter(frames, name):
    source = frames.withColumn("scene", F.floor(F.col("pts_us") / 100_000)) if name == "shutter" else frames
    assert rows_of(OPERATORS[name](source, 7)) == rows_of(OPERATORS[name](source, 100_000))


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("resample", "shutter")])
def test_lost_frames_do_not_matter_either(frames, name):
    """Numbers with holes, some wider than a segment: border rows are found all the same."""
    holes = frames.where("frame_no % 16 <> 15 and (frame_no < 100 or frame_no > 140)").withColumn("frame_no", F.expr(
        "frame_no * 3 + if(frame_no > 300, 1000, 0)"))
    assert rows_of(OPERATORS[name](holes, 16)) == rows_of(OPERATORS[name](holes, 1_000_000))


def lost(frames):
    """Frames in time order, numbered with holes."""
    placed = timeline.ordered_timeline(frames, 5000).drop("frame_no").withColumnRenamed("order_no", "frame_no")
    return placed.where("frame_no % 16 <> 15 and (frame_no < 100 or frame_no > 140)")


@pytest.mark.parametrize("name", ["resample", "shutter"])
def test_lost_frames_do_not_matter_to_ticks(frames, name):
    run = {"resample": lambda f, n: retime.resample_cfr(f, step_us=730, rows=n),
           "shutter": lambda f, n: retime.shutter_window(f, 1000, 2500, 1.2, scene="scene", rows=n)}[name]
    holes = lost(frames.withColumn("scene", F.floor(F.col("pts_us") / 100_000)))
    assert rows_of(run(holes, 16)) == rows_of(run(holes, 1_000_000))


@pytest.mark.parametrize("interpolate", [False, True])
def test_resampling_shows_only_frames_that_exist(frames, interpolate):
    """The same ticks as with dense numbers, each from the frame at that place, and all of them get a plane."""
    holes = lost(frames).cache()
    dense = holes.withColumn("place", F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_no")))
    got = retime.resample_cfr(holes, step_us=730, interpolate=interpolate, rows=16)
    want = retime.resample_cfr(dense.drop("frame_no").withColumnRenamed("place", "frame_no"), step_us=730, interpolate=interpolate)
    want = (want.withColumnRenamed("source_no", "place").join(dense.select("clip_id", "place", F.col("frame_no").alias("source_no")), ["clip_id", "place"])
            .select(*got.columns))
    assert rows_of(got) == rows_of(want)
    planed = holes.select("clip_id", "frame_no", F.array(F.lit(1), F.lit(2)).alias("luma"))
    assert planes.interpolate_vectors(planed, got, guard=False).count() == got.count()


@pytest.mark.parametrize("back,ahead", [(1, 0), (0, 1), (3, 2), (20, 5)])
def test_halo_holds_the_rows_looked_at(spark, back, ahead):
    rng = random.Random(back + ahead)
    data = [(c, n) for c in (1, 2) for n in sorted(rng.sample(range(400), 60))]
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint")
    got = {}
    for r in ordered.with_halo(df, ["clip_id"], back=back, ahead=ahead, rows=10).collect():
        got.setdefault((r.clip_id, r["_seg"]), set()).add(r.frame_no)
    for c in (1, 2):
        numbers = [n for k, n in data if k == c]
        for segment in {n // 10 for n in numbers}:
            mine = [i for i, n in enumerate(numbers) if n // 10 == segment]
            assert got[c, segment] == set(numbers[max(0, mine[0] - back):mine[-1] + 1 + ahead])


def test_number_rows_counts_over_buckets(frames):
    out = ordered.number_rows(frames.drop("frame_no"), ["clip_id"], ["value"], F.floor(F.col("value") / 10).cast("bigint"), "n").collect()
    for clip in {r.clip_id for r in out}:
        mine = sorted((r for r in out if r.clip_id == clip), key=lambda r: r.value)
        assert [r.n for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("small", [0, 12, 4096])
def test_upper_median_is_the_upper_one(spark, small):
    rng = random.Random(1)
    data = [(k, rng.choice([None, float("nan"), 0.0, -3.5, rng.random(), 2.0 ** rng.randint(-8, 8)])) for k in range(6) for _ in range(3 + 7 * k)]
    got = {r.clip_id: r.x for r in ordered.upper_median(spark.createDataFrame(data, "clip_id bigint, x double"), ["clip_id"], ["x"],
                                                            small).collect()}
    for k in range(6):
        values = sorted(0.0 if v is None or v != v else v for c, v in data if c == k)
        assert got[k] == values[len(values) // 2]


@pytest.mark.parametrize("spoiled", [False, True])
def test_upper_median_of_a_large_key(spark, spoiled, monkeypatch):
    """A million distinct values in a millionth, ties, and a second column; also where the sketch's bracket holds nothing."""
    import numpy as np
    if spoiled:
        monkeypatch.setattr(ordered, "BRACKET", -0.1)
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.pmod(F.col("id") * 7_919_999, F.lit(1_000_003)) * 1e-12).alias("narrow"),
                               F.floor(F.sqrt("id")).cast("double").alias("tied"), F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(-F.col("id")).alias("mixed"))
    got = ordered.upper_median(df, ["k"], ["narrow", "tied", "mixed"]).first()
    ids = np.arange(n)
    mixed = np.where(ids % 3 == 0, 0.0, -ids)
    assert got.narrow == np.sort(ids * 7_919_999 % 1_000_003 * 1e-12)[n // 2]
    assert got.tied == np.sort(np.floor(np.sqrt(ids)))[n // 2] and got.mixed == np.sort(mixed)[n // 2]


def test_explode_range_covers_long_ranges(spark):
    df = spark.createDataFrame([(1, 5, 10_004), (2, 3, 2)], "k bigint, lo bigint, hi bigint")
    out = ordered.explode_range(df, F.col("lo"), F.col("hi"), "i", chunk=100)
    assert sorted(r.i for r in out.collect()) == list(range(5, 10_005))


@pytest.fixture(scope="module")
def plane_rows(spark, small):
    return b.planes(spark, small).cache()


PLANE_OPERATORS = {
    "difference": lambda p, n: planes.frame_difference(p, rows=n).select("clip_id", "frame_no", "difference"),
    "scenes": lambda p, n: planes.scene_segments(p, 0.12, rows=n).select("clip_id", "frame_no", "score", "scene_id"),
    "duplicates": lambda p, n: planes.duplicate_flags(p, 3, 0.115, 0.13, rows=n).select("clip_id", "frame_no", "duplicate"),
    "blend_plan": lambda p, n: planes.temporal_blend_plan(p, .7, .8, .9, .13, rows=n).drop("luma"),
    "shift": lambda p, n: motion.global_shift(p, 1, rows=n),
    "field": lambda p, n: motion.motion_field(p, 1, 1, rows=n).drop("luma", "vectors"),
    "history": lambda p, n: motion.history_blend(motion.motion_field(p, 1, 1, vectors=False), 1.0, rows=n),
}


@pytest.mark.parametrize("name", PLANE_OPERATORS)
def test_plane_segments(plane_rows, name):
    close(rows_of(PLANE_OPERATORS[name](plane_rows, 11)), rows_of(PLANE_OPERATORS[name](plane_rows, 100_000)))


def test_audio_segments(spark, small):
    blocks = b.audio_blocks(spark, small).cache()
    for run in (lambda n: audio.adaptive_gain(blocks, gate_db=-18.6, rows=n).select("clip_id", "block_no", F.round("gain", 9)),
                lambda n: audio.peak_normalize(blocks, rows=n).select("clip_id", "block_no", "gain"),
                lambda n: audio.audio_filter_chain(blocks, gate_db=-20, rows=n).select(
                    "clip_id", "block_no", F.round(F.col("samples")[63], 9))):
        assert rows_of(run(9)) == rows_of(run(100_000))


def test_chained_fold_needs_every_predecessor(spark):
    """A state that never forgets: running totals over many segments."""
    import pandas as pd
    data = [(k, i, (i * 7 + k) % 5) for k in range(3) for i in range(40 * k + 3)]
    df = spark.createDataFrame(data, "k bigint, i bigint, v bigint")

    def fold(pdf, start):
        total, out = int(start or 0), []
        for k, i, v in zip(pdf["k"], pdf["i"], pdf["v"]):
            total += int(v)
            out.append((k, i, total))
        return pd.DataFrame(out, columns=["k", "i", "total"]), str(total)

    got = {(r.k, r.i): r.total for r in chained_fold(df, ["k"], "i", ["i"], fold, "k bigint, i bigint, total bigint", rows=13).collect()}
    for k in range(3):
        total = 0
        for kk, i, v in data:
            if kk == k:
                total += v
                assert got[k, i] == total


def test_retention_segments(spark, small):
    cache = b.sessions(spark, small).select(F.col("session_id").cast("string").alias("name"), (F.col("owner") % 3).alias("owner"), "bytes",
                                            "last_access_us", "pinned")
    plan = lambda n: storage.retention_plan(cache, 2_000_000_000, rows=n).select("name", "evict", "before_bytes")
    got = rows_of(plan(17))
    assert got == rows_of(plan(100_000))
    owners = {}
    for r in cache.collect():
        owners.setdefault(r.owner, []).append(r)
    gone = set()
    for items in owners.values():
        total = sum(r.bytes for r in items)
        for r in sorted((r for r in items if not r.pinned), key=lambda r: (r.last_access_us, r.name)):
            if total <= 2_000_000_000:
                break
            total -= r.bytes
            gone.add(r.name)
    assert gone and {name for name, evict, _ in got if evict} == gone
