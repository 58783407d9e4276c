"""A stream over several files gives what the batch operator gives over all rows."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import audio, planes, retime, timeline
from framelake.plans import bindings as b
from framelake.streaming import folds
from framelake.streaming import streams as sm

STEP = b.NOMINAL_STEP_US


def as_stream(spark, df, path, order, files=4):
    """Writes rows as several files in time order and reads them one per trigger."""
    import os
    import time
    ranked = [tuple(r) for r in df.orderBy(*order).collect()]
    size = -(-len(ranked) // files)
    schema = df.schema
    for i in range(files):
        part = spark.createDataFrame(ranked[i * size:(i + 1) * size], schema).coalesce(1)
        part.write.parquet(str(path / f"part{i}"))
    for i in range(files):  # the file source takes older files first
        for name in os.listdir(path / f"part{i}"):
            os.utime(path / f"part{i}" / name, (time.time() - 1000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def frames(spark, small):
    return b.telemetry(spark, small).select("clip_id", "frame_no", "event_id", "pts_us", "dur_us", "status").cache()


@pytest.fixture(scope="module")
def plane_rows(spark, small):
    return b.planes(spark, small).select("clip_id", "frame_no", "vec_id", "luma").cache()


def test_pacing(spark, frames, tmp_path):
    got = sm.latest(sm.run_available(sm.stream_pacing(as_stream(spark, frames, tmp_path, ["pts_us"]), STEP), "t", "update"))
    columns = ("clip_id", "frames", "non_monotonic", "irregular", "missing", "min_delta_us", "max_delta_us")
    assert rows_of(got, *columns) == rows_of(timeline.pacing_report(frames, STEP), *columns)


def test_integrity(spark, frames, tmp_path):
    got = sm.latest(sm.run_available(sm.stream_integrity(as_stream(spark, frames, tmp_path, ["pts_us"]), STEP), "t", "update"))
    columns = ("clip_id", "decoded", "source_gaps", "source_gap_us", "source_non_monotonic")
    assert rows_of(got, *columns) == rows_of(timeline.source_gap_report(frames), *columns)
    columns = ("clip_id", "output_non_monotonic", "output_missing")
    assert rows_of(got, *columns) == rows_of(timeline.output_gap_report(frames, STEP), *columns)


def test_hysteresis(spark, frames, tmp_path):
    got = sm.run_available(sm.stream_hysteresis(as_stream(spark, frames, tmp_path, ["pts_us"])), "t")
    columns = ("clip_id", "frame_no", "pts_us", "action")
    assert rows_of(got, *columns) == rows_of(timeline.hysteresis_transitions(frames), *columns)


def test_scenes_and_duplicates(spark, plane_rows, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got = sm.run_available(sm.stream_scenes(as_stream(spark, plane_rows, tmp_path / "a", ["vec_id"]), .12), "t")
    assert rows_of(got, "clip_id", "frame_no", "cut", "scene_id") == rows_of(planes.scene_segments(plane_rows, .12), "clip_id", "frame_no", "cut", "scene_id")
    got = sm.run_available(sm.stream_duplicates(as_stream(spark, plane_rows, tmp_path / "b", ["vec_id"]), 3, .115, .13), "t")
    assert rows_of(got, "clip_id", "frame_no", "duplicate") == rows_of(planes.duplicate_flags(plane_rows, 3, .115, .13), "clip_id", "frame_no", "duplicate")


def test_audio(spark, small, tmp_path):
    blocks = b.audio_blocks(spark, small).select("clip_id", "block_no", "ts_us", "rate", "channels", "samples").cache()
    got = sm.run_available(sm.stream_audio(as_stream(spark, blocks, tmp_path, ["block_no"]), gate_db=-20, limiter_db=-10), "t")
    filtered = audio.join_channels(audio.audio_filter_chain(blocks, gate_db=-20)).withColumn("rate", F.lit(64))
    want = audio.adaptive_gain(filtered, gate_db=-20, limiter_db=-10)
    pick = lambda df: rows_of(df, "clip_id", "block_no", F.round("gain", 9), F.round(F.element_at("samples", 64), 9))
    assert pick(got) == pick(want)


def test_resample_with_flush_and_late_rows(spark, tmp_path):
    timed = lambda rows: spark.createDataFrame([(c, i, p, 40000) for c, i, p in rows], "clip_id bigint, frame_no bigint, pts_us bigint, dur_us bigint")
    clips = [(c, i, i * 40000 + c * 1000) for c in (1, 2) for i in range(20)]
    late = [(1, 99, 5000)]                      # behind the watermark when it arrives
    tail = [(3, 0, 60_000_000), (3, 1, 120_000_000)]  # moves the watermark past both clips
    batches = [clips[:30] + clips[35:], clips[30:35][::-1], tail[:1], late, tail[1:]]
    import os
    import time
    for i, rows in enumerate(batches):
        timed(rows).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        for name in os.listdir(tmp_path / f"p{i}"):
            os.utime(tmp_path / f"p{i}" / name, (time.time() - 1000 + 10 * i,) * 2)
    stream = (spark.readStream.schema(timed([]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
              .withColumn("event_time", F.timestamp_micros("pts_us")))
    out = sm.run_available(sm.stream_resample(stream, 16_000, delay="2 seconds", flush_ms=1000, range_ms=100), "t").cache()
    got = sm.on_time(out)
    assert [tuple(r) for r in sm.late_rows(out, "pts_us bigint, dur_us bigint").collect()] == [(1, 5000, 40000)]
    columns = ("clip_id", "tick_no", "pts_us", "source_no")
    want = retime.resample_cfr(timed(clips), step_us=16_000)
    assert rows_of(got.where("clip_id < 3"), *columns) == rows_of(want, *columns)


def test_late_rows_are_counted():
    """Late rows come out as they are; the count travels with the next rows a key emits. Ranges behind the watermark are gone."""
    import json
    from framelake.streaming.processors import ReorderProcessor
    import pandas as pd

    class Cell:
        def __init__(self): self.value = None
        def exists(self): return self.value is not None
        def get(self): return self.value
        def update(self, value): self.value = value

    class Cells(dict):
        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        timers = []
        def getValueState(self, *a): return Cell()
        def getMapState(self, *a): return Cells()
        def registerTimer(self, at): self.timers.append(at)

    class At:
        def __init__(self, watermark): self.watermark = watermark
        def getCurrentWatermarkInMs(self): return self.watermark

    p = ReorderProcessor(folds.resample_fold(10_000), ["clip_id"], ["pts_us"], "event_ms", ["pts_us", "dur_us", "event_ms"],
                         folds.RESAMPLE_COLUMNS, range_ms=1)
    p.init(Handle())
    rows = lambda *ms: [pd.DataFrame({"clip_id": 1, "pts_us": [m * 1000 for m in ms], "dur_us": 1, "event_ms": list(ms)})]
    assert list(p.handleInputRows((1,), rows(30, 10, 20), At(0))) == []
    assert min(Handle.timers) == 10
    out = pd.concat(p.handleExpiredTimer((1,), At(25), None))
    assert out["pts_us"].tolist() == [10_000] and out["late"].tolist() == [0]
    assert list(p.waiting) == [(30,)]
    late = pd.concat(p.handleInputRows((1,), rows(5, 24), At(25)))
    assert [json.loads(t)["pts_us"] for t in late["late_row"]] == [5000, 24_000] and late["pts_us"].isna().all()
    out = pd.concat(p.handleExpiredTimer((1,), At(40), None))
    assert out["pts_us"].tolist() == [20_000] and out["late"].tolist() == [2]


def test_seeded_counters(spark, frames, tmp_path):
    half = frames.where("frame_no >= 3")
    before = timeline.pacing_report(frames.where("frame_no < 3"), STEP).select("clip_id", "frames")
    last = frames.where("frame_no = 2").select("clip_id", F.col("pts_us").alias("last_us"))
    seeds = sm.seed_state(before.join(last, "clip_id"), "pacing")
    got = sm.latest(sm.run_available(sm.stream_pacing(as_stream(spark, half, tmp_path, ["pts_us"], 2), STEP, initial=seeds), "t", "update"))
    want = timeline.pacing_report(frames, STEP).where("frames > 3")
    assert rows_of(got, "clip_id", "frames") == rows_of(want, "clip_id", "frames")


def test_telemetry_windows_slide(spark, tmp_path):
    df = spark.createDataFrame([(1, 30, .5), (1, 70, .7)], "device_id bigint, s int, heap_ratio double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    out = sm.run_available(sm.stream_telemetry(stream, window="1 minute", slide="30 seconds"), "t", "update")
    assert sorted((r.start.minute * 60 + r.start.second, r.samples) for r in sm.latest(out, ("device_id", "start")).collect()) == [(0, 1), (30, 2), (60, 1)]


@pytest.mark.parametrize("range_ms", [1, 1000, 10 ** 9])
def test_declared_end_gives_the_batch_result(spark, tmp_path, range_ms):
    """Shuffled files, rows out of order inside the delay: nothing waits for a later row once the end is declared."""
    import random
    rng = random.Random(range_ms)
    rows = [(c, i, i * 40_000 + rng.randrange(9000) + c * 777, 40_000) for c in range(3) for i in range(60)]
    rows.sort(key=lambda r: (r[2] // 500_000, rng.random()))
    frames = spark.createDataFrame(rows, "clip_id bigint, frame_no bigint, pts_us bigint, dur_us bigint").coalesce(1)
    stream = as_stream(spark, frames, tmp_path, ["clip_id"]).withColumn("event_time", F.timestamp_micros("pts_us"))
    ended, close = sm.ending(stream)
    out = sm.run_available(sm.stream_resample(ended, 16_000, delay="1 minute", flush_ms=0, range_ms=range_ms), "t", close=close)
    columns = ("clip_id", "tick_no", "pts_us", "source_no")
    assert sm.late_rows(out, "pts_us bigint").count() == 0
    assert rows_of(sm.on_time(out), *columns) == rows_of(retime.resample_cfr(frames, step_us=16_000), *columns)


def test_state_of_a_stopped_query_seeds_the_next(spark, tmp_path):
    frames = spark.createDataFrame([(c, i, i * 40_000 + (90_000 if i > 30 else 0)) for c in range(4) for i in range(50)], "clip_id bigint, frame_no bigint, pts_us bigint")
    for half in "ab":
        (tmp_path / half).mkdir()
    first = as_stream(spark, frames.where("frame_no < 20 and clip_id < 3"), tmp_path / "a", ["frame_no"])
    rest = as_stream(spark, frames.where("frame_no >= 20 or clip_id = 3"), tmp_path / "b", ["frame_no"])
    progress = str(tmp_path / "progress")
    sm.run_available(sm.stream_pacing(first, 40_000), "t", "update", progress=progress)
    saved = sm.saved_state(spark, progress)
    assert saved.count() == 3
    got = sm.latest(sm.run_available(sm.stream_pacing(rest, 40_000, initial=saved), "t", "update"))
    want = timeline.pacing_report(frames, 40_000)
    columns = ("clip_id", "frames", "missing", "irregular")
    assert rows_of(got, *columns) == rows_of(want, *columns)


@pytest.mark.parametrize("buckets", [1, 3])
def test_clips_of_a_bucket_share_calls(spark, tmp_path, monkeypatch, buckets):
    """State is kept for a bucket, not for each clip; clips in it keep their own order, counters and closing."""
    monkeypatch.setattr(sm, "BUCKETS", buckets)
    clips = spark.createDataFrame([(c if c else None, i, 5_000_000 + i * 40_000 + c * 777 + (90_000 if i > 15 + c else 0), 40_000) for c in range(12) for i in range(20)],
                                  "clip_id bigint, frame_no bigint, pts_us bigint, dur_us bigint")
    for name in "abc":
        (tmp_path / name).mkdir()
    stream = as_stream(spark, clips.where("frame_no < 10"), tmp_path / "a", ["frame_no"], 2)
    progress = str(tmp_path / "progress")
    sm.run_available(sm.stream_pacing(stream, 40_000), "t", "update", progress=progress)
    entries = spark.read.format("statestore").option("path", progress).option("operatorId", 0).option("stateVarName", "fold").load().count()
    assert 2 <= entries <= buckets + 1  # not one for each of 12 clips
    rest = as_stream(spark, clips.where("frame_no >= 10"), tmp_path / "b", ["frame_no"], 2)
    got = sm.latest(sm.run_available(sm.stream_pacing(rest, 40_000, initial=sm.saved_state(spark, progress)), "t", "update"))
    columns = ("frames", "missing", "irregular", "min_delta_us")
    assert rows_of(got.where("clip_id > 0"), "clip_id", *columns) == rows_of(timeline.pacing_report(clips, 40_000).where("clip_id > 0"), "clip_id", *columns)
    assert rows_of(got.where("clip_id is null"), "frames") == [(20,)]
    ended, close = sm.ending(as_stream(spark, clips, tmp_path / "c", ["frame_no"], 3).withColumn("event_time", F.timestamp_micros("pts_us")))
    out = sm.on_time(sm.run_available(sm.stream_resample(ended, 16_000, delay="1 minute", flush_ms=0, range_ms=300), "t", close=close))
    columns = ("clip_id", "tick_no", "pts_us", "source_no")
    want = retime.resample_cfr(clips, step_us=16_000)
    assert rows_of(out.where("clip_id > 0"), *columns) == rows_of(want.where("clip_id > 0"), *columns)
