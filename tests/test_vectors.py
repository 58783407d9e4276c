"""Hand-made cases that fix thresholds and edge rules."""

import math

import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry, mathx, text
from framelake.operators import audio, boxes, colour_ops, motion, planes, retime, rules, storage, tiles, timeline
from framelake.sources import media_files
from framelake.sources.catalog import read_clips, read_timeline


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def frames_of(spark, pts, dur=1):
    return spark.createDataFrame([(1, i, p, dur) for i, p in enumerate(pts)], "clip_id bigint, frame_no bigint, pts_us bigint, dur_us bigint")


# ---- timelines ----------------------------------------------------------------------------

@pytest.mark.parametrize("count,factor,labels", [
    (5, 2, "s0 g0@0.5 s1 g1@0.5 s2 g2@0.5 s3 g3@0.5 s4"),
    (3, 4, "s0 g0@0.25 g0@0.5 g0@0.75 s1 g1@0.25 g1@0.5 g1@0.75 s2"), (1, 4, "s0"), (0, 2, "")])
def test_interpolation_plan(spark, count, factor, labels):
    out = retime.interpolation_plan(frames_of(spark, range(count)), factor).orderBy("out_no").collect()
    assert " ".join(f"s{r.source_no}" if r.type == "source" else f"g{r.source_no}@{r.t}" for r in out) == labels


def test_interpolation_rejects_other_factors(spark):
    with pytest.raises(ValueError):
        retime.interpolation_plan(frames_of(spark, [0, 1]), 3)
    assert [retime.conversion_factor(30, f) for f in (60, 120, 60.2, 45)] == [2, 4, 2, None]


def test_pacing_of_rounded_ticks(spark):
    out = timeline.pacing_report(frames_of(spark, [round(i * 1e6 / 60) for i in range(600)]), 1e6 / 60).first()
    assert out.valid and out.frames == 600


def test_pacing_failures(spark):
    assert timeline.pacing_report(frames_of(spark, [0, 0]), 1e6 / 30).first().non_monotonic == 1
    gap = timeline.pacing_report(frames_of(spark, [0, 66667]), 1e6 / 30).first()
    assert gap.missing == 1 and not gap.valid


def test_accounting(spark):
    step = 1e6 / 60
    good = frames_of(spark, [round(i * step) for i in range(120)], round(step))
    out = timeline.frame_accounting(good, good, good, step).first()
    assert (out.valid, out.decoded, out.encoded, out.output_missing) == (True, 120, 120, 0)
    d = round(1e6 / 30)
    short = frames_of(spark, [0, d, 3 * d], d)
    assert timeline.frame_accounting(short, short, short, 1e6 / 30).first().errors == ["output_integrity"]
    back = frames_of(spark, [0, 33333, 20000], 33333)
    assert "source_order" in timeline.frame_accounting(back, back, frames_of(spark, [0, 33333, 66667], 33333), 1e6 / 30).first().errors


def test_missing_side_of_accounting(spark):
    some, none = frames_of(spark, [0, 1]), frames_of(spark, [0]).where("false")
    assert timeline.frame_accounting(some, none, none, 1.0).first().first_error == "frame_loss"
    assert timeline.frame_accounting(none, some, some, 1.0).first().first_error == "no_decoded"


def test_window_sizes():
    sizes = [retime.window_samples(1 / i, 1 / o, a)[0] for i, o, a in ((120, 60, 1), (240, 60, 1.5), (60, 60, 0))]
    assert sizes == [2, 6, 0]


def test_window_weights(spark):
    rows = spark.createDataFrame([(1, p, 7) for p in range(7)] + [(2, p, 3) for p in range(3)], "w int, pos int, n int")
    for method in retime.WEIGHT_METHODS:
        out = retime.window_weights(rows, method, custom=[1, 2, 1], keys=("w",)).groupBy("w").agg(F.sum("weight").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in out)
    custom = retime.window_weights(rows.where("w = 2"), "custom", custom=[1, 2, 1], keys=("w",)).orderBy("pos").collect()
    assert [r.weight for r in custom] == [.25, .5, .25]
    with pytest.raises(ValueError):
        retime.window_weights(rows, "sideways")


def test_resample_even_rates(spark):
    out = retime.resample_cfr(frames_of(spark, [0, 40000, 80000], 40000), target_fps=50, interpolate=True).orderBy("tick_no").collect()
    assert [(r.pts_us, r.source_no, r.generated, r.t) for r in out] == [
        (0, 0, False, 0.0), (20000, 0, True, .5), (40000, 1, False, 0.0), (60000, 1, True, .5), (80000, 2, False, 0.0)]
    nearest = retime.resample_cfr(frames_of(spark, [0, 40000, 80000], 40000), target_fps=50).orderBy("tick_no").collect()
    assert [r.source_no for r in nearest] == [0, 1, 1, 2, 2]


def test_estimated_count(spark):
    count = lambda n, a, c: one(spark, retime.estimate_output_count(F.lit(n), F.lit(a), F.lit(c)))
    assert [count(0, 30, 60), count(1, 30, 60), count(31, 30, 60), count(3, 60, 30)] == [0, 1, 61, 2]


def test_timeline_rebases_on_first_arrival(spark):
    df = spark.createDataFrame([(1, 0, 2.0, .5), (1, 1, 1.5, 0.0), (1, 2, 2.5, .5)], "clip_id bigint, frame_no bigint, ts_s double, dur_s double")
    out = read_timeline(df).orderBy("arrival").collect()
    assert [(r.pts_us, r.dur_us) for r in out] == [(0, 500000), (0, 1), (500000, 500000)]


def test_hysteresis_and_preflight(spark):
    levels = [0, 4, 3, 2, 5, 1]
    df = spark.createDataFrame([(1, i, i * 10, s) for i, s in enumerate(levels)], "clip_id bigint, frame_no bigint, pts_us bigint, status int")
    assert [(r.frame_no, r.action) for r in timeline.hysteresis_transitions(df).orderBy("frame_no").collect()] == [
        (1, "autopause"), (3, "autoresume"), (4, "autopause"), (5, "autoresume")]
    assert [(r.start_us, r.end_us) for r in timeline.hysteresis_intervals(df).orderBy("interval_no").collect()] == [(10, 30), (40, 50)]
    assert [one(spark, timeline.preflight_action(F.lit(s))) for s in (4, 3, 2)] == ["wait", "reduce-concurrency", "continue"]


# ---- planes -------------------------------------------------------------------------------

def ints(values):
    return F.array(*[F.lit(int(v)) for v in values])


def test_scene_score(spark):
    score = lambda a, c: one(spark, planes.scene_score(ints(a), ints(c)))
    assert score([0] * 64, [255] * 64) > .9
    assert score([110] * 64, [120] * 64) < .12
    with pytest.raises(Exception):
        score([1, 2], [1])


def test_difference(spark):
    diff = lambda a, c: one(spark, planes.mean_abs_difference(ints(a), ints(c)))
    assert (diff([10, 20], [10, 20]), diff([0, 0], [255, 255]), diff([1], [1, 2])) == (0, 1, 1)


def test_temporal_blend(spark):
    blend = lambda d, s: one(spark, planes.temporal_blend(F.lit(d), s))
    assert blend(.005, 1) > .35 and blend(.09, 1) < .2 and blend(.3, 1) == 0 and blend(.005, 0) == 0


def test_exposure_correction(spark):
    fix = lambda c, p, s, d: one(spark, planes.exposure_correction(F.lit(c), F.lit(p), s, F.lit(d)))
    assert fix(.4, .5, 1, .15) == 1
    assert fix(.4, .8, 1, .01) == pytest.approx(1.08)
    assert fix(.8, .4, 1, .01) == pytest.approx(.92)
    assert fix(.4, .8, 0, .01) == 1


def solid(spark, value, side=8):
    return spark.createDataFrame([(1, 0, side, side, [value] * side * side)], "clip_id bigint, frame_no bigint, pw int, ph int, luma array<int>")


def test_audit_and_summary(spark):
    white = planes.frame_audit(solid(spark, 255)).first()
    assert white.clipping_ratio == 1
    assert planes.clip_quality_summary(planes.frame_audit(solid(spark, 255))).first().score < 60
    grey = planes.clip_quality_summary(planes.frame_audit(solid(spark, 128))).first()
    assert grey.score == 100 and grey.warnings == []


def test_summary_without_samples(spark):
    clips = spark.createDataFrame([(1,), (2,)], "clip_id bigint")
    out = {r.clip_id: r for r in planes.clip_quality_summary(planes.frame_audit(solid(spark, 128)), clips=clips).collect()}
    assert out[2].score is None and out[2].warnings == ["NO_SAMPLES"] and out[1].score == 100


def test_quality_stride_and_colour(spark):
    """A plane large enough for a stride, against a direct loop."""
    w, h = 800, 610
    colour = [[(x * 7 + y * 3 + k * 50) % 256 for y in range(h) for x in range(w)] for k in range(3)]
    df = spark.createDataFrame([(1, 0, w, h, *colour)], "clip_id bigint, frame_no bigint, pw int, ph int, r array<int>, g array<int>, b array<int>")
    step = 2
    got = planes.frame_quality(df, ("r", "g", "b"), stride=step).first()
    assert planes.frame_quality(df, ("r", "g", "b")).first() == planes.frame_quality(df, ("r", "g", "b"), stride=1).first() != got
    luma = [.2126 * r + .7152 * g + .0722 * c for r, g, c in zip(*colour)]
    n = total = noise = saturation = 0
    for y in range(1, h - 1, step):
        for x in range(1, w - 1, step):
            i = y * w + x
            gradient = abs(luma[i + 1] - luma[i - 1]) + abs(luma[i + w] - luma[i - w])
            total += luma[i]
            if gradient < 20:
                noise += abs(4 * luma[i] - luma[i - 1] - luma[i + 1] - luma[i - w] - luma[i + w])
            top = max(c[i] for c in colour)
            saturation += (top - min(c[i] for c in colour)) / top if top else 0
            n += 1
    assert got.exposure == pytest.approx(total / n / 255)
    assert got.noise == pytest.approx(min(1, noise / n / 20))
    assert got.saturation == pytest.approx(saturation / n)


def test_motion_field_finds_a_shift(spark):
    w, h = 96, 54
    pattern = lambda x, y: int(127 + 60 * math.sin(x * .35) + 50 * math.cos(y * .41) + 15 * math.sin((x + y) * .9))
    first = [pattern(x, y) for y in range(h) for x in range(w)]
    second = [pattern(x - 2, y + 1) for y in range(h) for x in range(w)]
    df = spark.createDataFrame([(1, 0, w, h, first), (1, 1, w, h, second)], "clip_id bigint, frame_no bigint, pw int, ph int, luma array<int>")
    out = motion.motion_field(df).where("ready").first()
    assert abs(out.global_dx - 2) <= 1 and abs(out.global_dy + 1) <= 1 and out.confidence > .2
    shift = motion.global_shift(df, 3).first()
    assert (shift.dx, shift.dy) == (2, -1)


def test_dyadic_time(spark):
    at = lambda t: one(spark, planes.dyadic_time(F.lit(t)))
    assert [at(t) for t in (0.0, .0005, .25, .5, .53, .9995, 1.0)] == [0, 0, .25, .5, .5, 1, 1]


# ---- tiles --------------------------------------------------------------------------------

@pytest.mark.parametrize("w,h,tile,overlap", [(1280, 720, 256, 12), (100, 100, 64, 8), (65, 33, 32, 4), (1000, 1000, 128, 0)])
def test_tiles_cover_with_unit_weight(spark, w, h, tile, overlap):
    df = spark.createDataFrame([(1, 0, w, h)], "clip_id bigint, frame_no bigint, width int, height int")
    laid = tiles.tile_layout(df, tile, overlap)
    cells = laid.withColumn("values", F.array_repeat(F.lit(7), F.col("tile_w") * F.col("tile_h")))
    out = tiles.tile_merge(cells, overlap)
    summary = out.agg(F.count("*").alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.min("value").alias("a"), F.max("value").alias("z")).first()
    assert summary.n == w * h and abs(summary.lo - 1) < .01 and abs(summary.hi - 1) < .01
    assert summary.a == pytest.approx(7) and summary.z == pytest.approx(7)


def test_tile_model_size_is_checked(spark):
    laid = tiles.cut_tiles(solid(spark, 5), 6, 2)
    with pytest.raises(Exception, match="expected"):
        tiles.map_tiles(laid, lambda t: t[:, :-1]).count()
    with pytest.raises(ValueError):
        tiles.tile_layout(solid(spark, 5), 8, 8)


# ---- catalogue ----------------------------------------------------------------------------

def clip(spark, **values):
    base = dict(clip_id=1, width=1920, height=1080, fps=30.0, duration_s=10.0, size_bytes=1000, codec="avc1.64002a", has_audio=True, audio_codec="mp4a.40.2")
    base.update(values)
    return spark.createDataFrame([tuple(base.values())], "clip_id bigint, width int, height int, fps double, duration_s double, size_bytes bigint, "
                                 "codec string, has_audio boolean, audio_codec string")


def test_geometry(spark):
    size = lambda w, h, **k: tuple(rules.output_geometry(clip(spark, width=w, height=h), **k).select("out_width", "out_height", "error").first())
    assert size(3840, 2160, resolution="1080", aspect="16:9") == (1920, 1080, None)
    assert size(1080, 1920, resolution="1080", aspect="9:16") == (1080, 1920, None)
    assert size(1920, 1080, resolution="1080", aspect="4:5") == (1080, 1350, None)
    assert size(1920, 1080, resolution="custom", custom_width=1001, custom_height=1777) == (1002, 1778, None)
    assert size(1920, 1080, resolution="custom", custom_width=9000, custom_height=1080)[2] == "too_large"
    assert size(1920, 1080, resolution="999")[2] == "unsupported_resolution"


def test_placement(spark):
    rect = lambda fit: rules.placement(clip(spark).withColumn("out_width", F.lit(1080)).withColumn("out_height", F.lit(1080)).withColumn("fit", F.lit(fit))).first().placement
    c = rect("contain")
    assert (c.dx, c.dy, c.dw, c.dh) == (0, 236.25, 1080, 607.5)
    c = rect("cover")
    assert (c.sx, c.sy, c.sw, c.sh) == (420, 0, 1080, 1080)


def test_working_size(spark):
    out = rules.working_size(clip(spark, width=3840, height=2160), 3).first()
    assert out.output_width <= 8192 and out.output_height <= 8192 and out.output_width * out.output_height <= 33_554_432 and out.downscaled


def test_codec_levels(spark):
    first = lambda w, h, f: one(spark, rules.codec_levels(F.lit(w), F.lit(h), F.lit(f)))[0]
    assert [first(1920, 1080, 60), first(3840, 2160, 30), first(3840, 2160, 60), first(7680, 4320, 30)] == [
        "avc1.64002a", "avc1.640033", "avc1.640034", "avc1.64003c"]


def test_track_rules(spark):
    check = lambda **k: rules.track_conformance(clip(spark, **k), F.lit(1920), F.lit(1080), F.lit(True)).first()
    assert check().valid
    assert check(codec="vp09", audio_codec="opus").violations == ["not_h264", "not_aac"]
    assert check(has_audio=False, audio_codec=None).first_violation == "audio_missing"


def test_acceptance_and_profiles(spark):
    names = list(rules.ACCEPTANCE_WEIGHTS)
    rows = spark.createDataFrame([(1, n, True) for n in names] + [(2, n, n != "opfs") for n in names], "run_id int, test string, ok boolean")
    out = {r.run_id: r for r in rules.device_acceptance(rows).collect()}
    assert (out[1].score, out[1].ready, out[1].grade) == (100, True, "excellent") and (out[2].score, out[2].ready) == (80, False)
    devices = spark.createDataFrame([(None, "Mozilla/5.0 (Linux; Android 14; 24069PC21G)", 8.0, 8), (None, "Mozilla/5.0 (Linux; Android 15; GenericPhone)", 12.0, 8)],
                                    "model string, user_agent string, memory_gb double, cores int")
    a, c = rules.device_profile(devices).collect()
    assert (a.profile, a.recommended_mode, a.tile_size, a.batch_size) == ("poco-f6", "poco-f6", 384, 2) and (c.profile, c.detected) == ("high-end-android", False)


def test_enhance_plan_and_resolve(spark):
    rows = spark.createDataFrame([(.5, .5, .05, .2, .3, .05)], "exposure double, contrast double, noise double, detail double, blocking double, banding double")
    plan = rules.enhance_plan(rows, "strong").first()
    assert plan.stages["deblock"].enabled and plan.stages["fineDetailRecovery"].enabled and not plan.stages["denoise"].enabled
    assert plan.stages["deblock"].strength == pytest.approx(.386) and plan.signals == ["blocks", "soft"]
    df = spark.createDataFrame([({"denoiseAmount": .9}, {"denoise": (False, .8), "deblock": (True, 5.0)})],
                               "effects map<string,double>, stages map<string,struct<enabled:boolean,strength:double>>")
    out = rules.split_settings(rules.resolve_settings(df)).first()
    assert out.resolved["denoiseAmount"] == 0 and out.resolved["deblockAmount"] == 2 and out.resolved["sharpenAmount"] == .35
    assert out.cleanup["deblockAmount"] == 2 and out.finish["deblockAmount"] == 0 and set(out.temporal) == set(rules.TEMPORAL_KEYS)


def test_window_config(spark):
    df = spark.createDataFrame([("custom", 480.0, True, 9.0), ("custom", 480.0, False, 9.0)],
                               "output_fps string, custom_output_fps double, mobile_safe boolean, interpolation_multiplier double")
    out = rules.normalize_window_config(df.withColumn("source_fps", F.lit(60.0))).collect()
    assert [(r.cfg_output_fps, r.cfg_interpolation_multiplier) for r in out] == [(240, 5), (480, 8)]


def test_download_gate(spark):
    mb = 1024 * 1024
    rows = spark.createDataFrame([(340 * mb, 2000 * mb, 500 * mb, "4g", False, False), (340 * mb, None, None, "4g", True, False),
                                  (340 * mb, 600 * mb, 200 * mb, "4g", False, False), (340 * mb, None, None, "4g", True, True)],
                                 "required bigint, quota bigint, usage bigint, network string, save_data boolean, force boolean")
    assert [r.reason for r in rules.download_gate(rows).collect()] == ["ok", "data-saver", "low-storage", "forced"]


def test_load_and_pressure(spark):
    assert rules.load_tier(clip(spark, width=3840, height=2160, fps=60.0), upscale=True, rife=True, face=True).first().load_tier == "EXTREME"
    t = spark.createDataFrame([(1, 0, None, 9, 7)], "clip_id bigint, frame_no bigint, heap_ratio double, codec_queue int, write_backlog int")
    assert timeline.pressure_tier(t, plan_queue=2, plan_backlog=2).first().tier == "CRITICAL"


def test_first_ready(spark):
    rows = spark.createDataFrame([(1, 1280, 720, 3840, 2160, 30.0, 30.0, False, "poco-f6"), (2, 1920, 1080, 1920, 1080, 30.0, 60.0, False, "x"),
                                  (3, 1920, 1080, 1920, 1080, 30.0, 30.0, True, "poco-f6")],
                                 "request_id int, width int, height int, out_width int, out_height int, fps double, target_fps double, wants_face boolean, profile string")
    status = spark.createDataFrame([("real-esrgan-x4plus", True), ("rife47-emmajohnson311", True)], "model_id string, ready boolean")
    out = rules.assign_first_ready(rules.model_preferences(rows), status).collect()
    assert {(r.request_id, r.kind): (r.model_id, r.ready) for r in out} == {
        (1, "upscale"): ("real-esrgan-x4plus", True), (2, "rife"): ("rife47-emmajohnson311", True), (3, "face"): ("gfpgan-1.4", False)}


def test_cost_without_duration(spark):
    job = clip(spark, duration_s=0.0).withColumns({"tier": F.lit("LOW"), "target_width": F.lit(1), "target_height": F.lit(1), "target_fps": F.lit(1)})
    assert rules.cost_estimate(job).first().seconds is None


def test_remaining_settings(spark):
    requested = spark.createDataFrame([(1, k) for k in ("denoise", "clarity", "targetFps", "antiFlicker", "colorLab")], "session_id int, key string")
    applied = spark.createDataFrame([(1, "restore"), (1, "rife"), (1, "color")], "session_id int, stage_id string")
    assert {r.key for r in rules.remaining_settings(requested, applied).collect()} == {"clarity", "colorLab"}


# ---- sources ------------------------------------------------------------------------------

def test_read_clips_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"clip_id": 1, "fps": 29.970029, "codec": null}\n{"clip_id": 2, "fps": -1, "codec": "avc1"}\n')
    out = {r.clip_id: r for r in read_clips(spark, str(tmp_path), "json").collect()}
    assert (out[1].fps, out[1].codec, out[2].fps, out[2].has_audio) == (29.97, "unknown", 30.0, False)


def box(kind, payload=b""):
    return (8 + len(payload)).to_bytes(4, "big") + kind + payload


@pytest.mark.parametrize("data,valid,reason,fast", [
    (box(b"ftyp", bytes(8)) + box(b"moov") + box(b"mdat"), True, None, True),
    (box(b"ftyp", bytes(8)) + box(b"mdat") + box(b"moov"), True, None, False),
    (box(b"moov") + box(b"mdat"), False, "missing_ftyp", False), (b"short", False, "header_too_short", False),
    (box(b"ftyp", bytes(8)) + (2).to_bytes(4, "big") + b"free", False, "invalid_box_size", False),
    (box(b"ftyp", bytes(8)) + (1).to_bytes(4, "big") + b"mdat" + (2 ** 60).to_bytes(8, "big"), False, "box_too_large", False),
    (box(b"ftyp", bytes(8)) + box(b"moov") + (0).to_bytes(4, "big") + b"mdat" + bytes(99), True, None, True)])
def test_mp4_files(spark, tmp_path, data, valid, reason, fast):
    (tmp_path / "a.mp4").write_bytes(data)
    out = media_files.audit_mp4(media_files.scan_mp4_boxes(media_files.read_files(spark, str(tmp_path)))).first()
    assert (out.valid, out.reason, out.fast_start) == (valid, reason, fast)


def test_ivf_file(spark, tmp_path):
    head = b"DKIF" + (0).to_bytes(2, "little") + (32).to_bytes(2, "little") + b"VP90" + bytes(4)
    head += (30000).to_bytes(4, "little") + (1000).to_bytes(4, "little") + (0).to_bytes(8, "little")
    packet = lambda ts, body: len(body).to_bytes(4, "little") + ts.to_bytes(8, "little") + body
    (tmp_path / "a.ivf").write_bytes(head + packet(0, b"abc") + packet(3, b"d") + (99).to_bytes(4, "little") + bytes(9))
    out = media_files.scan_ivf_packets(media_files.read_files(spark, str(tmp_path))).orderBy("packet_no").collect()
    assert [(r.packet_no, r.offset, r.length, r.ts) for r in out] == [(0, 44, 3, 0), (1, 59, 1, 3)] and out[1].pts_ms == 100


IDENTITY_CUBE = 'TITLE "Identity"\nLUT_3D_SIZE 2\n0 0 0\n1 0 0\n0 1 0\n1 1 0\n0 0 1\n1 0 1\n0 1 1\n1 1 1'


def test_cube_identity(spark, tmp_path):
    (tmp_path / "i.cube").write_text(IDENTITY_CUBE)
    headers, lattice = media_files.read_cube_lut(spark, str(tmp_path))
    head = headers.first()
    assert (head.type, head.size, head.title, head.error) == ("3d", 2, "Identity", None)
    luts = colour_ops.lattice_rows_to_luts(headers, lattice)
    sample = headers.select("lut_id", F.lit(.25).alias("r"), F.lit(.5).alias("g"), F.lit(.75).alias("b"))
    out = colour_ops.lut_apply(sample, luts).first()
    assert (out.r, out.g, out.b) == pytest.approx((.25, .5, .75), abs=1e-6)


@pytest.mark.parametrize("text_,error", [
    ("LUT_3D_SIZE 2\n0 0 0", "row_count"), ("", "empty"), ("0 0 0", "missing_size"), ("LUT_1D_SIZE 2\nLUT_3D_SIZE 2\n0 0 0\n1 1 1", "duplicate_size"),
    ("LUT_1D_SIZE 2\nDOMAIN_MIN 1 0 0\n0 0 0\n1 1 1", "domain_order"), ("LUT_1D_SIZE 2\n0 0 x\n1 1 1", "invalid_row"), ("LUT_3D_SIZE 99\n0 0 0", "unsupported_size"),
    ("LUT_1D_SIZE 2\nDOMAIN_MAX 1 1\n0 0 0\n1 1 1", "invalid_domain")])
def test_cube_faults(spark, text_, error):
    headers, lattice = media_files.parse_cube(spark.createDataFrame([("a", text_)], "lut_id string, text string"))
    assert headers.first().error == error and lattice.count() == 0


def test_curves(spark):
    for bad in ("0.2:0,1:1", "0:0", "0:0,0:1,1:1", "0:0,1:2", "0:0,x:1"):
        with pytest.raises(ValueError):
            colour_ops.parse_curve(bad)
    out = colour_ops.curve_apply(spark.createDataFrame([(.5,), (.75,), (2.0,)], "value double"), "0:0,0.5:0.25,1:1").collect()
    assert [r.mapped for r in out] == [.25, .625, 1.0]


def test_grade_neutrality(spark):
    rows = spark.createDataFrame([(64, 96, 128)], "r int, g int, b int")
    assert not colour_ops.needs_pass({}) and colour_ops.needs_pass({"lift": .05}) and not colour_ops.needs_pass({"lift": .05, "enabled": False})
    assert tuple(colour_ops.color_grade(rows, {}).first()) == (64, 96, 128) and tuple(colour_ops.tone_map(rows).first()) == (64, 96, 128)
    assert tuple(colour_ops.color_grade(rows, {"lift": .05, "gamma": 1.1, "gain": 1.05}).first()) != (64, 96, 128)


# ---- boxes, audio, keys -------------------------------------------------------------------

def test_track_step():
    old = [{"x": 100, "y": 80, "width": 200, "height": 200, "score": 1, "track_id": "0"}]
    new = [{"x": 110, "y": 90, "width": 204, "height": 196, "score": .9, "track_id": "1"}, {"x": 600, "y": 20, "width": 50, "height": 50, "score": .8, "track_id": "2"}]
    out = boxes.step_tracks(old, new, .5, .08)
    assert [(b["x"], b["y"], b["width"], b["height"], b["track_id"]) for b in out] == [(105, 85, 202, 198, "0"), (600, 20, 50, 50, "2")]


def test_roll(spark):
    roll = lambda *p: one(spark, geometry.roll_radians(*[F.lit(v).cast("double") for v in p]))
    assert roll(10, 10, 30, 20) == pytest.approx(math.atan2(10, 20)) and roll(10, 10, None, None) == 0
    assert roll(10, 10, 10, 60) == pytest.approx(35 * math.pi / 180) and roll(10, 10, 11, 10) == 0


def test_decode_one_cell(spark):
    n = 16
    cls, obj, bbox = [0.0] * n, [0.0] * n, [0.0] * (4 * n)
    cls[10], obj[10] = 1.0, .81
    df = spark.createDataFrame([(1, 0, 8, cls, obj, bbox, [0.0] * (10 * n))],
                               "clip_id bigint, frame_no bigint, stride int, cls array<double>, obj array<double>, bbox array<double>, kps array<double>")
    out = boxes.decode_detections(df, .72, 32, 32).first()
    assert (out.x, out.y, out.width, out.height) == (12, 12, 8, 8) and out.score == pytest.approx(.9)
    with pytest.raises(Exception, match="does not fit"):
        boxes.decode_detections(df, .72, 320, 320).collect()


def test_av_drift(spark):
    def run(span_s, rows=1):
        clips = spark.createDataFrame([(1, 60.0, True)], "clip_id bigint, duration_s double, has_audio boolean")
        blocks = spark.createDataFrame([(1, 0, 0, 100, 1, [0.0] * round(span_s * 100))] * rows, "clip_id bigint, block_no bigint, ts_us bigint, rate int, channels int, samples array<double>")
        return audio.av_drift(clips, blocks).first()
    assert run(60.08).valid and not run(61).valid
    unknown = run(1, 0)
    assert unknown.valid and unknown.mode == "container-duration-only"


def test_limiter_keeps_peaks(spark):
    samples = [.9 * math.sin(2 * math.pi * 440 * (i // 2) / 48000) for i in range(1920)]
    df = spark.createDataFrame([(1, 0, 5, 48000, 2, samples)], "clip_id bigint, block_no bigint, ts_us bigint, rate int, channels int, samples array<double>")
    out = audio.adaptive_gain(df, limiter_db=-2).first()
    assert max(abs(v) for v in out.samples) <= 10 ** (-2 / 20) + 1e-12 and out.ts_us == 5


def test_silent_clip_is_left_alone(spark):
    df = spark.createDataFrame([(1, 0, 0, 8, 1, [0.0, 0.0])], "clip_id bigint, block_no bigint, ts_us bigint, rate int, channels int, samples array<double>")
    assert audio.peak_normalize(df).first().samples == [0.0, 0.0]


def test_node_keys(spark):
    key = lambda parent, a, z: one(spark, text.node_key(F.lit(parent), F.lit("color"), F.create_map(*[F.lit(v) for v in (*a, *z)])))
    assert key("p", ("x", "1"), ("y", "2")) == key("p", ("y", "2"), ("x", "1")) != key("q", ("x", "1"), ("y", "2"))


def test_readable_text(spark):
    assert [one(spark, text.format_bytes(F.lit(v))) for v in (1536, 5 * 1024 * 1024)] == ["1.5 KB", "5.0 MB"]
    assert [one(spark, text.format_duration(F.lit(v))) for v in (59.6, 3725.0, float("nan"))] == ["1 min 0 s", "1 h 2 min", "-"]
    assert one(spark, text.sanitize_name(F.lit("a b//c.mp4"))) == "a_b_c.mp4"
    assert one(spark, text.stage_file_name(F.lit("color"), F.lit("my!clip.mov"))) == "my_clip_color.mp4"


def test_resume_from_flushed_count(spark):
    frames = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 0)], "clip_id bigint, frame_no bigint")
    sessions = spark.createDataFrame([(7, 1, "in_progress", 20, 100, 100, 5), (6, 1, "completed", 25, 1, 1, 9)],
                                     "session_id bigint, owner bigint, status string, frames_written bigint, bytes_written bigint, file_bytes bigint, updated_at_us bigint")
    left = storage.resume_remaining(frames, sessions).collect()
    assert sorted((r.clip_id, r.frame_no) for r in left) == [(1, i) for i in range(20, 25)] + [(2, 0)]
    truncated = sessions.withColumn("file_bytes", F.lit(99))
    assert storage.resume_remaining(frames, truncated).count() == 26


def test_apply_stage_uses_the_cache(spark, tmp_path):
    df = spark.range(3)
    nodes = spark.createDataFrame([], "node_key string, bytes bigint")
    stored = str(tmp_path / "n")
    result, key, hit = storage.apply_stage(df, "root", "color", {"gain": "1.0"}, lambda d: d.withColumn("id", F.col("id") * 2), nodes, None)
    assert not hit and [r.id for r in result.orderBy("id").collect()] == [0, 2, 4]
    result.write.parquet(stored)
    nodes = spark.createDataFrame([(key, 10)], "node_key string, bytes bigint")
    again, same, hit = storage.apply_stage(df, "root", "color", {"gain": "1.0"}, lambda d: 1 / 0, nodes, lambda k: spark.read.parquet(stored))
    assert hit and same == key and again.count() == 3


def test_math(spark):
    assert [one(spark, mathx.js_round(F.lit(v))) for v in (-.5, .5, 2.4, -1.6)] == [0, 1, 2, -2]
    assert one(spark, mathx.clamp(F.lit(float("nan")), 2, 5)) == 2 and one(spark, mathx.clamp_zero(F.lit(float("nan")), -5, 5)) == 0
    assert one(spark, mathx.falsy_to(F.lit(0.0), 1)) == 1
    assert [one(spark, mathx.normalize_fps(F.lit(v))) for v in (None, 0.0, 29.97002, 999.0, .2)] == [30, 30, 29.97, 240, 1]
