"""Registered catalogue-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import planes as pl
from framelake.operators import rules as ru
from framelake.plans import bindings as b
from framelake.plans.plane_queries import MERGED, rounded
from framelake.plans.registry import query
from framelake.sources.catalog import normalize_clips

MEDIANS_SQL = "md AS (SELECT clip_id, " + ", ".join(
    f"list_sort(list(coalesce({c}, 0)))[len(list({c})) // 2 + 1] AS {c}" for c in MERGED) + " FROM M GROUP BY clip_id)"


def _medians(spark, sf_dir):
    return pl.merge_metrics(b.metrics(spark, sf_dir), MERGED)


@query("read_clips", b.sql("C", """r AS (SELECT clip_id, codec, CASE clip_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -fps WHEN 2 THEN fps * 20.12345
  WHEN 3 THEN fps / 100 ELSE fps * 0.9990009 END AS f FROM C)
SELECT clip_id, codec, CASE WHEN f IS NULL OR f <= 0 THEN 30.0 ELSE greatest(1.0, least(240.0, floor(f * 1000 + 0.5) / 1000)) END AS fps FROM r"""))
def read_clips(spark, sf_dir):
    clips = b.clips(spark, sf_dir)
    k = F.col("clip_id") % 5
    raw = (F.when(k == 0, None).when(k == 1, -F.col("fps")).when(k == 2, F.col("fps") * 20.12345)
           .when(k == 3, F.col("fps") / 100).otherwise(F.col("fps") * 0.9990009))
    return normalize_clips(clips.withColumn("fps", raw)).select("clip_id", "codec", "fps")


GEOMETRY_SQL = """gs AS (SELECT *, CASE clip_id % 7 WHEN 0 THEN 'original' WHEN 1 THEN '720' WHEN 2 THEN '1080' WHEN 3 THEN '1440'
     WHEN 4 THEN '2160' WHEN 5 THEN 'custom' ELSE '4320' END AS res,
    CASE clip_id % 9 WHEN 0 THEN 'original' WHEN 1 THEN '16:9' WHEN 2 THEN '9:16' WHEN 3 THEN '1:1' WHEN 4 THEN '4:5' WHEN 5 THEN '3:4'
     WHEN 6 THEN '4:3' WHEN 7 THEN '21:9' ELSE 'free' END AS asp,
    CASE clip_id % 3 WHEN 0 THEN 'contain' WHEN 1 THEN 'cover' ELSE 'stretch' END AS fit,
    CAST(clip_id % 1001 AS DOUBLE) AS cw, CAST(clip_id % 9001 AS DOUBLE) AS ch FROM C),
  ga AS (SELECT *, CASE WHEN asp = 'original' THEN CAST(width AS DOUBLE) / height WHEN asp = '16:9' THEN 16 / 9 WHEN asp = '9:16' THEN 9 / 16
     WHEN asp = '1:1' THEN 1.0 WHEN asp = '4:5' THEN 4 / 5 WHEN asp = '3:4' THEN 3 / 4 WHEN asp = '4:3' THEN 4 / 3 WHEN asp = '21:9' THEN 21 / 9
     WHEN cw > 0 AND ch > 0 THEN cw / ch ELSE 16 / 9 END AS ratio,
    CASE WHEN res = 'original' THEN least(width, height) WHEN res = 'custom' THEN NULL ELSE CAST(res AS DOUBLE) END AS edge FROM gs),
  gr AS (SELECT *, CASE WHEN res = 'custom' THEN cw WHEN ratio >= 1 THEN edge * ratio ELSE edge END AS rw,
    CASE WHEN res = 'custom' THEN ch WHEN ratio >= 1 THEN edge ELSE edge / ratio END AS rh FROM ga),
  ge AS (SELECT *, greatest(2, floor(rw / 2 + 0.5) * 2) AS ew, greatest(2, floor(rh / 2 + 0.5) * 2) AS eh FROM gr),
  gx AS (SELECT *, CASE WHEN res = 'custom' AND (cw < 2 OR ch < 2) THEN 'custom_too_small'
    WHEN ew > 8192 OR eh > 8192 THEN 'too_large' END AS error FROM ge),
  geo AS (SELECT clip_id, width, height, fit, error, CASE WHEN error IS NULL THEN CAST(ew AS INT) END AS out_width,
    CASE WHEN error IS NULL THEN CAST(eh AS INT) END AS out_height FROM gx)"""


def _geometry(spark, sf_dir):
    i = F.col("clip_id")
    pick = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (i % n + 1).cast("int"))
    return ru.output_geometry(
        b.clips(spark, sf_dir).select("clip_id", "width", "height"),
        pick(7, ["original", "720", "1080", "1440", "2160", "custom", "4320"]),
        pick(9, ["original", "16:9", "9:16", "1:1", "4:5", "3:4", "4:3", "21:9", "free"]),
        i % 1001, i % 9001, pick(3, ["contain", "cover", "stretch"]))


@query("output_geometry", b.sql("C", GEOMETRY_SQL + " SELECT clip_id, out_width, out_height, fit, error FROM geo"))
def output_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir).select("clip_id", "out_width", "out_height", "fit", "error")


@query("placement", b.sql("C", GEOMETRY_SQL + """,
  pr AS (SELECT *, CAST(width AS DOUBLE) / height AS sa, CAST(out_width AS DOUBLE) / out_height AS oa FROM geo),
  pc AS (SELECT *, CASE WHEN fit = 'cover' AND sa > oa THEN height * oa ELSE width END AS sw,
    CASE WHEN fit = 'cover' AND sa <= oa THEN width / oa ELSE height END AS sh,
    CASE WHEN fit = 'contain' AND sa <= oa THEN out_height * sa ELSE out_width END AS dw,
    CASE WHEN fit = 'contain' AND sa > oa THEN out_width / sa ELSE out_height END AS dh FROM pr)
SELECT clip_id, CASE WHEN error IS NULL THEN round((width - sw) / 2, 4) END AS sx, CASE WHEN error IS NULL THEN round((height - sh) / 2, 4) END AS sy,
  CASE WHEN error IS NULL THEN round(CAST(sw AS DOUBLE), 4) END AS sw, CASE WHEN error IS NULL THEN round(CAST(sh AS DOUBLE), 4) END AS sh,
  round((out_width - dw) / 2, 4) AS dx, round((out_height - dh) / 2, 4) AS dy, round(CAST(dw AS DOUBLE), 4) AS dw, round(CAST(dh AS DOUBLE), 4) AS dh FROM pc"""))
def placement(spark, sf_dir):
    out = ru.placement(_geometry(spark, sf_dir))
    return rounded(out.select("clip_id", "placement.*"), 4)


@query("working_size", b.sql("C", """w AS (SELECT *, 2 + clip_id % 3 AS s FROM C),
  f AS (SELECT *, least(1.0, least(8192.0 / greatest(width * s, height * s), sqrt(33554432.0 / (CAST(width AS DOUBLE) * s * height * s)))) AS k FROM w),
  e AS (SELECT *, greatest(2.0, floor(width * k / 2 + 0.5) * 2) AS iw, greatest(2.0, floor(height * k / 2 + 0.5) * 2) AS ih FROM f)
SELECT clip_id, iw AS input_width, ih AS input_height, iw * s AS output_width, ih * s AS output_height, k < 0.999 AS downscaled FROM e"""))
def working_size(spark, sf_dir):
    out = ru.working_size(b.clips(spark, sf_dir), F.lit(2) + F.col("clip_id") % 3)
    return out.select("clip_id", "input_width", "input_height", "output_width", "output_height", "downscaled")


@query("codec_levels", b.sql("C", """x AS (SELECT clip_id, CAST(width * (1 + clip_id % 3) AS BIGINT) * height AS p, fps FROM C)
SELECT clip_id, CASE WHEN p > 4096 * 2304 THEN CASE WHEN fps > 30 THEN 'avc1.64003d,avc1.64003e,avc1.64003c' ELSE 'avc1.64003c,avc1.64003d,avc1.64003e' END
  WHEN p > 1920 * 1080 THEN CASE WHEN fps > 30 THEN 'avc1.640034,avc1.640033,avc1.4d0034' ELSE 'avc1.640033,avc1.4d0033,avc1.640034' END
  WHEN p > 1280 * 720 OR fps > 30 THEN 'avc1.64002a,avc1.4d002a,avc1.640028' ELSE 'avc1.42001f,avc1.4d001f,avc1.64001f' END AS levels FROM x"""))
def codec_levels(spark, sf_dir):
    clips = b.clips(spark, sf_dir).withColumn("width", F.col("width") * (F.lit(1) + F.col("clip_id") % 3))
    return clips.select("clip_id", F.concat_ws(",", ru.codec_levels()).alias("levels"))


@query("encode_ladder", b.sql("C", """p AS (SELECT unnest(['LOW', 'BALANCED', 'HIGH', 'ULTRA']) AS preset, unnest([0.065, 0.11, 0.18, 0.28]::DOUBLE[]) AS bpp),
  r AS (SELECT C.*, preset, CAST(floor(CAST(width AS DOUBLE) * height * fps * bpp * 1.35::DOUBLE + 0.5) AS BIGINT) AS bitrate FROM C, p)
SELECT clip_id, preset, bitrate, round(bitrate * duration_s / 8, 6) AS estimated_bytes,
  round(size_bytes + bitrate * duration_s / 8 * (CASE WHEN has_audio THEN 2.4 ELSE 1.65 END)::DOUBLE, 5) AS workspace_bytes FROM r"""))
def encode_ladder(spark, sf_dir):
    out = ru.encode_ladder(b.clips(spark, sf_dir), mode="max")
    return out.select("clip_id", "preset", "bitrate", F.round("estimated_bytes", 6).alias("estimated_bytes"),
                      F.round("workspace_bytes", 5).alias("workspace_bytes"))


@query("track_conformance", b.sql("C", """x AS (SELECT *, CASE WHEN clip_id % 4 = 0 THEN width + 2 ELSE width END AS ew, height AS eh, clip_id % 3 <> 0 AS ea FROM C),
  v AS (SELECT clip_id, concat_ws(',', CASE WHEN width <> ew OR height <> eh THEN 'size_mismatch' END,
    CASE WHEN NOT (codec LIKE 'avc1%' OR codec LIKE 'avc3%') THEN 'not_h264' END, CASE WHEN ea AND NOT has_audio THEN 'audio_missing' END,
    CASE WHEN NOT ea AND has_audio THEN 'audio_unexpected' END,
    CASE WHEN ea AND coalesce(audio_codec, '') NOT LIKE 'mp4a%' THEN 'not_aac' END) AS violations FROM x)
SELECT clip_id, violations, CASE WHEN violations = '' THEN NULL ELSE split_part(violations, ',', 1) END AS first_violation,
  violations = '' AS valid FROM v"""))
def track_conformance(spark, sf_dir):
    clips = (b.clips(spark, sf_dir)
             .withColumn("expected_width", F.when(F.col("clip_id") % 4 == 0, F.col("width") + 2).otherwise(F.col("width")))
             .withColumn("expected_height", F.col("height")).withColumn("expect_audio", F.col("clip_id") % 3 != 0))
    out = ru.track_conformance(clips)
    return out.select("clip_id", F.concat_ws(",", "violations").alias("violations"), "first_violation", "valid")


PLAN_RULES_SQL = {
    "denoise": ("noise > 0.16", "0.18 + noise * 0.55"), "temporalDenoise": ("noise > 0.16", "0.14 + noise * 0.38"),
    "deblock": ("blocking > 0.12", "0.2 + blocking * 0.62"), "deband": ("banding > 0.2", "0.14 + banding * 0.42"),
    "artifactRemoval": ("blocking > 0.12", "0.18 + blocking * 0.5"), "chromaDenoise": ("noise > 0.16", "0.12 + noise * 0.42"),
    "mosquitoNoise": ("blocking > 0.12", "0.16 + blocking * 0.44"),
    "compressionRecovery": ("blocking > 0.12", "0.2 + blocking * 0.58"),
    "detailFusion": ("detail < 0.48 AND noise <= 0.16", "0.14 + (1 - detail) * 0.38"),
    "detailRecovery": ("detail < 0.48 OR blocking > 0.12", "0.16 + (1 - detail) * 0.55"),
    "fineDetailRecovery": ("detail < 0.3", "0.12 + (0.35 - detail) * 0.65"),
    "textureRecovery": ("detail < 0.48 AND noise <= 0.16", "0.12 + (1 - detail) * 0.34"),
    "microTexture": ("detail < 0.48 AND noise <= 0.16", "0.1 + (1 - detail) * 0.26"),
    "structureRecovery": ("detail < 0.48 OR blocking > 0.12", "0.12 + (1 - detail) * 0.28"),
    "edgeRecovery": ("detail < 0.48", "0.14 + (1 - detail) * 0.38"),
    "clarity": ("detail < 0.48 AND contrast < 0.8", "0.12 + (0.8 - contrast) * 0.25"),
    "localContrast": ("contrast < 0.68", "0.1 + (0.68 - contrast) * 0.3"),
    "smartSharpen": ("detail < 0.48", "CASE WHEN noise > 0.16 THEN 0.28 ELSE 0.42 + (1 - detail) * 0.25 END"),
    "dehalo": ("detail < 0.48 AND mode <> 'natural'", "0.14"),
    "antiRinging": ("blocking > 0.12 OR mode = 'ultra'", "0.18 + blocking * 0.18"),
    "antiFlicker": ("true", "0.1"), "temporalDetailStability": ("detail < 0.48 OR blocking > 0.12", "0.16 + blocking * 0.25"),
}


@query("enhance_plan", b.sql("M", f"""{MEDIANS_SQL},
  z AS (SELECT *, CASE clip_id % 3 WHEN 0 THEN 'natural' WHEN 1 THEN 'strong' ELSE 'ultra' END AS mode,
    CAST(CASE clip_id % 3 WHEN 0 THEN 0.78 WHEN 1 THEN 1 ELSE 1.24 END AS DOUBLE) AS sc FROM md)
SELECT clip_id, mode, """ + ", ".join(
    f"({on}) AS {k}_on, floor(greatest(0, least(1.35, ({v})::DOUBLE * sc)) * 1000 + 0.5) / 1000 AS {k}"
    for k, (on, v) in PLAN_RULES_SQL.items()) + """,
  concat_ws(',', CASE WHEN blocking > 0.12 THEN 'blocks' END, CASE WHEN noise > 0.16 THEN 'noise' END, CASE WHEN detail < 0.48 THEN 'soft' END,
    CASE WHEN banding > 0.2 THEN 'bands' END) AS signals FROM z"""))
def enhance_plan(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("natural"), F.lit("strong"), F.lit("ultra")), (F.col("clip_id") % 3 + 1).cast("int"))
    out = ru.enhance_plan(_medians(spark, sf_dir).withColumn("mode", mode), F.col("mode"))
    return out.select("clip_id", "mode", F.array_join("signals", ",").alias("signals"),
                      *[F.col("stages")[k]["enabled"].alias(f"{k}_on") for k in ru.STAGES],
                      *[F.col("stages")[k]["strength"].alias(k) for k in ru.STAGES])


def _effect_map(**columns):
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("double"))])


@query("adapt_to_scene", b.sql("M", """g AS (SELECT *, greatest(0.42, least(1, 1 - noise * 0.72)) * (0.65 + greatest(0, least(1, (0.62 - detail) / 0.62)) * 0.5) AS sg FROM M)
SELECT clip_id, sample_no, round(exposure * greatest(0.45, least(1.2, 0.52 + noise * 1.25)), 6) AS denoise,
  round(contrast * greatest(0.5, least(1.25, 0.55 + blocking * 1.35)), 6) AS deblock,
  round(saturation * greatest(0.5, least(1.2, 0.55 + banding)), 6) AS deband, round(detail * sg, 6) AS sharpen,
  round(CASE WHEN contrast - 0.5 > 0 THEN (contrast - 0.5) * sg ELSE contrast - 0.5 END, 6) AS texture, round(noise, 6) AS vibrance FROM g"""))
def adapt_to_scene(spark, sf_dir):
    rows = b.metrics(spark, sf_dir).withColumn("effects", _effect_map(
        denoiseAmount=F.col("exposure"), deblockAmount=F.col("contrast"), debandAmount=F.col("saturation"),
        sharpenAmount=F.col("detail"), textureRecovery=F.col("contrast") - 0.5, vibrance=F.col("noise")))
    out = ru.adapt_to_scene(rows)
    e = F.col("effects")
    return rounded(out.select(
        "clip_id", "sample_no", e["denoiseAmount"].alias("denoise"), e["deblockAmount"].alias("deblock"), e["debandAmount"].alias("deband"),
        e["sharpenAmount"].alias("sharpen"), e["textureRecovery"].alias("texture"), e["vibrance"].alias("vibrance")))


def _layered(spark, sf_dir):
    """Base effects, three stage overrides, a colour layer and a temporal floor from metric rows."""
    i = F.col("clip_id") + F.col("sample_no")
    stage = lambda on, strength: F.struct(on.alias("enabled"), strength.cast("double").alias("strength"))
    stages = F.create_map(
        F.lit("denoise"), stage(i % 3 != 0, F.col("noise") * 4), F.lit("deblock"), stage(i % 4 != 0, F.col("blocking") * 3),
        F.lit("smartSharpen"), stage(F.lit(True), F.when(i % 5 == 0, None).otherwise(F.col("detail"))))
    return (b.metrics(spark, sf_dir)
            .withColumn("effects", _effect_map(denoiseAmount=F.col("exposure"), sharpenAmount=F.col("contrast"),
                                               exposure=F.col("exposure"), contrast=F.col("contrast") + 0.5))
            .withColumn("stages", F.when(i % 7 != 0, stages))
            .withColumn("colour", F.when(i % 2 == 0, _effect_map(saturation=F.col("saturation") * 2, tint=F.col("noise"))))
            .withColumn("master", F.col("banding") - 0.3))


RESOLVE_SQL = """k AS (SELECT *, clip_id + sample_no AS i, greatest(0, least(1, banding - 0.3)) AS st FROM M),
  rs AS (SELECT *, CASE WHEN i % 7 = 0 THEN exposure WHEN i % 3 = 0 THEN 0 ELSE greatest(0, least(2, noise * 4)) END AS r_denoise,
    CASE WHEN i % 7 = 0 OR i % 4 = 0 THEN 0 ELSE greatest(0, least(2, blocking * 3)) END AS r_deblock,
    CASE WHEN i % 7 = 0 THEN contrast ELSE greatest(0, least(2, CASE WHEN i % 5 = 0 THEN contrast ELSE detail END)) END AS r_sharpen,
    CASE WHEN i % 7 = 0 THEN NULL ELSE 0.12 END AS b_td, CASE WHEN i % 7 = 0 THEN NULL ELSE 0.1 END AS b_af, CASE WHEN i % 7 = 0 THEN NULL ELSE 0 END AS b_ts,
    CASE WHEN i % 7 = 0 THEN 0 ELSE 0.15 END AS r_detail FROM k),
  rv AS (SELECT *, CASE WHEN st > 0 THEN greatest(coalesce(b_td, 0), st * 0.72) ELSE b_td END AS td,
    CASE WHEN st > 0 THEN greatest(coalesce(b_af, 0), st * 0.58) ELSE b_af END AS af,
    CASE WHEN st > 0 THEN greatest(coalesce(b_ts, 0), st * 0.9) ELSE b_ts END AS ts,
    CASE WHEN i % 2 = 0 THEN saturation * 2 ELSE 1 END AS r_saturation, CASE WHEN i % 2 = 0 THEN noise ELSE 0 END AS r_tint FROM rs)"""


@query("resolve_settings", b.sql("M", RESOLVE_SQL + """
SELECT clip_id, sample_no, round(CAST(r_denoise AS DOUBLE), 6) AS denoise, round(CAST(r_deblock AS DOUBLE), 6) AS deblock, round(CAST(r_sharpen AS DOUBLE), 6) AS sharpen,
  round(CAST(r_detail AS DOUBLE), 6) AS detail, round(CAST(td AS DOUBLE), 6) AS temporal_denoise, round(CAST(af AS DOUBLE), 6) AS anti_flicker,
  round(CAST(ts AS DOUBLE), 6) AS stability, round(CAST(r_saturation AS DOUBLE), 6) AS saturation, round(CAST(r_tint AS DOUBLE), 6) AS tint,
  round(exposure, 6) AS exposure, round(contrast + 0.5, 6) AS contrast, CAST(1 AS DOUBLE) AS gain, CAST(0.02 AS DOUBLE) AS sharpen_threshold FROM rv"""))
def resolve_settings(spark, sf_dir):
    out = ru.resolve_settings(_layered(spark, sf_dir), colour="colour", master="master")
    r = lambda k: F.try_element_at("resolved", F.lit(k))
    names = {"denoise": "denoiseAmount", "deblock": "deblockAmount", "sharpen": "sharpenAmount", "detail": "detailAmount",
             "temporal_denoise": "temporalDenoise", "anti_flicker": "antiFlicker", "stability": "temporalDetailStability",
             "saturation": "saturation", "tint": "tint", "exposure": "exposure", "contrast": "contrast", "gain": "gain",
             "sharpen_threshold": "sharpenThreshold"}
    return rounded(out.select("clip_id", "sample_no", *[r(k).alias(n) for n, k in names.items()]))


@query("split_settings", b.sql("M", RESOLVE_SQL + """
SELECT clip_id, sample_no, round(CAST(r_denoise AS DOUBLE), 6) AS cleanup_denoise, CAST(0 AS DOUBLE) AS cleanup_sharpen, CAST(0 AS DOUBLE) AS finish_denoise,
  round(CAST(r_sharpen AS DOUBLE), 6) AS finish_sharpen, round(CAST(r_tint AS DOUBLE), 6) AS finish_tint, CAST(36 AS INT) AS cleanup_keys,
  CAST((CASE WHEN td IS NULL THEN 0 ELSE 1 END) + (CASE WHEN af IS NULL THEN 0 ELSE 1 END) + (CASE WHEN ts IS NULL THEN 0 ELSE 1 END) AS INT) AS temporal_keys,
  CAST(39 AS INT) AS finish_keys FROM rv"""))
def split_settings(spark, sf_dir):
    out = ru.split_settings(ru.resolve_settings(_layered(spark, sf_dir), colour="colour", master="master"))
    c, f = F.col("cleanup"), F.col("finish")
    return rounded(out.select(
        "clip_id", "sample_no", c["denoiseAmount"].alias("cleanup_denoise"), c["sharpenAmount"].alias("cleanup_sharpen"),
        f["denoiseAmount"].alias("finish_denoise"), f["sharpenAmount"].alias("finish_sharpen"), f["tint"].alias("finish_tint"),
        F.size(c).alias("cleanup_keys"), F.size("temporal").alias("temporal_keys"), F.size(f).alias("finish_keys")))


@query("quality_risks", b.sql("M", """q AS (SELECT *, contrast * 1.5 + detail * 0.7 + blocking * 0.5 + banding * 0.6 AS load, CASE WHEN saturation * 2 = 0 THEN 1 ELSE saturation * 2 END AS sat,
  CASE WHEN contrast * 1.2 = 0 THEN 1 ELSE contrast * 1.2 END AS con FROM M)
SELECT clip_id, sample_no, concat_ws(',', CASE WHEN load > 1.65 AND NOT (noise > 0.3) THEN 'HALO_RISK' END,
  CASE WHEN exposure * 2 > 0.78 AND noise / 2 < 0.1 THEN 'PLASTIC_TEXTURE_RISK' END, CASE WHEN sat > 1.55 OR banding > 0.75 THEN 'SATURATION_RISK' END,
  CASE WHEN exposure * 3 > 1.2 OR blocking > 0.75 THEN 'HIGHLIGHT_CLIP_RISK' END, CASE WHEN 0 - detail < -0.75 OR con > 1.55 THEN 'CRUSHED_BLACK_RISK' END) AS risks FROM q"""))
def quality_risks(spark, sf_dir):
    rows = b.metrics(spark, sf_dir).withColumn("effects", _effect_map(
        sharpenAmount=F.col("contrast") * 1.5, fineDetailRecovery=F.col("detail"), edgeRecovery=F.col("blocking"),
        highPassAmount=F.col("banding"), dehalo=F.when(F.col("noise") > 0.3, 1.0).otherwise(0.0), denoiseAmount=F.col("exposure") * 2,
        textureRecovery=F.col("noise") / 2, saturation=F.col("saturation") * 2, vibrance=F.col("banding"),
        exposure=F.col("exposure") * 3, whites=F.col("blocking"), blacks=-F.col("detail"), contrast=F.col("contrast") * 1.2))
    return rows.select("clip_id", "sample_no", F.concat_ws(",", ru.quality_risks()).alias("risks"))


def _r2(e):
    return f"floor(({e}) * 100 + 0.5) / 100"


@query("autofix_recommend", b.sql("M", f"""SELECT clip_id, sample_no,
  {_r2("(CASE WHEN exposure < 0.38 THEN least(0.18, (0.42 - exposure) * 0.55) ELSE 0 END) + (CASE WHEN exposure > 0.7 THEN -least(0.12, (exposure - 0.67) * 0.45) ELSE 0 END)")} AS fix_brightness,
  {_r2("greatest(0.9, least(1.22, 1.08 - (contrast - 0.5) * 0.18))")} AS fix_contrast,
  {_r2("greatest(0.92, least(1.13, 1.06 - (saturation - 0.3) * 0.2))")} AS fix_saturation,
  CAST(CASE WHEN saturation < 0.3 THEN 0.2 ELSE 0.08 END AS DOUBLE) AS fix_vibrance, CAST(CASE WHEN detail < 0.35 THEN 0.72 ELSE 0.4 END AS DOUBLE) AS fix_sharpen_amount,
  {_r2("greatest(0.08, least(0.56, noise * 0.65))")} AS fix_denoise, {_r2("greatest(0.12, least(0.62, (1 - detail) * 0.58))")} AS fix_detail,
  {_r2("CASE WHEN banding > 0.08 THEN greatest(0.08, least(0.28, noise * 0.25 + 0.08)) ELSE 0 END")} AS fix_portrait,
  CASE WHEN exposure < 0.36 OR exposure > 0.72 OR noise > 0.3 OR detail < 0.38 OR banding > 0.08 THEN concat_ws(',',
    CASE WHEN exposure < 0.36 THEN 'raise_exposure' WHEN exposure > 0.72 THEN 'protect_highlights' END, CASE WHEN noise > 0.3 THEN 'reduce_noise' END,
    CASE WHEN detail < 0.38 THEN 'recover_detail' END, CASE WHEN banding > 0.08 THEN 'smooth_skin' END) ELSE 'balanced' END AS reasons FROM M"""))
def autofix_recommend(spark, sf_dir):
    out = ru.autofix_recommend(b.metrics(spark, sf_dir).withColumn("skin_presence", F.col("banding")))
    return out.select("clip_id", "sample_no", "fix_brightness", "fix_contrast", "fix_saturation", "fix_vibrance", "fix_sharpen_amount",
                      "fix_denoise", "fix_detail", "fix_portrait", F.concat_ws(",", "reasons").alias("reasons"))


COST_SQL = """j AS (SELECT *, width * 2 AS tw, height * 2 AS th, CASE WHEN clip_id % 2 = 0 THEN 60.0 ELSE fps END AS tf,
    CASE clip_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'ULTRA' ELSE 'UNKNOWN' END AS tier FROM C),
  e AS (SELECT clip_id, tier, CAST(greatest(1, ceil(duration_s * greatest(fps, tf))) AS BIGINT) AS frames,
    greatest(CAST(width AS BIGINT) * height, CAST(tw AS BIGINT) * th) AS output_pixels, duration_s,
    (1 + 0.3 * 0.8 + 0.5 * 0.18) * (CASE WHEN clip_id % 3 = 0 THEN 8.5 ELSE 1 END) * (CASE WHEN clip_id % 4 = 0 THEN 2.8 ELSE 1 END) * (CASE WHEN clip_id % 7 = 0 THEN 4.2 ELSE 1 END) AS cost,
    CASE tier WHEN 'MEDIUM' THEN 42e6 WHEN 'HIGH' THEN 85e6 WHEN 'ULTRA' THEN 150e6 ELSE 18e6 END AS speed,
    CASE WHEN clip_id % 3 = 0 OR clip_id % 4 = 0 OR clip_id % 7 = 0 THEN 'by_model' ELSE 'by_device' END AS confidence FROM j),
  s AS (SELECT *, greatest(5.0::DOUBLE, frames * CAST(output_pixels AS DOUBLE) * cost::DOUBLE / speed + greatest(4.0, duration_s * 0.08)) AS seconds FROM e)"""


def _costs(spark, sf_dir):
    i = F.col("clip_id")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("LOW", "MEDIUM", "HIGH", "ULTRA", "UNKNOWN")]), (i % 5 + 1).cast("int"))
    jobs = (b.clips(spark, sf_dir).withColumn("tier", tier).withColumn("target_width", F.col("width") * 2)
            .withColumn("target_height", F.col("height") * 2).withColumn("target_fps", F.when(i % 2 == 0, 60.0).otherwise(F.col("fps")))
            .withColumn("effects", _effect_map(denoiseAmount=F.lit(0.3), sharpenAmount=F.lit(0.5))))
    return ru.cost_estimate(jobs, effects="effects", upscale=i % 3 == 0, rife=i % 4 == 0, face=i % 7 == 0)


@query("cost_estimate", b.sql("C", COST_SQL + " SELECT clip_id, tier, frames, output_pixels, round(seconds, 4) AS seconds, confidence FROM s"))
def cost_estimate(spark, sf_dir):
    return _costs(spark, sf_dir).select("clip_id", "tier", "frames", "output_pixels", F.round("seconds", 4).alias("seconds"), "confidence")


@query("capacity_by_tier", b.sql("C", COST_SQL + " SELECT tier, count(*) AS jobs, CAST(sum(frames) AS BIGINT) AS frames, round(sum(seconds) / 3600, 3) AS hours FROM s GROUP BY tier"))
def capacity_by_tier(spark, sf_dir):
    return _costs(spark, sf_dir).groupBy("tier").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("frames").alias("frames"), F.round(F.sum("seconds") / 3600, 3).alias("hours"))


@query("load_tier", b.sql("C", """l AS (SELECT *, CAST(width AS DOUBLE) * height AS px, CAST(width AS DOUBLE) * height / 1e6 * (fps / 30) * (1 + (CASE WHEN clip_id % 3 = 0 THEN 2.4 ELSE 0 END)::DOUBLE
     + (CASE WHEN clip_id % 4 = 0 THEN 1.8 ELSE 0 END)::DOUBLE + (CASE WHEN clip_id % 7 = 0 THEN 1.2 ELSE 0 END)::DOUBLE) AS ld,
    CASE clip_id % 6 WHEN 0 THEN 4 WHEN 1 THEN NULL ELSE 8 END AS mem, clip_id % 5 = 0 AS phone FROM C),
  t AS (SELECT *, CASE WHEN px >= 3840 * 2160 OR fps > 60 OR ld >= 20 OR coalesce(mem <= 4, false) THEN 'EXTREME'
    WHEN px >= 2560 * 1440 OR ld >= 10 THEN 'HEAVY' ELSE 'NORMAL' END AS load_tier FROM l)
SELECT clip_id, floor(ld * 100 + 0.5) / 100 AS load_score, load_tier,
  CASE load_tier WHEN 'EXTREME' THEN 1 WHEN 'HEAVY' THEN 2 ELSE 3 END AS codec_queue, CASE load_tier WHEN 'EXTREME' THEN 8 WHEN 'HEAVY' THEN 12 ELSE 24 END AS blur_samples,
  CASE load_tier WHEN 'EXTREME' THEN 4 WHEN 'HEAVY' THEN 8 ELSE 12 END AS checkpoint_every, phone AND load_tier <> 'NORMAL' AS sustained_mobile,
  CASE WHEN phone AND load_tier = 'EXTREME' THEN 'SUSTAINED' ELSE 'BALANCED' END AS thermal_bias FROM t"""))
def load_tier(spark, sf_dir):
    i = F.col("clip_id")
    out = ru.load_tier(b.clips(spark, sf_dir), upscale=i % 3 == 0, rife=i % 4 == 0, face=i % 7 == 0,
                       memory_gb=F.when(i % 6 == 0, 4).when(i % 6 == 1, None).otherwise(8),
                       device=F.when(i % 5 == 0, "xx Poco_F6 yy").otherwise("other"))
    return out.select("clip_id", "load_score", "load_tier", "codec_queue", "blur_samples", "checkpoint_every",
                      "sustained_mobile", "thermal_bias")


@query("device_profile", b.sql("D", """dv AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '24069PC21G' WHEN 1 THEN NULL ELSE 'phone ' || lang END AS model,
    CASE WHEN doc_id % 2 = 0 THEN text || ' Android' ELSE text END AS ua, doc_id % 13 AS mem, doc_id % 11 AS cores FROM documents),
  p AS (SELECT *, lower(coalesce(model, '') || ' ' || ua) AS fp FROM dv),
  cl AS (SELECT doc_id, CASE WHEN contains(fp, 'poco f6') OR contains(fp, '24069pc21g') OR contains(fp, '24069pc21i') THEN 'poco-f6'
    WHEN mem >= 8 AND cores >= 8 AND contains(lower(ua), 'android') THEN 'high-end-android' ELSE 'generic' END AS profile FROM p)
SELECT doc_id, profile, profile = 'poco-f6' AS detected, CASE profile WHEN 'poco-f6' THEN 'poco-f6' WHEN 'high-end-android' THEN 'quality' ELSE 'auto' END AS recommended_mode,
  CASE WHEN profile = 'generic' THEN 'adaptive' ELSE 'mobile-performance' END AS thermal_class FROM cl"""))
def device_profile(spark, sf_dir):
    i = F.col("doc_id")
    devices = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 5 == 0, "24069PC21G").when(i % 5 == 1, None).otherwise(F.concat(F.lit("phone "), "lang")).alias("model"),
        F.when(i % 2 == 0, F.concat("text", F.lit(" Android"))).otherwise(F.col("text")).alias("user_agent"),
        (i % 13).alias("memory_gb"), (i % 11).alias("cores"))
    return ru.device_profile(devices).select("doc_id", "profile", "detected", "recommended_mode", "thermal_class")


REQUESTS_SQL = """rq AS (SELECT session_id, owner, bytes * 40 AS required, CASE WHEN session_id % 23 = 0 THEN NULL ELSE bytes * 40 * (1 + session_id % 5) END AS quota, bytes * 40 AS usage,
    CASE session_id % 4 WHEN 0 THEN '2G' ELSE '4g' END AS network, session_id % 9 = 0 AS save_data, session_id % 31 = 0 AS force FROM S)"""


def _requests(spark, sf_dir):
    i = F.col("session_id")
    need = F.col("bytes") * 40
    return b.sessions(spark, sf_dir).select(
        "session_id", "owner", need.alias("required"), F.when(i % 23 == 0, None).otherwise(need * (F.lit(1) + i % 5)).alias("quota"),
        need.alias("usage"), F.when(i % 4 == 0, "2G").otherwise("4g").alias("network"), (i % 9 == 0).alias("save_data"),
        (i % 31 == 0).alias("force"))


@query("download_gate", b.sql("S", REQUESTS_SQL + """,
  g AS (SELECT session_id, CASE WHEN force THEN 'forced' WHEN save_data THEN 'data-saver' WHEN lower(network) IN ('slow-2g', '2g') THEN 'slow-network'
    WHEN quota IS NOT NULL AND required > 0 AND greatest(0, quota - usage) < required + greatest(268435456, ceil(required * 0.25)) THEN 'low-storage' ELSE 'ok' END AS reason FROM rq)
SELECT session_id, reason, reason IN ('forced', 'ok') AS allowed FROM g"""))
def download_gate(spark, sf_dir):
    return ru.download_gate(_requests(spark, sf_dir)).select("session_id", "reason", "allowed")


@query("capacity_check", b.sql("S", REQUESTS_SQL + """
SELECT session_id, CAST(CASE WHEN quota IS NOT NULL THEN greatest(0, quota - usage) END AS BIGINT) AS available_bytes,
  quota IS NULL OR greatest(0, quota - usage) >= required + 67108864 AS sufficient FROM rq"""))
def capacity_check(spark, sf_dir):
    return ru.capacity_check(_requests(spark, sf_dir)).select("session_id", "available_bytes", "sufficient")


@query("stage_requirement", b.sql("S", """SELECT session_id, CAST(greatest(100663296, ceil(bytes * 4 * (CASE WHEN session_id % 3 = 2 THEN 1.25 ELSE 1.65 END)::DOUBLE)) AS BIGINT) AS required_bytes FROM S"""))
def stage_requirement(spark, sf_dir):
    stage = F.element_at(F.array(F.lit("upscale"), F.lit("restore"), F.lit("color")), (F.col("session_id") % 3 + 1).cast("int"))
    return b.sessions(spark, sf_dir).select("session_id", ru.stage_requirement(stage, F.col("bytes") * 4).alias("required_bytes"))


@query("performance_class", b.sql("M", """x AS (SELECT clip_id, sample_no, CASE WHEN sample_no = 7 THEN NULL ELSE contrast * 20 END AS ms, CASE WHEN sample_no = 6 THEN NULL ELSE detail * 6000 END AS mem,
    CASE clip_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'mobile' WHEN 2 THEN 'quality' ELSE 'poco-f6' END AS mode, CASE WHEN sample_no = 1 THEN NULL ELSE CAST(100 * sample_no AS INT) END AS tile FROM M),
  t AS (SELECT *, CASE WHEN ms IS NULL THEN 'LOW' WHEN ms < 4 AND (mem IS NULL OR mem >= 3000) THEN 'ULTRA' WHEN ms < 9 THEN 'HIGH' WHEN ms < 18 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM x),
  u AS (SELECT *, CASE mode WHEN 'mobile' THEN 'LOW' WHEN 'quality' THEN CASE WHEN tier = 'LOW' THEN 'MEDIUM' ELSE tier END WHEN 'poco-f6' THEN 'POCO_F6' ELSE tier END AS used_tier FROM t)
SELECT clip_id, sample_no, tier, used_tier, least(CASE used_tier WHEN 'LOW' THEN 128 WHEN 'MEDIUM' THEN 256 WHEN 'HIGH' THEN 384 WHEN 'ULTRA' THEN 512 ELSE 256 END, tile) AS tile_size,
  CASE used_tier WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'ULTRA' THEN 3 ELSE 1 END AS batch_size,
  CASE used_tier WHEN 'LOW' THEN 'int8' ELSE 'fp16' END AS precision FROM u"""))
def performance_class(spark, sf_dir):
    n = F.col("sample_no")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("auto", "mobile", "quality", "poco-f6")]), (F.col("clip_id") % 4 + 1).cast("int"))
    rows = b.metrics(spark, sf_dir).select(
        "clip_id", "sample_no", F.when(n == 7, None).otherwise(F.col("contrast") * 20).alias("frame_ms"),
        F.when(n == 6, None).otherwise(F.col("detail") * 6000).alias("memory_mb"), mode.alias("mode"),
        F.when(n == 1, None).otherwise(n * 100).alias("tile"))
    out = ru.performance_class(rows, F.col("mode"), tile="tile")
    return out.select("clip_id", "sample_no", "tier", "used_tier", "tile_size", "batch_size", "precision")


@query("normalize_window_config", b.sql("M", """x AS (SELECT clip_id, sample_no, 24.0 + sample_no AS sf, clip_id % 3 <> 0 AS safe,
    CASE clip_id % 5 WHEN 0 THEN 'source' WHEN 1 THEN '480' WHEN 2 THEN 'custom' WHEN 3 THEN 'abc' END AS ofps, contrast * 600 AS cof, detail * 12 AS mul, exposure * 6 AS am, noise * 5 AS gm, blocking * 20 AS rg FROM M),
  y AS (SELECT *, CASE WHEN safe THEN 240.0 ELSE 480.0 END AS cap, greatest(1, least(CASE WHEN safe THEN 5 ELSE 8 END, CASE WHEN mul = 0 THEN 2 ELSE mul END)) AS mult,
    CASE ofps WHEN '480' THEN 480.0 WHEN 'custom' THEN CASE WHEN cof = 0 THEN sf ELSE cof END ELSE sf END AS o FROM x)
SELECT clip_id, sample_no, round(greatest(0, least(4, am)), 6) AS amount, round(greatest(1, least(cap, o)), 6) AS output_fps, round(greatest(0.25, least(4, gm)), 6) AS gamma,
  round(mult, 6) AS multiplier, round(greatest(1, least(cap, sf * mult)), 6) AS interpolation_fps,
  greatest(1.0::DOUBLE, least(12.0, floor((CASE WHEN rg = 0 THEN 2 ELSE rg END) + 0.5))) AS dedup_range, CAST(16 AS DOUBLE) AS crf FROM y"""))
def normalize_window_config(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(v) for v in ("source", "480", "custom", "abc", None)]), (F.col("clip_id") % 5 + 1).cast("int"))
    rows = b.metrics(spark, sf_dir).select(
        "clip_id", "sample_no", (F.lit(24.0) + F.col("sample_no")).alias("source_fps"), (F.col("clip_id") % 3 != 0).alias("mobile_safe"),
        text.alias("output_fps"), (F.col("contrast") * 600).alias("custom_output_fps"), (F.col("detail") * 12).alias("interpolation_multiplier"),
        (F.col("exposure") * 6).alias("amount"), (F.col("noise") * 5).alias("gamma"), (F.col("blocking") * 20).alias("deduplicate_range"))
    c = lambda k, n: F.col(f"cfg_{k}").alias(n)
    return rounded(ru.normalize_window_config(rows).select(
        "clip_id", "sample_no", c("amount", "amount"), c("output_fps", "output_fps"), c("gamma", "gamma"), c("interpolation_multiplier", "multiplier"),
        c("interpolation_fps", "interpolation_fps"), c("deduplicate_range", "dedup_range"), c("crf", "crf")))


RESULTS_SQL = """tr AS (SELECT session_id AS run_id, test, (session_id + n) % 3 <> 0 AS ok, CASE WHEN (session_id + n) % 7 = 0 THEN 'FAIL' WHEN (session_id + n) % 7 = 1 THEN 'SKIPPED' ELSE 'PASS' END AS status
  FROM S, (SELECT unnest(['webgpu', 'h264', 'aac', 'opfs', 'h2644k60']) AS test, unnest([0, 1, 2, 3, 4]) AS n))"""


def _results(spark, sf_dir):
    tests = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(n).alias("n")) for n, t in enumerate(ru.ACCEPTANCE_WEIGHTS)])
    rows = b.sessions(spark, sf_dir).select(F.col("session_id").alias("run_id"), F.inline(tests))
    k = F.col("run_id") + F.col("n")
    return rows.select("run_id", "test", (k % 3 != 0).alias("ok"),
                       F.when(k % 7 == 0, "FAIL").when(k % 7 == 1, "SKIPPED").otherwise("PASS").alias("status"))


@query("device_acceptance", b.sql("S", RESULTS_SQL + """,
  sc AS (SELECT run_id, CAST(sum(CASE WHEN NOT ok THEN 0 WHEN test = 'webgpu' THEN 25 WHEN test = 'h264' THEN 30 WHEN test = 'aac' THEN 15 WHEN test = 'opfs' THEN 20 ELSE 10 END) AS BIGINT) AS score,
    bool_and(ok) FILTER (test IN ('h264', 'opfs')) AS ready FROM tr GROUP BY run_id)
SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'limited' ELSE 'unsupported' END AS grade FROM sc"""))
def device_acceptance(spark, sf_dir):
    return ru.device_acceptance(_results(spark, sf_dir))


@query("run_verdict", b.sql("S", RESULTS_SQL + """,
  v AS (SELECT run_id, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status IN ('LIMITED', 'SKIPPED')) AS limited, count(*) AS tests FROM tr GROUP BY run_id)
SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN limited > 0 THEN 'LIMITED' ELSE 'PASS' END AS verdict FROM v"""))
def run_verdict(spark, sf_dir):
    return ru.run_verdict(_results(spark, sf_dir))


@query("assign_first_ready", b.sql("C", """q AS (SELECT clip_id, width * (1 + clip_id % 2) AS ow, width, height, fps, CASE WHEN clip_id % 3 = 0 THEN 60.0 ELSE fps END AS tf, clip_id % 4 = 0 AS wf, clip_id % 8 = 0 AS mob FROM C),
  pf AS (SELECT clip_id, 'upscale' AS kind, unnest(['real-esrgan-x4plus', 'onnx-model-zoo-sr-x3']) AS model, unnest([0, 1]) AS rk FROM q WHERE CAST(ow AS DOUBLE) * height > CAST(width AS DOUBLE) * height * 1.08
    UNION ALL SELECT clip_id, 'rife', unnest(['rife-tensorstack', 'rife47-emmajohnson311']), unnest([0, 1]) FROM q WHERE tf > fps + 0.01
    UNION ALL SELECT clip_id, 'face', unnest(CASE WHEN mob THEN ['gfpgan-1.4', 'codeformer'] ELSE ['codeformer', 'gfpgan-1.4'] END), unnest([0, 1]) FROM q WHERE wf),
  st AS (SELECT *, (clip_id + length(model)) % 2 = 0 AS ready FROM pf)
SELECT clip_id, kind, coalesce(arg_min(model, rk) FILTER (ready), arg_min(model, rk)) AS model_id, bool_or(ready) AS ready FROM st GROUP BY clip_id, kind"""))
def assign_first_ready(spark, sf_dir):
    i = F.col("clip_id")
    requests = b.clips(spark, sf_dir).select(
        "clip_id", "width", "height", (F.col("width") * (F.lit(1) + i % 2)).alias("out_width"), F.col("height").alias("out_height"), "fps",
        F.when(i % 3 == 0, 60.0).otherwise(F.col("fps")).alias("target_fps"), (i % 4 == 0).alias("wants_face"),
        F.when(i % 8 == 0, "poco-f6").otherwise("generic").alias("profile"))
    models = sorted({m for names in ru.MODEL_PREFERENCES.values() for m in names})
    # what is ready belongs to a class of devices, so the status table stays small beside the requests
    status = (requests.select((i % 2).alias("device")).distinct()
              .select("device", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"))
              .withColumn("ready", (F.col("device") + F.length("model_id")) % 2 == 0))
    wanted = ru.model_preferences(requests, "clip_id").withColumn("device", i % 2)
    return ru.assign_first_ready(wanted, status, "clip_id", ("device", "model_id"))


STAGE_LIST = ["restore", "detail", "sharp", "face", "upscale", "motion", "rife", "stabilize", "blur", "color"]


def _values(table):
    return "(VALUES " + ", ".join(f"('{s}', '{k}')" for s, keys in table.items() for k in keys) + ")"


@query("stage_keys", b.sql("S", f"""st AS (SELECT session_id, ({STAGE_LIST})[CAST(session_id % 10 AS INT) + 1] AS stage_id FROM S)
SELECT session_id, st.stage_id, k.key FROM st JOIN {_values(ru.STAGE_KEYS)} k(stage_id, key) ON st.stage_id = k.stage_id"""))
def stage_keys(spark, sf_dir):
    stages = F.array(*[F.lit(s) for s in STAGE_LIST])
    rows = b.sessions(spark, sf_dir).select("session_id", F.element_at(stages, (F.col("session_id") % 10 + 1).cast("int")).alias("stage_id"))
    return ru.stage_keys(rows)


@query("remaining_settings", b.sql("S", f"""ap AS (SELECT session_id, unnest([({STAGE_LIST})[CAST(session_id % 10 AS INT) + 1], ({STAGE_LIST})[CAST(session_id % 7 AS INT) + 1]]) AS stage_id FROM S),
  rq AS (SELECT session_id, unnest(['denoise', 'targetFps', 'antiFlicker', 'resolution', 'clarity', 'blur', 'colorLab', 'rifeModelId', 'effects.detailAmount']) AS key FROM S),
  dn AS (SELECT DISTINCT session_id, k.key FROM ap JOIN {_values(ru.APPLIED_KEYS)} k(stage_id, key) ON ap.stage_id = k.stage_id)
SELECT rq.* FROM rq ANTI JOIN dn USING (session_id, key)"""))
def remaining_settings(spark, sf_dir):
    stages = F.array(*[F.lit(s) for s in STAGE_LIST])
    pick = lambda n: F.element_at(stages, (F.col("session_id") % n + 1).cast("int"))
    sessions = b.sessions(spark, sf_dir)
    applied = sessions.select("session_id", F.explode(F.array(pick(10), pick(7))).alias("stage_id"))
    keys = ["denoise", "targetFps", "antiFlicker", "resolution", "clarity", "blur", "colorLab", "rifeModelId", "effects.detailAmount"]
    requested = sessions.select("session_id", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    return ru.remaining_settings(requested, applied)
