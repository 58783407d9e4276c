"""Registered plane, motion and audio queries on the embeddings binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import audio as au
from framelake.operators import motion as mo
from framelake.operators import planes as pl
from framelake.operators import retime as rt
from framelake.plans import bindings as b
from framelake.plans.registry import query


def rounded(df, digits=6):
    """Rounds every double column; arrays become comma-separated text."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(F.round(name, digits).alias(name))
        elif kind.startswith("array"):
            out.append(F.concat_ws(",", F.col(name).cast("array<string>")).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def mad(a: str, c: str) -> str:
    """SQL for the mean absolute difference of two byte lists."""
    return f"(list_sum(list_transform(list_zip({a}, {c}), lambda z: abs(z[1] - z[2]))) / (len({a}) * 255.0))"


LAG = "lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_no)"
PREV_SQL = f"pv AS (SELECT *, {LAG} AS prv FROM V)"


def scene_sql(a: str, c: str) -> str:
    cdf = (f"(list_sum([abs(len(list_filter({a}, lambda v: v // 8 <= i)) - len(list_filter({c}, lambda w: w // 8 <= i))) "
           f"FOR i IN range(32)]) / (64 * 31.0))")
    return f"least(1.0, {mad(a, c)} * 0.68 + {cdf} * 0.32)"


SCENE_SQL = f"""{PREV_SQL}, sc AS (SELECT clip_id, frame_no, CASE WHEN prv IS NOT NULL THEN {scene_sql('prv', 'luma')} END AS score FROM pv)"""


@query("frame_difference", b.sql("V", f"""{PREV_SQL}
SELECT clip_id, frame_no, round(CASE WHEN prv IS NOT NULL THEN {mad('luma', 'prv')} END, 6) AS difference FROM pv"""))
def frame_difference(spark, sf_dir):
    return rounded(pl.frame_difference(b.planes(spark, sf_dir)).select("clip_id", "frame_no", "difference"))


@query("scene_segments", b.sql("V", f"""{SCENE_SQL}
SELECT clip_id, frame_no, round(score, 6) AS score, coalesce(score >= 0.12, false) AS cut,
  CAST(sum(CASE WHEN score >= 0.12 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_no) AS BIGINT) AS scene_id FROM sc"""))
def scene_segments(spark, sf_dir):
    """The sample planes resemble noise, so the threshold sits inside their score range."""
    out = pl.scene_segments(b.planes(spark, sf_dir), threshold=0.12)
    return rounded(out.select("clip_id", "frame_no", "score", "cut", "scene_id"))


@query("duplicate_flags", b.sql("V", f"""{PREV_SQL},
  s AS (SELECT clip_id, frame_no, luma, sum(CASE WHEN prv IS NOT NULL AND {mad('luma', 'prv')} >= 0.13 THEN 1 ELSE 0 END)
      OVER (PARTITION BY clip_id ORDER BY frame_no) AS scene FROM pv)
SELECT x.clip_id, x.frame_no, coalesce(bool_or({mad('x.luma', 'y.luma')} <= 0.115), false) AS duplicate
FROM s x LEFT JOIN s y ON x.clip_id = y.clip_id AND x.scene = y.scene AND y.frame_no BETWEEN x.frame_no - 3 AND x.frame_no - 1
GROUP BY x.clip_id, x.frame_no"""))
def duplicate_flags(spark, sf_dir):
    out = pl.duplicate_flags(b.planes(spark, sf_dir), look_back=3, threshold=0.115, cut_threshold=0.13)
    return out.select("clip_id", "frame_no", "duplicate")


def _smooth(low, high, x):
    u = f"least(1.0, greatest(0.0, ({x} - {low}) / ({high} - {low})))"
    return f"({u} * {u} * (3 - 2 * {u}))"


@query("temporal_blend_plan", b.sql("V", f"""{PREV_SQL},
  m AS (SELECT clip_id, frame_no, prv, luma, list_sum(luma) / (64 * 255.0) AS mean, list_sum(prv) / (64 * 255.0) AS pmean FROM pv),
  d AS (SELECT *, CASE WHEN prv IS NULL THEN 0.0 ELSE {mad('luma', 'prv')} END AS df FROM m),
  e AS (SELECT *, prv IS NOT NULL AND df >= 0.13 AS cut, prv IS NOT NULL AND df < 0.13 AS act,
    0.9 * 0.2 * (1 - {_smooth(0.012, 0.075, 'df')}) AS db, 0.7 * 0.42 * (1 - {_smooth(0.018, 0.12, 'df')}) AS tb,
    CASE WHEN mean < 0.02 OR df > 0.12 THEN 1.0 ELSE
      least(1 + 0.08 * 0.8, greatest(1 - 0.08 * 0.8, 1 + (pmean / mean - 1) * 0.8)) END AS ex FROM d)
SELECT clip_id, frame_no, round(df, 6) AS difference, cut, round(CASE WHEN act THEN greatest(tb, db) ELSE 0 END, 6) AS blend,
  round(CASE WHEN act THEN db ELSE 0 END, 6) AS detail_blend, round(CASE WHEN act THEN ex ELSE 1 END, 6) AS exposure_correction FROM e"""))
def temporal_blend_plan(spark, sf_dir):
    out = pl.temporal_blend_plan(b.planes(spark, sf_dir), denoise=0.7, anti_flicker=0.8, stability=0.9,
                                 scene_threshold=0.13)
    return rounded(out.select("clip_id", "frame_no", "difference", "cut", "blend", "detail_blend", "exposure_correction"))


def faded(planes):
    """Planes of low contrast: neighbours differ little enough to be blended."""
    return planes.withColumn("luma", F.transform("luma", lambda v: (F.lit(110) + F.floor(v / 6)).cast("int")))


# A frame at a time, each from the blended plane before it.
BLENDED_SQL = b.sql("V", f"""W AS (SELECT clip_id, frame_no, list_transform(luma, lambda v: 110 + v // 6) AS luma FROM V),
  pv AS (SELECT *, lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prv FROM W),
  m AS (SELECT clip_id, frame_no, prv, luma, list_sum(luma) / (64 * 255.0) AS mean, list_sum(prv) / (64 * 255.0) AS pmean FROM pv),
  d AS (SELECT *, CASE WHEN prv IS NULL THEN 0.0 ELSE {mad('luma', 'prv')} END AS df FROM m),
  e AS (SELECT *, prv IS NOT NULL AND df < 0.024 AS act,
    greatest(0.9 * 0.2 * (1 - {_smooth(0.012, 0.024, 'df')}), 1.0 * 0.42 * (1 - {_smooth(0.018, 0.024, 'df')})) AS bl,
    least(1 + 0.08 * 0.8, greatest(1 - 0.08 * 0.8, 1 + (pmean / mean - 1) * 0.8)) - 1 AS sh FROM d),
  st AS MATERIALIZED (SELECT clip_id, frame_no, CASE WHEN act AND bl > 0.001 THEN bl ELSE 0.0 END AS mix,
    list_transform(luma, lambda v: CASE WHEN NOT act OR abs(sh) <= 0.002 THEN v WHEN sh > 0 THEN v * (1 - least(0.08, sh)) + 255 * least(0.08, sh)
      ELSE v * (1 - least(0.08, -sh)) END::DOUBLE) AS x FROM e),
  r AS (SELECT clip_id, frame_no, mix, x AS y FROM st WHERE frame_no = 0
    UNION ALL SELECT st.clip_id, st.frame_no, st.mix, list_transform(list_zip(st.x, r.y), lambda z: (1 - st.mix) * z[1] + st.mix * z[2])
    FROM r JOIN st ON st.clip_id = r.clip_id AND st.frame_no = r.frame_no + 1)
SELECT clip_id, frame_no, round(mix, 6) AS mix, round(list_sum(list_transform(list_zip(range(1, 65), y), lambda z: z[1] * z[2])), 4) AS checksum
FROM r""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("temporal_blend_planes", BLENDED_SQL)
def temporal_blend_planes(spark, sf_dir):
    out = pl.temporal_blend_planes(faded(b.planes(spark, sf_dir)), denoise=1.0, anti_flicker=0.8, stability=0.9, scene_threshold=0.024)
    weighted = F.aggregate(F.transform("blended", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    mix = F.when(F.col("blend") > pl.LEAST_BLEND, F.col("blend")).otherwise(0.0)
    return out.select("clip_id", "frame_no", F.round(mix, 6).alias("mix"), F.round(weighted, 4).alias("checksum"))


# Nearest end, linear blend, or rejection by the guard; quarter times come from a factor-4 plan.
INTERPOLATE_SQL = f"""pr AS (SELECT clip_id, frame_no, luma AS a, lead(luma) OVER (PARTITION BY clip_id ORDER BY frame_no) AS c FROM V),
  g AS (SELECT *, unnest([0, 1, 2, 3]) AS slot FROM pr),
  h AS (SELECT *, slot / 4 AS t, CASE WHEN c IS NOT NULL THEN {scene_sql('a', 'c')} >= 0.14 END AS cut FROM g WHERE slot = 0 OR c IS NOT NULL),
  i AS (SELECT *, CASE WHEN slot > 0 THEN list_transform(list_zip(a, c), lambda z: z[1] + (z[2] - z[1]) * t) END AS bl FROM h),
  j AS (SELECT *, list_transform(bl, lambda v: CAST(floor(v + 0.5) AS INT)) AS q FROM i),
  k AS (SELECT *, CASE WHEN slot = 0 THEN NULL ELSE {mad('a', 'c')} END AS ab, {mad('a', 'q')} AS ac, {mad('c', 'q')} AS bc,
    len(list_filter(q, lambda v: v <= 2 OR v >= 253)) / 64.0 AS clip FROM j),
  l AS (SELECT *, CASE WHEN slot = 0 THEN 'source' WHEN cut THEN 'cut'
    WHEN clip > 0.86 OR (ab < 0.35 AND ac > greatest(0.24, 2.8 * ab + 0.05) AND bc > greatest(0.24, 2.8 * ab + 0.05)) THEN 'rejected'
    ELSE 'blend' END AS mode FROM k)"""


@query("interpolate_vectors", b.sql("V", INTERPOLATE_SQL + """
SELECT clip_id, frame_no * 4 + slot AS out_no, mode, round(list_sum(list_transform(list_zip(range(1, 65), CASE mode
   WHEN 'source' THEN list_transform(a, lambda v: CAST(v AS DOUBLE)) WHEN 'blend' THEN bl
   ELSE list_transform(CASE WHEN t < 0.5 THEN a ELSE c END, lambda v: CAST(v AS DOUBLE)) END), lambda z: z[1] * z[2])), 4) AS checksum FROM l"""))
def interpolate_vectors(spark, sf_dir):
    planes = b.planes(spark, sf_dir)
    out = pl.interpolate_vectors(planes, rt.interpolation_plan(planes, 4), cut_threshold=0.14)
    weighted = F.aggregate(F.transform("value", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return out.select("clip_id", "out_no", "mode", F.round(weighted, 4).alias("checksum"))


@query("artifact_guard", b.sql("V", f"""t AS (SELECT clip_id, frame_no, luma AS a, lead(luma) OVER w AS c, lead(luma, 2) OVER w AS q
    FROM V WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no)),
  d AS (SELECT clip_id, frame_no, {mad('a', 'c')} AS ab, {mad('a', 'q')} AS ac, {mad('c', 'q')} AS bc,
    len(list_filter(q, lambda v: v <= 2 OR v >= 253)) / 64.0 AS cl FROM t WHERE q IS NOT NULL)
SELECT clip_id, frame_no, round(ab, 6) AS endpoint_difference, round(ac, 6) AS first_difference, round(bc, 6) AS second_difference,
  round(cl, 6) AS clipped, NOT (cl > 0.86 OR (ab < 0.35 AND ac > greatest(0.24, 2.8 * ab + 0.05) AND bc > greatest(0.24, 2.8 * ab + 0.05))) AS safe FROM d"""))
def artifact_guard(spark, sf_dir):
    """Triples: a frame, the next one, and the next but one as the candidate."""
    from framelake.operators.ordered import keep_home, local_window, with_halo
    w = local_window(["clip_id"])
    rows = with_halo(b.planes(spark, sf_dir), ["clip_id"], ahead=2)
    rows = rows.withColumn("c", F.lead("luma", 1).over(w)).withColumn("q", F.lead("luma", 2).over(w))
    out = keep_home(rows).where("q is not null").select("clip_id", "frame_no", pl.artifact_guard("luma", "c", "q").alias("g"))
    return rounded(out.select("clip_id", "frame_no", "g.*"))


PIXELS_SQL = """px AS (SELECT clip_id, frame_no, i % 8 AS x, i // 8 AS y, luma[i + 1] AS c, luma[i] AS l, luma[i + 2] AS r,
    luma[i - 7] AS t, luma[i + 9] AS d FROM V, (SELECT unnest(range(64)) AS i))"""
STENCIL_SQL = PIXELS_SQL + """,
  st AS (SELECT *, abs(r - l) + abs(d - t) AS gr, abs(c * 4 - l - r - t - d) AS lap FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)"""

AUDIT_SQL = STENCIL_SQL + """,
  au AS (SELECT clip_id, frame_no, avg(c) / 255 AS mean_luma, avg(CASE WHEN c <= 2 OR c >= 253 THEN 1.0 ELSE 0 END) AS clipping_ratio
     FROM px GROUP BY ALL),
  ed AS (SELECT clip_id, frame_no, sum(abs(c - l) + abs(c - t)) / 72 / 255 AS detail_index, sum(lap) / 36 / 255 AS high_frequency_index
     FROM st GROUP BY ALL),
  audit AS (SELECT * FROM au JOIN ed USING (clip_id, frame_no))"""


@query("frame_audit", b.sql("V", AUDIT_SQL + """
SELECT clip_id, frame_no, round(mean_luma, 6) AS mean_luma, round(clipping_ratio, 6) AS clipping_ratio,
  round(detail_index, 6) AS detail_index, round(high_frequency_index, 6) AS high_frequency_index FROM audit"""))
def frame_audit(spark, sf_dir):
    return rounded(pl.frame_audit(b.planes(spark, sf_dir)))


@query("frame_quality", b.sql("V", STENCIL_SQL + """
SELECT clip_id, frame_no, round(avg(c) / 255, 6) AS exposure,
  round(least(1.5, sqrt(greatest(0, avg(c * c) - avg(c) * avg(c))) / 86), 6) AS contrast,
  round(least(1, sum(CASE WHEN gr < 20 THEN lap ELSE 0 END) / 36 / 20), 6) AS noise,
  round(least(1, sum(gr) / 36 / 68), 6) AS detail,
  round(least(1, sum(CASE WHEN (x % 8 <= 1 OR y % 8 <= 1) AND gr > 12 THEN gr ELSE 0 END) / 36 / 34), 6) AS blocking,
  round(greatest(0, least(1, (count(*) FILTER (gr < 3) / 36 - 0.38) / 0.5)), 6) AS banding,
  round(count(*) FILTER (c <= 4) / 36, 6) AS clipped_shadows, round(count(*) FILTER (c >= 251) / 36, 6) AS clipped_highlights,
  CAST(0.0 AS DOUBLE) AS saturation FROM st GROUP BY clip_id, frame_no"""))
def frame_quality(spark, sf_dir):
    return rounded(pl.frame_quality(b.planes(spark, sf_dir)))


@query("frame_autofix", b.sql("V", STENCIL_SQL + """
SELECT clip_id, frame_no, round(avg(c) / 255, 6) AS exposure,
  round(sqrt(greatest(0, avg(c * c) - avg(c) * avg(c))) / 90, 6) AS contrast, CAST(0.0 AS DOUBLE) AS saturation,
  round(least(1, sum(CASE WHEN gr < 18 THEN lap ELSE 0 END) / 36 / 18), 6) AS noise,
  round(least(1, sum(gr) / 36 / 62), 6) AS detail,
  round(count(*) FILTER (c < 18) / 36, 6) AS clipped_shadows, round(count(*) FILTER (c > 238) / 36, 6) AS clipped_highlights,
  CAST(0.0 AS DOUBLE) AS skin_presence FROM st GROUP BY clip_id, frame_no"""))
def frame_autofix(spark, sf_dir):
    return rounded(pl.frame_autofix(b.planes(spark, sf_dir)))


@query("luma_histogram", b.sql("V", """g AS (SELECT clip_id, frame_no, luma, CAST(unnest(range(32)) AS INT) AS bin FROM V)
SELECT clip_id, frame_no, bin, len(list_filter(luma, lambda v: v // 8 = bin)) AS n,
  len(list_filter(luma, lambda v: v // 8 <= bin)) AS cumulative FROM g"""))
def luma_histogram(spark, sf_dir):
    return pl.luma_histogram(b.planes(spark, sf_dir))


@query("clip_quality_summary", b.sql("V", AUDIT_SQL + """,
  m AS (SELECT clip_id, count(*) AS sampled_frames, avg(clipping_ratio) AS cr, avg(mean_luma) AS ml, avg(detail_index) AS di,
    avg(high_frequency_index) AS hf FROM audit GROUP BY clip_id)
SELECT clip_id, sampled_frames, round(cr, 6) AS clipping_ratio, round(ml, 6) AS mean_luma, round(di, 6) AS detail_index,
  round(hf, 6) AS high_frequency_index, floor(greatest(0, least(100, 100 - cr * 420 - greatest(0, hf - 0.28) * 90
    - greatest(0, 0.1 - ml) * 120 - greatest(0, ml - 0.9) * 120)) + 0.5) AS score,
  concat_ws(',', CASE WHEN cr > 0.035 THEN 'CLIPPING' END, CASE WHEN ml < 0.12 THEN 'TOO_DARK' END,
    CASE WHEN ml > 0.88 THEN 'TOO_BRIGHT' END, CASE WHEN hf > 0.32 THEN 'EXCESS_SHARPNESS_OR_NOISE' END) AS warnings,
  round(cr * 100, 6) AS clipping_percent FROM m"""))
def clip_quality_summary(spark, sf_dir):
    return rounded(pl.clip_quality_summary(pl.frame_audit(b.planes(spark, sf_dir))))


MERGED = ["exposure", "contrast", "noise", "detail", "blocking", "banding", "saturation"]


@query("upper_median", b.sql("M", "SELECT clip_id, " + ", ".join(
    f"round(list_sort(list(coalesce({c}, 0)))[len(list({c})) // 2 + 1], 6) AS {c}" for c in MERGED) + " FROM M GROUP BY clip_id"))
def upper_median(spark, sf_dir):
    return rounded(pl.merge_metrics(b.metrics(spark, sf_dir), MERGED))


@query("noop_stage_report", b.sql("V", """a AS (SELECT clip_id, frame_no, luma,
    CASE WHEN vec_id % 3 = 0 THEN luma ELSE [255 - v FOR v IN luma] END AS after FROM V)
SELECT clip_id, frame_no FROM a WHERE luma = after"""))
def noop_stage_report(spark, sf_dir):
    before = b.planes(spark, sf_dir)
    after = before.withColumn("luma", F.when(F.col("vec_id") % 3 == 0, F.col("luma")).otherwise(
        F.transform("luma", lambda v: F.lit(255) - v)))
    return pl.noop_stage_report(before, after).select("clip_id", "frame_no")


# ---- motion -------------------------------------------------------------------------------

SHIFT_SQL = f"""{PREV_SQL},
  cand AS (SELECT clip_id, frame_no, dy, dx, abs(prv[3 * 8 + 3 + 1] - luma[(3 + dy) * 8 + 3 + dx + 1]) / 255.0 AS e
    FROM pv, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE prv IS NOT NULL),
  best AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_no ORDER BY e, dy, dx) AS rk FROM cand)"""


@query("global_shift", b.sql("V", SHIFT_SQL + """
SELECT clip_id, frame_no, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(e, 6) AS normalized_error FROM best WHERE rk = 1"""))
def global_shift(spark, sf_dir):
    out = mo.global_shift(b.planes(spark, sf_dir), radius=1)
    return rounded(out.select("clip_id", "frame_no", "dx", "dy", "normalized_error"))


FIELD_SQL = f"""{PREV_SQL},
  blocks AS (SELECT unnest([3, 4]) AS cy), cells AS (SELECT a.cy, c.cy AS cx FROM blocks a, blocks c),
  e AS (SELECT clip_id, frame_no, cy, cx, dy, dx, avg(abs(prv[(cy + y) * 8 + cx + x + 1] - luma[(cy + y + dy) * 8 + cx + x + dx + 1])) AS err
    FROM pv, cells, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx),
      (SELECT unnest([-2, 0]) AS y), (SELECT unnest([-2, 0]) AS x) WHERE prv IS NOT NULL GROUP BY ALL),
  bst AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_no, cy, cx ORDER BY err, dy, dx) AS rk FROM e),
  vec AS (SELECT *, greatest(0, least(1, 1 - err / 48)) AS conf, count(*) FILTER (greatest(0, least(1, 1 - err / 48)) >= 0.18)
     OVER (PARTITION BY clip_id, frame_no) AS good FROM bst WHERE rk = 1),
  pool AS (SELECT * FROM vec WHERE good < 3 OR conf >= 0.18),
  fld AS (SELECT clip_id, frame_no, median(dx) AS global_dx, median(dy) AS global_dy, avg(conf) AS confidence,
     avg(sqrt(dx * dx + dy * dy)) AS motion FROM pool GROUP BY ALL)"""


@query("motion_field", b.sql("V", FIELD_SQL + """
SELECT V.clip_id, V.frame_no, fld.clip_id IS NOT NULL AS ready, round(coalesce(CAST(global_dx AS DOUBLE), 0), 9) AS global_dx,
  round(coalesce(CAST(global_dy AS DOUBLE), 0), 9) AS global_dy, round(coalesce(confidence, 0), 9) AS confidence,
  round(coalesce(motion, 0), 9) AS motion FROM V LEFT JOIN fld ON V.clip_id = fld.clip_id AND V.frame_no = fld.frame_no"""))
def motion_field(spark, sf_dir):
    out = mo.motion_field(b.planes(spark, sf_dir), block=1, radius=1)
    return rounded(out.select("clip_id", "frame_no", "ready", "global_dx", "global_dy", "confidence", "motion"), 9)


# Up to three blended planes are carried along, the oldest first; missing ones weigh nothing.
HISTORY_SQL = b.sql("V", FIELD_SQL + """,
  al AS (SELECT V.clip_id, V.frame_no, list_transform(luma, lambda v: CAST(v AS DOUBLE)) AS x, coalesce(confidence, 0) > 0.12 AS sure,
    least(0.32::DOUBLE, 0.28::DOUBLE * greatest(0, 1 - coalesce(motion, 0) / 3.0) * coalesce(confidence, 0)) AS base
    FROM V LEFT JOIN fld ON V.clip_id = fld.clip_id AND V.frame_no = fld.frame_no),
  st AS MATERIALIZED (SELECT clip_id, frame_no, x, frame_no > 0 AND sure AND base > 0.002 AS applied, base FROM al),
  wt AS MATERIALIZED (SELECT *, CASE WHEN applied AND frame_no >= 3 THEN base / 3 ELSE 0 END AS a1, CASE WHEN applied AND frame_no >= 2 THEN base / 2 ELSE 0 END AS a2,
    CASE WHEN applied THEN base ELSE 0 END AS a3 FROM st),
  r AS (SELECT clip_id, frame_no, applied, x AS o1, x AS o2, x AS o3 FROM wt WHERE frame_no = 0
    UNION ALL SELECT wt.clip_id, wt.frame_no, wt.applied, r.o2, r.o3, list_transform(list_zip(wt.x, r.o1, r.o2, r.o3), lambda z:
      ((z[1] * (1 - wt.a1) + z[2] * wt.a1) * (1 - wt.a2) + z[3] * wt.a2) * (1 - wt.a3) + z[4] * wt.a3)
    FROM r JOIN wt ON wt.clip_id = r.clip_id AND wt.frame_no = r.frame_no + 1)
SELECT clip_id, frame_no, applied, round(list_sum(o3), 4) AS checksum FROM r""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("history_blend", HISTORY_SQL)
def history_blend(spark, sf_dir):
    fields = mo.motion_field(b.planes(spark, sf_dir), block=1, radius=1, vectors=False)
    out = mo.history_blend(fields, strength=1.0)
    total = F.aggregate("blended", F.lit(0.0), lambda acc, v: acc + v)
    return out.select("clip_id", "frame_no", "applied", F.round(total, 4).alias("checksum"))


@query("stabilize_path", b.sql("T", """sh AS (SELECT clip_id, frame_no, (event_id * 7) % 11 - 5 AS dx, (event_id * 5) % 7 - 3 AS dy,
    (event_id % 23) / 100.0 AS er FROM T),
  mv AS (SELECT *, frame_no > 0 AND er > 0.2 AS cut FROM sh),
  runs AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_no) AS run FROM mv),
  path AS (SELECT *, sum(CASE WHEN cut OR frame_no = 0 THEN 0 ELSE dx * 4 END) OVER w AS cx,
     sum(CASE WHEN cut OR frame_no = 0 THEN 0 ELSE dy * 4 END) OVER w AS cy,
     row_number() OVER w AS k FROM runs WINDOW w AS (PARTITION BY clip_id, run ORDER BY frame_no)),
  sm AS (SELECT p.clip_id, p.frame_no, any_value(p.cut) AS cut, any_value(p.cx) AS cx, any_value(p.cy) AS cy,
     sum(q.cx * 0.12 * pow(0.88, p.k - q.k)) AS sx, sum(q.cy * 0.12 * pow(0.88, p.k - q.k)) AS sy
     FROM path p JOIN path q ON p.clip_id = q.clip_id AND p.run = q.run AND q.k <= p.k GROUP BY p.clip_id, p.frame_no)
SELECT clip_id, frame_no, cut AS scene_cut,
  round(CASE WHEN cut OR frame_no = 0 THEN 0 ELSE (sx - cx) * 0.55 END, 5) AS correction_x,
  round(CASE WHEN cut OR frame_no = 0 THEN 0 ELSE (sy - cy) * 0.55 END, 5) AS correction_y,
  CASE WHEN NOT cut AND frame_no > 0 THEN CAST(round(1 + 0.035 * 0.55, 6) AS DOUBLE) END AS zoom,
  CASE WHEN cut OR frame_no = 0 THEN false ELSE abs(sx - cx) * 0.55 > 0.05 OR abs(sy - cy) * 0.55 > 0.05 END AS applied FROM sm"""))
def stabilize_path(spark, sf_dir):
    first = F.col("frame_no") == 0
    shifts = b.timelines(spark, sf_dir).select(
        "clip_id", "frame_no", ((F.col("event_id") * 7) % 11 - 5).alias("dx"), ((F.col("event_id") * 5) % 7 - 3).alias("dy"),
        F.when(~first, (F.col("event_id") % 23) / F.lit(100.0)).alias("normalized_error"))
    out = mo.stabilize_path(shifts, scale_x=4.0, scale_y=4.0)
    return out.select("clip_id", "frame_no", "scene_cut", F.round("correction_x", 5).alias("correction_x"),
                      F.round("correction_y", 5).alias("correction_y"), F.round("zoom", 6).alias("zoom"), "applied")


# ---- audio --------------------------------------------------------------------------------

RMS_SQL = "sqrt(list_sum(list_transform(samples, lambda x: x * x)) / 64)"


@query("audio_block_stats", b.sql("A", f"""s AS (SELECT clip_id, {RMS_SQL} AS rms, list_max(list_transform(samples, lambda x: abs(x))) AS pk,
    len(list_filter(samples, lambda x: abs(x) > pow(10.0, -10.0 / 20))) AS cl FROM A)
SELECT clip_id, count(*) AS blocks, CAST(count(*) * 64 AS BIGINT) AS frames, round(sqrt(avg(rms * rms)), 6) AS average_rms,
  round(max(pk), 6) AS peak, CAST(sum(cl) AS BIGINT) AS clipped_samples FROM s GROUP BY clip_id"""))
def audio_block_stats(spark, sf_dir):
    return rounded(au.audio_block_stats(b.audio_blocks(spark, sf_dir), limiter_db=-10))


@query("peak_normalize", b.sql("A", """p AS (SELECT clip_id, max(list_max(list_transform(samples, lambda x: abs(x)))) AS pk FROM A GROUP BY clip_id)
SELECT A.clip_id, block_no, round(pk, 6) AS clip_peak, round(pow(10.0, -1.5 / 20) / pk, 6) AS gain,
  round(list_sum(list_transform(list_zip(range(1, 65), samples), lambda z: z[1] * greatest(-1.0, least(1.0, z[2] * pow(10.0, -1.5 / 20) / pk)))), 5) AS checksum
FROM A JOIN p ON A.clip_id = p.clip_id"""))
def peak_normalize(spark, sf_dir):
    out = au.peak_normalize(b.audio_blocks(spark, sf_dir))
    total = F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return out.select("clip_id", "block_no", F.round("clip_peak", 6).alias("clip_peak"), F.round("gain", 6).alias("gain"),
                      F.round(total, 5).alias("checksum"))


@query("av_drift", b.sql("AC", """sp AS (SELECT clip_id AS track, (max(ts_us + 1000000) - arg_min(ts_us, block_no)) / 1e6 AS au FROM A GROUP BY clip_id),
  j AS (SELECT C.clip_id, has_audio, duration_s, greatest(0.12, least(0.5, duration_s * 0.0025)) AS tol, au,
    CASE WHEN NOT has_audio THEN 'no-audio' WHEN au > 0 THEN 'decoded-audio-timeline' ELSE 'container-duration-only' END AS mode
    FROM C LEFT JOIN sp ON C.clip_id % 20 = sp.track),
  d AS (SELECT *, CASE mode WHEN 'no-audio' THEN 0.0 WHEN 'decoded-audio-timeline' THEN au - duration_s END AS dr FROM j)
SELECT clip_id, mode, CASE WHEN mode = 'decoded-audio-timeline' THEN round(au, 6) END AS measured_audio_s, round(dr, 6) AS drift_s,
  round(tol, 6) AS tolerance_s, coalesce(abs(dr) <= tol, true) AS valid FROM d"""))
def av_drift(spark, sf_dir):
    clips = b.clips(spark, sf_dir).withColumn("track", F.col("clip_id") % 20)
    out = au.av_drift(clips, b.audio_blocks(spark, sf_dir), key="track")
    return rounded(out.select("clip_id", "mode", "measured_audio_s", "drift_s", "tolerance_s", "valid"))


GAIN_SQL = f"""r AS (SELECT clip_id, block_no, samples, {RMS_SQL} AS rms FROM A),
  l AS (SELECT clip_id, list(rms ORDER BY block_no) AS rs FROM r GROUP BY clip_id),
  g AS (SELECT r.clip_id, r.block_no, r.samples, r.rms, list_reduce(rs[1:r.block_no + 1], lambda a, x:
      CASE WHEN x > pow(10.0, -18.6 / 20) THEN a + (greatest(0.35, least(4.0, pow(10.0, -16 / 20.0) / x)) - a)
        * (CASE WHEN greatest(0.35, least(4.0, pow(10.0, -16 / 20.0) / x)) < a THEN 0.28 ELSE 0.035 END) ELSE a END, CAST(1.0 AS DOUBLE)) AS gain
    FROM r JOIN l ON r.clip_id = l.clip_id)"""


@query("adaptive_gain", b.sql("A", GAIN_SQL + """
SELECT clip_id, block_no, round(rms, 6) AS block_rms, round(gain, 6) AS gain,
  CAST(len(list_filter(samples, lambda x: abs(x * gain) > pow(10.0, -10.0 / 20))) AS INT) AS clipped_samples,
  round(list_max(list_transform(samples, lambda x: least(pow(10.0, -10.0 / 20), abs(x * gain)))), 6) AS peak FROM g"""))
def adaptive_gain(spark, sf_dir):
    out = au.adaptive_gain(b.audio_blocks(spark, sf_dir), gate_db=-18.6, limiter_db=-10)
    return rounded(out.select("clip_id", "block_no", "block_rms", "gain", "clipped_samples", "peak"))


SAMPLES_SQL = """f AS (SELECT clip_id, block_no, unnest(samples) AS x, generate_subscripts(samples, 1) AS i FROM A),
  n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY block_no, i) AS n FROM f)"""
CHECKSUM_SQL = "SELECT clip_id, block_no, CAST(0 AS INT) AS channel, round(sum(y * i), 6) AS checksum FROM out GROUP BY clip_id, block_no"
# 64 samples a second, one channel; a sample at a time.
FILTERED_SQL = SAMPLES_SQL + """,
  k AS (SELECT 1 / (1 + 2 * pi() * 70.0 / 64) AS a, 1 - exp(-2 * pi() * 64 * 0.48 / 64) AS b, pow(10.0, -20 / 20.0) AS gate,
    1 - exp(-1 / (64 * 0.006)) AS attack, 1 - exp(-1 / (64 * 0.09)) AS release),
  h AS (SELECT n.*, k.a * (x - 0.0) AS high, k.b * (k.a * (x - 0.0)) AS low FROM n, k WHERE n = 1
    UNION ALL SELECT n.*, k.a * h.high + k.a * (n.x - h.x), (1 - k.b) * h.low + k.b * (k.a * h.high + k.a * (n.x - h.x))
    FROM h JOIN n ON n.clip_id = h.clip_id AND n.n = h.n + 1, k),
  g AS (SELECT h.clip_id, h.n, h.block_no, h.i, h.low, CASE WHEN abs(low) >= gate THEN (1 - attack) + attack ELSE (1 - release) + release * 0.82 END AS level
    FROM h, k WHERE n = 1
    UNION ALL SELECT h.clip_id, h.n, h.block_no, h.i, h.low, CASE WHEN abs(h.low) >= gate THEN (1 - attack) * g.level + attack
      ELSE (1 - release) * g.level + release * 0.82 END FROM g JOIN h ON h.clip_id = g.clip_id AND h.n = g.n + 1, k),
  out AS (SELECT *, low * level AS y FROM g)
"""
FILTER_SQL = b.sql("A", FILTERED_SQL + CHECKSUM_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


@query("audio_filter_chain", FILTER_SQL)
def audio_filter_chain(spark, sf_dir):
    out = au.audio_filter_chain(b.audio_blocks(spark, sf_dir), gate_db=-20)
    total = F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return out.select("clip_id", "block_no", "channel", F.round(total, 6).alias("checksum"))


NOISE_GATE_SQL = b.sql("A", SAMPLES_SQL + """,
  w AS (SELECT *, CASE WHEN abs(x) >= pow(10.0, -20 / 20.0) THEN 1.0 ELSE 0.0 END AS t FROM n),
  g AS (SELECT clip_id, n, block_no, i, x, CASE WHEN t = 1 THEN 1.0::DOUBLE ELSE (1 - 1 / 5.0::DOUBLE) END AS level FROM w WHERE n = 1
    UNION ALL SELECT w.clip_id, w.n, w.block_no, w.i, w.x, CASE WHEN w.t = 1 THEN 1.0::DOUBLE ELSE (1 - 1 / 5.0::DOUBLE) * g.level END
    FROM g JOIN w ON w.clip_id = g.clip_id AND w.n = g.n + 1),
  out AS (SELECT *, x * level AS y FROM g)
""" + CHECKSUM_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


@query("noise_gate", NOISE_GATE_SQL)
def noise_gate(spark, sf_dir):
    out = au.noise_gate(b.audio_blocks(spark, sf_dir), threshold_db=-20)
    total = F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return out.select("clip_id", "block_no", "channel", F.round(total, 6).alias("checksum"))
