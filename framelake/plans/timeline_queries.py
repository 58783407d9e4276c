"""Registered timeline queries on the events binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import timeline as tl
from framelake.plans import bindings as b
from framelake.plans.registry import query
from framelake.sources.catalog import read_timeline

STEP = b.NOMINAL_STEP_US

STEPS_SQL = """steps AS (SELECT clip_id, frame_no, pts_us,
    pts_us - lag(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no) AS d FROM T)"""

MISSING_SQL = f"""CASE WHEN d > {STEP} * 1.5 THEN greatest(1.0, floor(d / CAST({STEP} AS DOUBLE) + 0.5) - 1) ELSE 0 END"""

PACING_SQL = f"""SELECT clip_id, count(*) AS frames, count(*) FILTER (d <= 0) AS non_monotonic,
    count(*) FILTER (d > 0 AND abs(d - {STEP}) > {STEP} * 0.08) AS irregular,
    CAST(sum({MISSING_SQL}) AS BIGINT) AS missing,
    min(d) FILTER (d > 0) AS min_delta_us, max(d) FILTER (d > 0) AS max_delta_us
  FROM steps GROUP BY clip_id"""

GAPS_SQL = """ends AS (SELECT clip_id, frame_no, pts_us, dur_us,
    max(pts_us + dur_us) OVER (PARTITION BY clip_id ORDER BY frame_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
    lag(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prev_pts FROM T),
  gaps AS (SELECT clip_id, count(*) AS decoded, count(*) FILTER (pts_us > prev_end + 2500) AS source_gaps,
    CAST(coalesce(sum(pts_us - prev_end) FILTER (pts_us > prev_end + 2500), 0) AS BIGINT) AS source_gap_us,
    count(*) FILTER (pts_us < prev_pts) AS source_non_monotonic FROM ends GROUP BY clip_id)"""


@query("clip_pacing_and_gap_audit", b.sql("T", f"""{STEPS_SQL}, {GAPS_SQL}, pacing AS ({PACING_SQL}),
  judged AS (SELECT pacing.*, gaps.source_gaps, gaps.source_gap_us, gaps.source_non_monotonic,
    CASE WHEN frames > 1 THEN irregular / CAST(frames - 1 AS DOUBLE) ELSE 0 END AS ratio
    FROM pacing JOIN gaps USING (clip_id))
SELECT clip_id, frames, non_monotonic, irregular, missing, min_delta_us, max_delta_us,
  round(ratio, 6) AS irregular_ratio,
  (non_monotonic = 0 AND missing = 0 AND ratio <= 0.02) AS valid, source_gaps, source_gap_us, source_non_monotonic,
  CASE WHEN source_non_monotonic > 0 THEN 'source_order'
       WHEN NOT (non_monotonic = 0 AND missing = 0 AND ratio <= 0.02) THEN 'pacing'
       WHEN source_gaps > 0 THEN 'gaps' ELSE 'ok' END AS verdict
FROM judged"""))
def clip_pacing_and_gap_audit(spark, sf_dir):
    return (tl.clip_audit(b.timelines(spark, sf_dir), STEP)
            .withColumn("irregular_ratio", F.round("irregular_ratio", 6)))


@query("read_timeline", b.sql("T", """R AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s FROM events),
  U AS (SELECT user_id AS clip_id, event_id, CAST(greatest(0, floor(s * 1000000 + 0.5)) AS BIGINT) AS u FROM R)
SELECT clip_id, event_id AS arrival,
  greatest(0, u - first_value(u) OVER (PARTITION BY clip_id ORDER BY event_id)) AS pts_us,
  CAST(3600000000 AS BIGINT) AS dur_us FROM U"""))
def read_timeline_query(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts_s"),
        F.lit(3600.0).alias("dur_s"))
    return read_timeline(events, clip="user_id", arrival="event_id", seconds="ts_s", duration="dur_s")


@query("ordered_timeline", b.sql("T", """SELECT clip_id, frame_no, event_id, pts_us,
  row_number() OVER (PARTITION BY clip_id ORDER BY pts_us DESC, frame_no) - 1 AS order_no FROM T"""))
def ordered_timeline_query(spark, sf_dir):
    frames = b.timelines(spark, sf_dir).withColumn("pts_us", -F.col("pts_us"))
    return (tl.ordered_timeline(frames).withColumn("pts_us", -F.col("pts_us"))
            .select("clip_id", "frame_no", "event_id", "pts_us", "order_no"))


@query("pacing_report", b.sql("T", f"""{STEPS_SQL}, pacing AS ({PACING_SQL})
SELECT pacing.*, round(CASE WHEN frames > 1 THEN irregular / CAST(frames - 1 AS DOUBLE) ELSE 0 END, 6) AS irregular_ratio,
  (non_monotonic = 0 AND missing = 0
   AND (CASE WHEN frames > 1 THEN irregular / CAST(frames - 1 AS DOUBLE) ELSE 0 END) <= 0.02) AS valid FROM pacing"""))
def pacing_report(spark, sf_dir):
    return (tl.pacing_report(b.timelines(spark, sf_dir), STEP)
            .withColumn("irregular_ratio", F.round("irregular_ratio", 6)))


@query("source_gap_report", b.sql("T", f"{GAPS_SQL} SELECT * FROM gaps"))
def source_gap_report(spark, sf_dir):
    return tl.source_gap_report(b.timelines(spark, sf_dir))


@query("output_gap_report", b.sql("T", f"""{STEPS_SQL}
SELECT clip_id, count(*) AS encoded, count(*) FILTER (d <= 0) AS output_non_monotonic,
  CAST(sum({MISSING_SQL}) AS BIGINT) AS output_missing FROM steps GROUP BY clip_id"""))
def output_gap_report(spark, sf_dir):
    return tl.output_gap_report(b.timelines(spark, sf_dir), STEP)


@query("frame_accounting", b.sql("T", f"""{GAPS_SQL},
  span AS (SELECT clip_id, max(pts_us + dur_us) - min(pts_us) AS span_us FROM T GROUP BY clip_id),
  done AS (SELECT clip_id, count(*) AS processed FROM T WHERE kind <> 'error' GROUP BY clip_id),
  enc AS (SELECT clip_id, frame_no, pts_us - lag(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no) AS d
          FROM T WHERE kind <> 'signup'),
  outp AS (SELECT clip_id, count(*) AS encoded, count(*) FILTER (d <= 0) AS output_non_monotonic,
    CAST(sum({MISSING_SQL}) AS BIGINT) AS output_missing FROM enc GROUP BY clip_id),
  j AS (SELECT clip_id, coalesce(decoded, 0) AS decoded, coalesce(processed, 0) AS processed,
    coalesce(encoded, 0) AS encoded, coalesce(source_gaps, 0) AS source_gaps,
    coalesce(source_gap_us, 0) AS source_gap_us, coalesce(source_non_monotonic, 0) AS source_non_monotonic,
    coalesce(output_non_monotonic, 0) AS output_non_monotonic, coalesce(output_missing, 0) AS output_missing,
    coalesce(span_us, 0) AS span_us
    FROM gaps FULL JOIN span USING (clip_id) FULL JOIN done USING (clip_id) FULL JOIN outp USING (clip_id)),
  e AS (SELECT *, concat_ws(',', CASE WHEN decoded = 0 THEN 'no_decoded' END,
    CASE WHEN processed <> decoded THEN 'frame_loss' END, CASE WHEN encoded = 0 THEN 'no_encoded' END,
    CASE WHEN output_non_monotonic > 0 OR output_missing > 0 THEN 'output_integrity' END,
    CASE WHEN source_non_monotonic > 0 THEN 'source_order' END,
    CASE WHEN span_us > 0 AND encoded + 1 < greatest(1, floor((span_us - 1) / CAST({STEP} AS DOUBLE)) + 1)
         THEN 'short_count' END) AS errors FROM j)
SELECT *, CASE WHEN errors = '' THEN NULL ELSE split_part(errors, ',', 1) END AS first_error, errors = '' AS valid FROM e"""))
def frame_accounting(spark, sf_dir):
    frames = b.timelines(spark, sf_dir)
    encoded = frames.where("kind <> 'signup'")
    encoded = tl.ordered_timeline(encoded).drop("frame_no").withColumnRenamed("order_no", "frame_no")
    out = tl.frame_accounting(frames, frames.where("kind <> 'error'"), encoded, STEP)
    return out.withColumn("errors", F.concat_ws(",", "errors"))


@query("estimate_fps", b.sql("T", """steps AS (SELECT clip_id,
    (pts_us - lag(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no)) / 1e6 AS s FROM T),
  pos AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY s) - 1 AS i,
    count(*) OVER (PARTITION BY clip_id) AS n FROM steps WHERE s > 0),
  med AS (SELECT clip_id, s AS m FROM pos WHERE i = n // 2),
  span AS (SELECT clip_id, min(s) AS lo, max(s) AS hi FROM pos GROUP BY clip_id)
SELECT f.clip_id, f.frames, round(m, 6) AS median_step_s,
  CASE WHEN m IS NULL THEN 30.0 ELSE greatest(1.0, least(240.0, floor(1 / m * 1000 + 0.5) / 1000)) END AS fps,
  round(1 / hi * 1e6, 6) AS min_fps_micro, round(1 / lo * 1e6, 3) AS max_fps_micro, lo <> hi AS variable_frame_rate
FROM (SELECT clip_id, count(*) AS frames FROM T GROUP BY clip_id) f
LEFT JOIN med ON f.clip_id = med.clip_id LEFT JOIN span ON f.clip_id = span.clip_id"""))
def estimate_fps(spark, sf_dir):
    out = tl.estimate_fps(b.timelines(spark, sf_dir))
    return out.select("clip_id", "frames", F.round("median_step_s", 6).alias("median_step_s"), "fps",
                      F.round(F.col("min_fps") * 1e6, 6).alias("min_fps_micro"),
                      F.round(F.col("max_fps") * 1e6, 3).alias("max_fps_micro"), "variable_frame_rate")


@query("rolling_rate", b.sql("T", """ms AS (SELECT clip_id, frame_no, pts_us / 36000000.0 AS ms FROM T),
  d AS (SELECT *, ms - lag(ms) OVER (PARTITION BY clip_id ORDER BY frame_no) AS raw FROM ms),
  v AS (SELECT *, CASE WHEN raw > 0 AND raw < 5000 THEN raw END AS delta FROM d),
  n AS (SELECT *, count(delta) OVER (PARTITION BY clip_id ORDER BY frame_no) AS k FROM v),
  r AS (SELECT clip_id, k, avg(delta) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m
        FROM n WHERE delta IS NOT NULL)
SELECT n.clip_id, n.frame_no, round(m, 6) AS frame_time_ms, round(1000 / m, 6) AS fps
FROM n LEFT JOIN r ON n.clip_id = r.clip_id AND n.k = r.k"""))
def rolling_rate(spark, sf_dir):
    out = tl.rolling_rate(b.timelines(spark, sf_dir), F.col("pts_us") / F.lit(36000000.0))
    return out.select("clip_id", "frame_no", F.round("frame_time_ms", 6).alias("frame_time_ms"),
                      F.round("fps", 6).alias("fps"))


@query("progress_eta", b.sql("T", """p AS (SELECT clip_id, frame_no,
    max(least(1.0, value / 500)) OVER (PARTITION BY clip_id ORDER BY frame_no) AS progress,
    (pts_us - first_value(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no)) / 1e6 AS elapsed_s FROM T)
SELECT clip_id, frame_no, round(progress, 6) AS progress, round(elapsed_s, 6) AS elapsed_s,
  round(CASE WHEN progress > 0 THEN greatest(0.0, elapsed_s / greatest(0.005, progress) * (1 - greatest(0.005, progress))) END, 4) AS remaining_s,
  round(CASE WHEN progress > 0 THEN progress / greatest(0.001, elapsed_s) END, 6) AS speed FROM p"""))
def progress_eta(spark, sf_dir):
    out = tl.progress_eta(b.timelines(spark, sf_dir), F.col("value") / 500)
    return out.select("clip_id", "frame_no", F.round("progress", 6).alias("progress"),
                      F.round("elapsed_s", 6).alias("elapsed_s"), F.round("remaining_s", 4).alias("remaining_s"),
                      F.round("speed", 6).alias("speed"))


HYSTERESIS_SQL = """h AS (SELECT clip_id, frame_no, pts_us, coalesce(last_value(
      CASE WHEN status >= 4 THEN 1 WHEN status <= 2 THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cur FROM T),
  e AS (SELECT *, coalesce(lag(cur) OVER (PARTITION BY clip_id ORDER BY frame_no), 0) AS was FROM h)"""


@query("hysteresis_transitions", b.sql("T", HYSTERESIS_SQL + """
SELECT clip_id, frame_no, pts_us, CASE WHEN cur = 1 THEN 'autopause' ELSE 'autoresume' END AS action
FROM e WHERE cur <> was"""))
def hysteresis_transitions(spark, sf_dir):
    return tl.hysteresis_transitions(b.telemetry(spark, sf_dir))


@query("hysteresis_intervals", b.sql("T", HYSTERESIS_SQL + """,
  c AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) AS k FROM e WHERE cur <> was),
  p AS (SELECT *, lead(pts_us) OVER (PARTITION BY clip_id ORDER BY k) AS nxt FROM c)
SELECT clip_id, CAST((k + 1) // 2 AS BIGINT) AS interval_no, pts_us AS start_us, nxt AS end_us FROM p WHERE cur = 1"""))
def hysteresis_intervals(spark, sf_dir):
    return tl.hysteresis_intervals(b.telemetry(spark, sf_dir))


@query("preflight_action", b.sql("T", """SELECT CASE WHEN status >= 4 THEN 'wait' WHEN status >= 3 THEN
  'reduce-concurrency' ELSE 'continue' END AS action, count(*) AS n FROM T GROUP BY 1"""))
def preflight_action(spark, sf_dir):
    status = b.table(spark, sf_dir, "events").select(F.least(F.lit(5), F.floor(F.col("value") / 25)).alias("status"))
    return status.groupBy(tl.preflight_action("status").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_and_hold", b.sql("T", """SELECT clip_id, frame_no, last_value(CASE WHEN frame_no % 5 = 0 THEN value END IGNORE NULLS)
  OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM T"""))
def sample_and_hold(spark, sf_dir):
    return (tl.sample_and_hold(b.timelines(spark, sf_dir), F.col("value"), 5)
            .select("clip_id", "frame_no", "held"))


@query("resource_summary", b.sql("T", """SELECT clip_id, max(frame_no) AS frames, count(*) FILTER (frame_no % 10 = 0) AS samples,
  round(arg_min(heap_ratio, frame_no), 6) AS start_heap, round(arg_max(heap_ratio, frame_no), 6) AS end_heap,
  round(greatest(arg_min(heap_ratio, frame_no), max(heap_ratio) FILTER (frame_no % 10 = 0)), 6) AS peak_heap,
  round(arg_max(heap_ratio, frame_no) - arg_min(heap_ratio, frame_no), 6) AS heap_growth,
  CAST(max(codec_queue) AS BIGINT) AS peak_queue FROM T GROUP BY clip_id"""))
def resource_summary(spark, sf_dir):
    out = tl.resource_summary(b.telemetry(spark, sf_dir), every=10)
    return out.select("clip_id", "frames", "samples", *[
        F.round(c, 6).alias(c) for c in ("start_heap", "end_heap", "peak_heap", "heap_growth")], "peak_queue")


PRESSURE_SQL = """q AS (SELECT clip_id, frame_no, greatest(heap_ratio,
      least(1.5, greatest(codec_queue / 4.0, write_backlog / 4.0) / 1.5)) AS score FROM T
    WHERE frame_no <= 0 OR frame_no % 2 = 0),
  tiers AS (SELECT *, CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.72 THEN 'HIGH'
    WHEN score >= 0.55 THEN 'ELEVATED' ELSE 'NORMAL' END AS tier FROM q)"""


@query("pressure_tier", b.sql("T", PRESSURE_SQL + """
SELECT clip_id, frame_no, round(score, 6) AS score, tier, tier = 'CRITICAL' AS force_yield FROM tiers"""))
def pressure_tier(spark, sf_dir):
    out = tl.pressure_tier(b.telemetry(spark, sf_dir), every=2, plan_queue=4, plan_backlog=4)
    return out.select("clip_id", "frame_no", F.round("score", 6).alias("score"), "tier", "force_yield")


@query("recent_actions", b.sql("T", PRESSURE_SQL + """,
  r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no DESC) AS action_rank FROM tiers WHERE tier <> 'NORMAL')
SELECT clip_id, frame_no, floor(score * 1000 + 0.5) / 1000 AS score, tier, action_rank FROM r WHERE action_rank <= 8"""))
def recent_actions(spark, sf_dir):
    pressure = tl.pressure_tier(b.telemetry(spark, sf_dir), every=2, plan_queue=4, plan_backlog=4)
    return (tl.recent_actions(pressure, 8)
            .select("clip_id", "frame_no", "score", "tier", "action_rank"))
