"""Registered streaming queries: the sample tables are read as streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.plans import bindings as b
from framelake.plans.plane_queries import FILTERED_SQL, SCENE_SQL, mad, rounded
from framelake.plans.registry import query
from framelake.plans.retime_queries import GRID_US, RESAMPLE_SQL
from framelake.plans.timeline_queries import GAPS_SQL, HYSTERESIS_SQL, MISSING_SQL, PACING_SQL, STEPS_SQL
from framelake.session import fresh_dir
from framelake.streaming import streams as sm

STEP = b.NOMINAL_STEP_US
WEEK_MS = 7 * 86_400_000


def _source(spark, sf_dir, name):
    """One table as a file stream with the table's own schema: one file, or a folder of part files.

    All files make one trigger: part files are in no order of time, and a later trigger would find its rows behind the watermark.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(b.table(spark, sf_dir, name).schema)
    if files.getFileStatus(path).isDirectory():
        return stream.parquet(f"{sf_dir}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _frames(spark, sf_dir):
    return _as_frames(_source(spark, sf_dir, "events"))


def _as_frames(events):
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").alias("clip_id"), "event_id", F.unix_micros(ts).alias("pts_us"), F.lit(3_600_000_000).cast("bigint").alias("dur_us"),
        F.least(F.lit(5), F.floor(F.col("value") / 25)).cast("int").alias("status"), "value", ts.alias("event_time"))


def _planes(spark, sf_dir):
    luma = F.transform("embedding", lambda x: F.floor(
        F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x.cast("double") + 0.6) / 1.2 * 255.0)) + 0.5).cast("int"))
    return _source(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("clip_id"), "vec_id", luma.alias("luma"))


@query("stream_pacing", b.sql("T", f"{STEPS_SQL}, pacing AS ({PACING_SQL}) SELECT * FROM pacing"))
def stream_pacing(spark, sf_dir):
    rows = sm.stream_pacing(_frames(spark, sf_dir), STEP, order=("pts_us", "event_id"))
    return sm.latest(sm.run_available(rows, "pacing", "update"))


@query("stream_integrity", b.sql("T", f"""{STEPS_SQL}, {GAPS_SQL}, o AS (SELECT clip_id, count(*) FILTER (d <= 0) AS output_non_monotonic,
  CAST(sum({MISSING_SQL}) AS BIGINT) AS output_missing FROM steps GROUP BY clip_id)
SELECT * FROM gaps JOIN o USING (clip_id)"""))
def stream_integrity(spark, sf_dir):
    rows = sm.stream_integrity(_frames(spark, sf_dir), STEP, order=("pts_us", "event_id"))
    return sm.latest(sm.run_available(rows, "integrity", "update"))


@query("stream_seeded_pacing", b.sql("T", f"{STEPS_SQL}, pacing AS ({PACING_SQL}) SELECT clip_id, frames + 100 AS frames, missing FROM pacing"))
def stream_seeded_pacing(spark, sf_dir):
    """Continues a count of 100 frames per clip kept elsewhere."""
    seeds = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct().select(
        "clip_id", F.lit(100).alias("frames"), F.lit(None).cast("bigint").alias("last_us"))
    rows = sm.stream_pacing(_frames(spark, sf_dir), STEP, order=("pts_us", "event_id"), initial=sm.seed_state(seeds, "pacing"))
    return sm.latest(sm.run_available(rows, "seeded", "update")).select("clip_id", "frames", "missing")


@query("stream_hysteresis", b.sql("T", HYSTERESIS_SQL + """,
  o AS (SELECT e.*, T.event_id FROM e JOIN T ON e.clip_id = T.clip_id AND e.frame_no = T.frame_no)
SELECT clip_id, event_id, pts_us, CASE WHEN cur = 1 THEN 'autopause' ELSE 'autoresume' END AS action FROM o WHERE cur <> was"""))
def stream_hysteresis(spark, sf_dir):
    rows = sm.stream_hysteresis(_frames(spark, sf_dir), order="event_id")
    return sm.run_available(rows, "hysteresis").drop("batch")


@query("stream_scenes", b.sql("V", f"""{SCENE_SQL}
SELECT sc.clip_id, vec_id, round(score, 6) AS score, coalesce(score >= 0.12, false) AS cut,
  CAST(sum(CASE WHEN score >= 0.12 THEN 1 ELSE 0 END) OVER (PARTITION BY sc.clip_id ORDER BY sc.frame_no) AS BIGINT) AS scene_id
FROM sc JOIN V ON sc.clip_id = V.clip_id AND sc.frame_no = V.frame_no"""))
def stream_scenes(spark, sf_dir):
    rows = sm.stream_scenes(_planes(spark, sf_dir), 0.12, order="vec_id")
    return rounded(sm.run_available(rows, "scenes").drop("batch"))


@query("stream_duplicates", b.sql("V", f"""pv AS (SELECT *, lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_no) AS prv FROM V),
  s AS (SELECT clip_id, frame_no, vec_id, luma, sum(CASE WHEN prv IS NOT NULL AND {mad('luma', 'prv')} >= 0.13 THEN 1 ELSE 0 END)
      OVER (PARTITION BY clip_id ORDER BY frame_no) AS scene FROM pv)
SELECT x.clip_id, x.vec_id, coalesce(bool_or({mad('x.luma', 'y.luma')} <= 0.115), false) AS duplicate
FROM s x LEFT JOIN s y ON x.clip_id = y.clip_id AND x.scene = y.scene AND y.frame_no BETWEEN x.frame_no - 3 AND x.frame_no - 1
GROUP BY x.clip_id, x.vec_id"""))
def stream_duplicates(spark, sf_dir):
    rows = sm.stream_duplicates(_planes(spark, sf_dir), 3, 0.115, 0.13, order="vec_id")
    return sm.run_available(rows, "duplicates").drop("batch")


@query("stream_exact_duplicates", b.sql("T", """SELECT user_id AS clip_id, event_type AS fingerprint, count(*) AS n FROM
  (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL"""))
def stream_exact_duplicates(spark, sf_dir):
    """A watermark delay longer than the table's month keeps every id open, so each appears once."""
    rows = _source(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("fingerprint"),
                                                   F.col("ts").cast("timestamp").alias("event_time"))
    once = sm.stream_exact_duplicates(rows, "event_time", "400 days")
    return (sm.run_available(once, "exact").groupBy("clip_id", "fingerprint").agg(F.count(F.lit(1)).alias("n")))


# The filtered samples of each block, then the gain block by block, then running totals.
WANTED_SQL = "greatest(0.35, least(4.0, pow(10.0, -16 / 20.0) / greatest(x, 1e-6)))"
STREAM_AUDIO_SQL = b.sql("A", FILTERED_SQL + f""",
  bl AS (SELECT clip_id, block_no, list(y ORDER BY i) AS ys FROM out GROUP BY clip_id, block_no),
  rm AS (SELECT *, sqrt(list_sum(list_transform(ys, lambda v: v * v)) / 64) AS rms FROM bl),
  li AS (SELECT clip_id, list(rms ORDER BY block_no) AS rs FROM rm GROUP BY clip_id),
  ga AS (SELECT rm.*, list_reduce(rs[1:block_no + 1], lambda a, x: CASE WHEN x > pow(10.0, -20 / 20.0) THEN a + ({WANTED_SQL} - a)
      * (CASE WHEN {WANTED_SQL} < a THEN 0.28 ELSE 0.035 END) ELSE a END, CAST(1.0 AS DOUBLE)) AS gain FROM rm JOIN li ON rm.clip_id = li.clip_id),
  fi AS (SELECT *, list_transform(ys, lambda v: v * gain) AS raised, pow(10.0, -10 / 20.0) AS top FROM ga),
  bo AS (SELECT *, len(list_filter(raised, lambda v: abs(v) > top)) AS clipped, list_transform(raised, lambda v: greatest(-top, least(top, v))) AS done FROM fi),
  tt AS (SELECT *, sum(clipped) OVER w AS clipped_total, max(list_max(list_transform(done, lambda v: abs(v)))) OVER w AS peak_total,
    sqrt(sum(rms * rms) OVER w / (block_no + 1)) AS average_rms FROM bo WINDOW w AS (PARTITION BY clip_id ORDER BY block_no))
SELECT tt.clip_id, A.vec_id AS block_no, round(rms, 6) AS block_rms, round(gain, 6) AS gain,
  round(list_sum(list_transform(list_zip(range(1, 65), done), lambda z: z[1] * z[2])), 6) AS checksum, CAST(clipped_total AS BIGINT) AS clipped_total,
  round(peak_total, 6) AS peak_total, round(average_rms, 6) AS average_rms FROM tt JOIN A ON A.clip_id = tt.clip_id AND A.block_no = tt.block_no""").replace(
    "WITH ", "WITH RECURSIVE ", 1)


@query("stream_audio", STREAM_AUDIO_SQL)
def stream_audio(spark, sf_dir):
    blocks = _source(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("clip_id"), F.col("vec_id").alias("block_no"), F.lit(64).alias("rate"), F.lit(1).alias("channels"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    rows = sm.run_available(sm.stream_audio(blocks, gate_db=-20, limiter_db=-10), "audio")
    total = F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return rounded(rows.select("clip_id", "block_no", "block_rms", "gain", total.alias("checksum"), "clipped_total", "peak_total", "average_rms"))


@query("stream_resample", b.sql("T", RESAMPLE_SQL + """
SELECT clip_id, k AS tick_no, CAST(floor(tau + 0.5) AS BIGINT) AS pts_us, CASE WHEN t < 0.5 THEN frame_no ELSE frame_no + 1 END AS source_no,
  round(t, 6) AS t, CAST(0 AS BIGINT) AS late FROM inner_ticks
UNION ALL SELECT clip_id, k, CAST(floor(greatest(tau, pts_us) + 0.5) AS BIGINT), frame_no, 0.0, 0 FROM last_ticks WHERE tau <= pts_us + dur_us"""))
def stream_resample(spark, sf_dir):
    """Every tick of the batch form: the end of the input is declared, so nothing waits for a later row."""
    frames, close = sm.ending(_frames(spark, sf_dir))
    rows = sm.stream_resample(frames, GRID_US, delay="1 hour", flush_ms=0, range_ms=WEEK_MS)
    return rounded(sm.on_time(sm.run_available(rows, "resample", close=close)).drop("batch"))


# Rows of the last ten days come in files of their own, after the rest; of these, what is older than the rest's end less an hour is late.
@query("stream_late_rows", b.sql("T", """cut AS (SELECT max(pts_us) - 864000000000 AS c FROM T),
  early AS (SELECT * FROM T WHERE event_id % 7 <> 0 OR pts_us > (SELECT c FROM cut)), m AS (SELECT max(pts_us) // 1000 - 3600000 AS wm FROM early)
SELECT clip_id, pts_us, dur_us FROM T, m WHERE event_id % 7 = 0 AND pts_us <= (SELECT c FROM cut) AND pts_us // 1000 <= wm"""))
def stream_late_rows(spark, sf_dir):
    """The second output: rows that arrive behind the watermark, in a table of their own."""
    edge = b.timelines(spark, sf_dir).agg(F.max("pts_us") - 10 * b.DAY_US).first()[0]
    folder = fresh_dir(spark, "late-input")
    table = b.table(spark, sf_dir, "events").withColumn("_pts", F.unix_micros(F.col("ts").cast("timestamp")))
    behind = (F.col("event_id") % 7 == 0) & (F.col("_pts") <= edge)
    table.where(~behind).drop("_pts").write.parquet(folder)
    stream = spark.readStream.schema(table.drop("_pts").schema).parquet(folder)
    rows = sm.stream_resample(_as_frames(stream), GRID_US, delay="1 hour", range_ms=WEEK_MS)
    progress = fresh_dir(spark, "late-progress")
    sm.run_available(rows, "late-first", progress=progress)
    table.where(behind).drop("_pts").write.mode("append").parquet(folder)
    return sm.late_rows(sm.run_available(rows, "late-then", progress=progress), "pts_us bigint, dur_us bigint")


@query("stream_restarted_pacing", b.sql("T", f"{STEPS_SQL}, pacing AS ({PACING_SQL}) SELECT * FROM pacing"))
def stream_restarted_pacing(spark, sf_dir):
    """A query over the first half of the time is stopped; its counters are read from its state and start a new query over the rest."""
    bounds = b.timelines(spark, sf_dir).agg(F.min("pts_us"), F.max("pts_us")).first()
    middle = (bounds[0] + bounds[1]) // 2
    progress = fresh_dir(spark, "first-half-progress")
    order = ("pts_us", "event_id")
    first = sm.run_available(sm.stream_pacing(_frames(spark, sf_dir).where(F.col("pts_us") < middle), STEP, order=order), "first-half", "update",
                             progress=progress)
    rest = sm.stream_pacing(_frames(spark, sf_dir).where(F.col("pts_us") >= middle), STEP, order=order, initial=sm.saved_state(spark, progress))
    both = first.withColumn("batch", F.lit(-1)).unionByName(sm.run_available(rest, "second-half", "update"))
    return sm.latest(both)


@query("stream_telemetry", b.sql("T", """w AS (SELECT clip_id AS device_id, make_timestamp(pts_us // 86400000000 * 86400000000) AS s, heap_ratio, pts_us FROM T)
SELECT device_id, epoch_us(s) AS start_us, count(*) AS samples, round(avg(heap_ratio), 9) AS avg_heap_ratio, round(max(heap_ratio), 9) AS max_heap_ratio FROM w GROUP BY device_id, s"""))
def stream_telemetry(spark, sf_dir):
    """Update mode, so that windows still open at the end are part of the result."""
    frames = _frames(spark, sf_dir).select(F.col("clip_id").alias("device_id"), F.col("event_time").alias("ts"), (F.col("value") / 500).alias("heap_ratio"))
    rows = sm.run_available(sm.stream_telemetry(frames, window="1 day"), "telemetry", "update")
    out = sm.latest(rows, ("device_id", "start"))
    return rounded(out.select("device_id", F.unix_micros("start").alias("start_us"), "samples", "avg_heap_ratio", "max_heap_ratio"), 9)
