"""Timeline audits: pacing, gaps, accounting, rates, hysteresis and sampled telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.mathx import clamp, js_round, round_to
from framelake.operators.ordered import (
    SEGMENT_ROWS, SEG, HOME, neighbours, number_rows, running, upper_median, with_halo,
)

CLIP = ["clip_id"]


def ordered_timeline(frames: DataFrame, span_us: int = 86_400_000_000, name: str = "order_no") -> DataFrame:
    """Stable presentation order: dense ordinal by pts, arrival (``frame_no``) breaking ties.

    Sorting happens per (clip, time span), never per clip.
    """
    return number_rows(frames, CLIP, ["pts_us", "frame_no"],
                       F.floor(F.col("pts_us") / span_us).cast("bigint"), name)


def sorted_for_output(frames: DataFrame) -> DataFrame:
    """Range-partitions by (clip, pts) and sorts inside partitions, so files come out in timeline
    order and a long clip spreads over several of them."""
    return (frames.repartitionByRange("clip_id", "pts_us", "frame_no")
            .sortWithinPartitions("clip_id", "pts_us", "frame_no"))


def missing_between(delta: Column, expected: Column) -> Column:
    """Frames missing in a step: round(step / nominal) - 1, at least 1, when over 1.5 nominal."""
    return F.when(delta > expected * 1.5,
                  F.greatest(F.lit(1.0), js_round(delta / expected) - 1)).otherwise(0.0)


def pacing_report(frames: DataFrame, expected_us: float, tolerance: float = 0.08,
                  allowed_irregular: float = 0.02, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per clip: non-monotonic, irregular and missing steps against a nominal step, in arrival order."""
    e = F.lit(float(expected_us))
    limit = max(2.0, float(expected_us) * tolerance)
    steps = neighbours(frames.select("clip_id", "frame_no", "pts_us"), CLIP, lag={"_prev": "pts_us"}, rows=rows)
    delta = F.col("_d").cast("double")
    positive = F.when(F.col("_d") > 0, F.col("_d"))
    steps = steps.withColumn("_d", F.col("pts_us") - F.col("_prev"))
    report = steps.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("_d") <= 0).alias("non_monotonic"),
        F.count_if((F.col("_d") > 0) & (F.abs(delta - e) > limit)).alias("irregular"),
        F.coalesce(F.sum(missing_between(delta, e)), F.lit(0.0)).cast("bigint").alias("missing"),
        F.min(positive).alias("min_delta_us"), F.max(positive).alias("max_delta_us"))
    ratio = F.when(F.col("frames") > 1, F.col("irregular") / (F.col("frames") - 1)).otherwise(0.0)
    return (report.withColumn("irregular_ratio", ratio)
            .withColumn("valid", (F.col("non_monotonic") == 0) & (F.col("missing") == 0)
                        & (F.col("irregular_ratio") <= allowed_irregular)))


def with_gaps(frames: DataFrame, tolerance_us: float = 2500, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds the running end before each frame, the previous pts, and the gap in front of it."""
    tolerance = max(250.0, float(tolerance_us) or 2500.0)
    end = F.col("pts_us") + F.greatest(F.lit(1), F.col("dur_us"))
    out = running(frames, CLIP, {
        "prev_end_us": ("max", end, False), "prev_pts_us": ("last", F.col("pts_us"), False)}, rows=rows)
    gap = F.col("pts_us") > F.col("prev_end_us") + tolerance
    return out.withColumn("gap_us", F.when(gap, F.col("pts_us") - F.col("prev_end_us")))


def source_gap_report(frames: DataFrame, tolerance_us: float = 2500, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per clip: gaps against the running end, their total, and steps back against the previous pts."""
    out = with_gaps(frames.select("clip_id", "frame_no", "pts_us", "dur_us"), tolerance_us, rows)
    return out.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("decoded"), F.count("gap_us").alias("source_gaps"),
        F.coalesce(F.sum("gap_us"), F.lit(0)).alias("source_gap_us"),
        F.count_if(F.col("pts_us") < F.col("prev_pts_us")).alias("source_non_monotonic"))


def output_gap_report(frames: DataFrame, expected_us: float, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per clip: encoded frames, steps that do not advance, and missing frames."""
    steps = neighbours(frames.select("clip_id", "frame_no", "pts_us"), CLIP, lag={"_prev": "pts_us"}, rows=rows)
    delta = (F.col("pts_us") - F.col("_prev")).cast("double")
    return steps.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("encoded"),
        F.count_if(delta <= 0).alias("output_non_monotonic"),
        F.coalesce(F.sum(missing_between(delta, F.lit(float(expected_us)))), F.lit(0.0))
        .cast("bigint").alias("output_missing"))


def clip_audit(frames: DataFrame, expected_us: float, tolerance_us: float = 2500,
               rows: int = SEGMENT_ROWS) -> DataFrame:
    """Pacing and source gaps in one report with a verdict per clip."""
    pacing = pacing_report(frames, expected_us, rows=rows)
    gaps = source_gap_report(frames, tolerance_us, rows=rows).drop("decoded")
    verdict = (F.when(F.col("source_non_monotonic") > 0, "source_order")
               .when(~F.col("valid"), "pacing").when(F.col("source_gaps") > 0, "gaps").otherwise("ok"))
    return pacing.join(gaps, "clip_id").withColumn("verdict", verdict)


# Codes of frame_accounting in the order in which they are checked (fixed values).
ACCOUNTING_CODES = ("no_decoded", "frame_loss", "no_encoded", "output_integrity", "source_order", "short_count")


def frame_accounting(decoded: DataFrame, processed: DataFrame, encoded: DataFrame, expected_us: float,
                     strict: bool = True, check_length: bool = True, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Reconciles decoded, processed and encoded frames per clip; one row per clip on each side
    of the full joins."""
    source = source_gap_report(decoded, rows=rows).join(
        decoded.groupBy("clip_id").agg(
            (F.max(F.col("pts_us") + F.col("dur_us")) - F.min("pts_us")).alias("span_us")), "clip_id")
    done = processed.groupBy("clip_id").agg(F.count(F.lit(1)).alias("processed"))
    out = source.join(done, "clip_id", "full").join(output_gap_report(encoded, expected_us, rows), "clip_id", "full")
    counts = ["decoded", "processed", "encoded", "source_gaps", "source_gap_us", "source_non_monotonic",
              "output_non_monotonic", "output_missing", "span_us"]
    out = out.select("clip_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
    wanted = F.greatest(F.lit(1.0), F.floor((F.col("span_us") - 1) / F.lit(float(expected_us))) + 1)
    failures = [
        F.col("decoded") == 0,
        F.col("processed") != F.col("decoded"),
        F.col("encoded") == 0,
        (F.col("output_non_monotonic") > 0) | (F.col("output_missing") > 0),
        F.lit(strict) & (F.col("source_non_monotonic") > 0),
        F.lit(strict and check_length) & (F.col("span_us") > 0) & (F.col("encoded") + 1 < wanted),
    ]
    codes = F.filter(F.array(*[F.when(test, code) for test, code in zip(failures, ACCOUNTING_CODES)]),
                     lambda c: c.isNotNull())
    return (out.withColumn("errors", codes)
            .withColumn("first_error", F.get("errors", F.lit(0)))
            .withColumn("valid", F.size("errors") == 0))


def estimate_fps(frames: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per clip: rate from the upper median of the positive steps, and whether the rate varies."""
    steps = neighbours(frames.select("clip_id", "frame_no", "pts_us"), CLIP, lag={"_prev": "pts_us"}, rows=rows)
    steps = steps.select("clip_id", ((F.col("pts_us") - F.col("_prev")) / F.lit(1e6)).alias("step_s"))
    positive = steps.where("step_s > 0")
    median = upper_median(positive, CLIP, ["step_s"]).withColumnRenamed("step_s", "median_step_s")
    span = positive.groupBy("clip_id").agg(F.min("step_s").alias("min_step_s"), F.max("step_s").alias("max_step_s"))
    clips = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"))
    rate = clamp(round_to(F.lit(1.0) / F.col("median_step_s"), 3), 1, 240)
    return (clips.join(median, "clip_id", "left").join(span, "clip_id", "left")
            .withColumn("fps", F.when(F.col("median_step_s").isNull(), 30.0).otherwise(rate))
            .withColumn("min_fps", F.lit(1.0) / F.col("max_step_s"))
            .withColumn("max_fps", F.lit(1.0) / F.col("min_step_s"))
            .withColumn("variable_frame_rate", F.col("min_step_s") != F.col("max_step_s"))
            .drop("min_step_s", "max_step_s"))


def rolling_rate(ticks: DataFrame, time_ms: Column, window: int = 60, max_delta_ms: float = 5000.0,
                 rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mean of the last ``window`` valid frame times and the rate; rows with an invalid frame time
    keep the last value."""
    steps = neighbours(ticks.withColumn("_ms", time_ms), CLIP, lag={"_prev_ms": "_ms"}, rows=rows)
    delta = F.col("_ms") - F.col("_prev_ms")
    steps = steps.withColumn("_delta", F.when((delta > 0) & (delta < max_delta_ms), delta))
    steps = running(steps, CLIP, {
        "_valid_no": ("sum", F.when(F.col("_delta").isNotNull(), 1).otherwise(0), True)}, rows=rows)
    spread = with_halo(steps, CLIP, "_valid_no", back=window - 1, rows=rows)
    recent = (Window.partitionBy(*CLIP, SEG).orderBy("_valid_no").rangeBetween(-(window - 1), 0))
    out = spread.withColumn("frame_time_ms", F.avg("_delta").over(recent)).where(HOME)
    return (out.withColumn("fps", F.lit(1000.0) / F.col("frame_time_ms"))
            .drop(SEG, HOME, "_ms", "_prev_ms", "_delta", "_valid_no"))


def progress_eta(events: DataFrame, progress: Column, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Progress that never goes back, elapsed and remaining seconds, and speed."""
    out = running(events.withColumn("_p", F.least(F.lit(1.0), progress)), CLIP, {
        "progress": ("max", F.col("_p"), True), "_start": ("first", F.col("pts_us"), True)}, rows=rows)
    elapsed = (F.col("pts_us") - F.col("_start")) / F.lit(1e6)
    out = out.withColumn("elapsed_s", elapsed)
    effective = F.greatest(F.lit(0.005), F.col("progress"))
    started = F.col("progress") > 0
    return (out.withColumn("remaining_s", F.when(started, F.greatest(
                F.lit(0.0), F.col("elapsed_s") / effective * (F.lit(1.0) - effective))))
            .withColumn("speed", F.when(started, F.col("progress") / F.greatest(F.lit(0.001), F.col("elapsed_s"))))
            .drop("_p", "_start"))


def preflight_action(status) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return (F.when(status >= 4, "wait").when(status >= 3, "reduce-concurrency").otherwise("continue"))


def hysteresis_state(telemetry: DataFrame, value: str = "status", high: float = 4, low: float = 2,
                     rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds ``paused`` (on at >= high, off at <= low, held between) and its value before the row."""
    edge = F.when(F.col(value) >= high, 1).when(F.col(value) <= low, 0)
    out = running(telemetry, CLIP, {"_on": ("last", edge, True), "_was": ("last", edge, False)}, rows=rows)
    return (out.withColumn("paused", F.coalesce(F.col("_on"), F.lit(0)) == 1)
            .withColumn("was_paused", F.coalesce(F.col("_was"), F.lit(0)) == 1).drop("_on", "_was"))


def hysteresis_transitions(telemetry: DataFrame, value: str = "status", high: float = 4, low: float = 2,
                           rows: int = SEGMENT_ROWS) -> DataFrame:
    out = hysteresis_state(telemetry, value, high, low, rows).where(F.col("paused") != F.col("was_paused"))
    return out.select("clip_id", "frame_no", "pts_us",
                      F.when(F.col("paused"), "autopause").otherwise("autoresume").alias("action"))


def hysteresis_intervals(telemetry: DataFrame, value: str = "status", high: float = 4, low: float = 2,
                         rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per paused interval; an interval still open has no end."""
    state = hysteresis_state(telemetry.select("clip_id", "frame_no", "pts_us", value), value, high, low, rows)
    starts = F.col("paused") & ~F.col("was_paused")
    ends = ~F.col("paused") & F.col("was_paused")
    numbered = running(state, CLIP, {"interval_no": ("sum", F.when(starts, 1).otherwise(0), True)}, rows=rows)
    return (numbered.where(starts | ends).groupBy("clip_id", "interval_no").agg(
        F.min(F.when(starts, F.col("pts_us"))).alias("start_us"),
        F.max(F.when(ends, F.col("pts_us"))).alias("end_us"))
        .withColumn("interval_no", F.col("interval_no").cast("bigint")))


def sample_and_hold(frames: DataFrame, value: Column, every: int, name: str = "held",
                    rows: int = SEGMENT_ROWS) -> DataFrame:
    """Takes the value on every Nth frame and holds it until the next sample."""
    sampled = F.when(F.col("frame_no") % every == 0, value)
    return running(frames, CLIP, {name: ("last", sampled, True)}, rows=rows)


def resource_summary(telemetry: DataFrame, heap: str = "heap_ratio", queue: str = "codec_queue",
                     every: int = 120) -> DataFrame:
    """Per clip: start, end and peak heap, growth, peak queue, frames and samples taken."""
    sampled = F.col("frame_no") % every == 0
    return telemetry.groupBy("clip_id").agg(
        F.max("frame_no").alias("frames"), F.count_if(sampled).alias("samples"),
        F.min_by(heap, "frame_no").alias("start_heap"), F.max_by(heap, "frame_no").alias("end_heap"),
        F.greatest(F.min_by(heap, "frame_no"), F.max(F.when(sampled, F.col(heap)))).alias("peak_heap"),
        (F.max_by(heap, "frame_no") - F.min_by(heap, "frame_no")).alias("heap_growth"),
        F.greatest(F.lit(0), F.max(queue)).cast("bigint").alias("peak_queue"))


def pressure_tier(telemetry: DataFrame, every: int = 30, plan_queue: int = 1, plan_backlog: int = 1) -> DataFrame:
    """Pressure score and tier of the sampled rows (frame 0 and every Nth frame)."""
    queue = F.greatest(F.col("codec_queue") / F.lit(float(max(1, plan_queue))),
                       F.col("write_backlog") / F.lit(float(max(1, plan_backlog))))
    score = F.greatest(F.coalesce(F.col("heap_ratio"), F.lit(0.0)), F.least(F.lit(1.5), queue / 1.5))
    tier = (F.when(score >= 0.9, "CRITICAL").when(score >= 0.72, "HIGH")
            .when(score >= 0.55, "ELEVATED").otherwise("NORMAL"))
    return (telemetry.where((F.col("frame_no") <= 0) | (F.col("frame_no") % every == 0))
            .withColumn("score", score).withColumn("tier", tier)
            .withColumn("force_yield", F.col("tier") == "CRITICAL"))


def recent_actions(pressure: DataFrame, n: int = 64) -> DataFrame:
    """The last n rows per run that are not NORMAL. The rank filter is applied before the shuffle
    too, so one long run does not travel whole."""
    latest = Window.partitionBy("clip_id").orderBy(F.col("frame_no").desc())
    return (pressure.where(F.col("tier") != "NORMAL")
            .withColumn("action_rank", F.row_number().over(latest).cast("bigint")).where(F.col("action_rank") <= n)
            .withColumn("score", round_to("score", 3)))
