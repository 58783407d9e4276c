"""Streaming forms of the ordered operators, and a runner for bounded runs.

Rows are keyed by clip. A stream keeps its per-clip state in the state store, one entry for a bucket of clips, as a call to a
processor costs milliseconds whether for one clip or for hundreds; within a trigger rows are ordered by their position. A bucket's rows of one
trigger are held by one task. Use ``reordered`` where sources deliver out of order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import ROCKSDB_PROVIDER, STATE_STORE_CONF, fresh_dir
from framelake.streaming import folds
from framelake.streaming.processors import FoldProcessor, ReorderProcessor

CLIP = ["clip_id"]
#: Buckets that clips are dealt to, by hash; fixed as long as a stream lives.
BUCKETS = 1024
#: A bucket's state, as kept by the processors.
HELD = "array<struct<clip_id:bigint,state:string>>"


def _bucketed(frame: DataFrame) -> DataFrame:
    """Adds ``_bucket``; clips without an id have one of their own, as their column has no integer type in pandas."""
    return frame.withColumn("_bucket", F.when(F.col("clip_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("clip_id"), F.lit(BUCKETS)).cast("int")))


def _apply(stream: DataFrame, fold, out: str, order: list[str], mode: str, initial: DataFrame | None = None) -> DataFrame:
    schema = f"{out}, clip_id bigint"
    if initial is not None:
        held = F.to_json(F.collect_list(F.struct("clip_id", "state")))
        initial = _bucketed(initial.select(F.col("clip_id").cast("bigint"), "state")).groupBy("_bucket").agg(held.alias("state")).groupBy("_bucket")
    return _bucketed(stream).groupBy("_bucket").transformWithStateInPandas(FoldProcessor(fold, CLIP, order), schema, mode, "None", initial)


def stream_pacing(frames: DataFrame, expected_us: float, tolerance: float = 0.08, order=("pts_us",),
                  initial: DataFrame | None = None) -> DataFrame:
    """Running pacing counters; one row per clip and trigger (update mode)."""
    return _apply(frames, folds.pacing_fold(expected_us, tolerance), folds.PACING_OUT, list(order), "update", initial)


def stream_integrity(frames: DataFrame, expected_us: float, tolerance_us: float = 2500, order=("pts_us",),
                     initial: DataFrame | None = None) -> DataFrame:
    """Running gap and order counters; one row per clip and trigger (update mode)."""
    return _apply(frames, folds.integrity_fold(expected_us, tolerance_us), folds.INTEGRITY_OUT, list(order), "update", initial)


def stream_scenes(frames: DataFrame, threshold: float = 0.34, order: str = "frame_no") -> DataFrame:
    out = f"{order} bigint, score double, cut boolean, scene_id bigint"
    return _apply(frames, folds.scene_fold(threshold, order), out, [order], "append")


def stream_duplicates(frames: DataFrame, look_back: int = 2, threshold: float = 0.006, cut_threshold: float = 0.24,
                      order: str = "frame_no") -> DataFrame:
    out = f"{order} bigint, duplicate boolean"
    return _apply(frames, folds.duplicate_fold(look_back, threshold, cut_threshold, order), out, [order], "append")


def stream_exact_duplicates(frames: DataFrame, event_time: str, delay: str = "1 hour", id_columns=("clip_id", "fingerprint")) -> DataFrame:
    """First row per id within the watermark."""
    return frames.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(id_columns))


def stream_hysteresis(telemetry: DataFrame, value: str = "status", high: float = 4, low: float = 2, order: str = "frame_no") -> DataFrame:
    out = f"{order} bigint, pts_us bigint, action string"
    return _apply(telemetry, folds.hysteresis_fold(value, high, low, order), out, ["pts_us", order] if order != "pts_us" else [order], "append")


def stream_audio(blocks: DataFrame, **options) -> DataFrame:
    """Filtered, levelled and limited blocks with running totals."""
    return _apply(blocks, folds.audio_fold(**options), folds.AUDIO_OUT, ["block_no"], "append")


#: rows at this time or later only move the watermark
END = "9000-01-01 00:00:00"


def reordered(frames: DataFrame, fold, out: str, delay: str, columns: str, order: list[str], flush=None, flush_ms: int = 0,
              event_time: str = "event_time", range_ms: int = 60_000) -> DataFrame:
    """Runs a fold over rows in event order, released by the watermark; adds the running ``late`` count and ``late_row``.

    ``columns`` is the DDL of the columns the fold needs; ``event_time`` is the row's timestamp. Use ``on_time`` and ``late_rows`` to part
    the two kinds of output. Rows at ``END`` close the input (see ``ending``).
    """
    parts = [part.strip() for part in columns.split(",")]
    names = [p.split()[0] for p in parts]
    timed = frames.withWatermark(event_time, delay).where(F.col(event_time) < F.lit(END).cast("timestamp")).select(
        *CLIP, F.unix_millis(event_time).alias("event_ms"), *[n for n in names if n not in CLIP])
    buffered = [n for n in names if n not in CLIP] + ["event_ms"]
    made = [part.split()[0] for part in out.split(", ")]
    processor = ReorderProcessor(fold, CLIP, order, "event_ms", buffered, made, flush, flush_ms, range_ms)
    return _bucketed(timed).groupBy("_bucket").transformWithStateInPandas(
        processor, f"{out}, clip_id bigint, late bigint, late_row string", "append", "EventTime")


def on_time(rows: DataFrame) -> DataFrame:
    """What the fold made of the rows in order."""
    return rows.where("late_row is null").drop("late_row")


def late_rows(rows: DataFrame, columns: str) -> DataFrame:
    """Rows that came behind the watermark, with the ``columns`` (DDL) that the fold was given."""
    return rows.where("late_row is not null").select("clip_id", F.from_json("late_row", columns).alias("_r")).select("clip_id", "_r.*")


def ending(frames: DataFrame, event_time: str = "event_time") -> tuple[DataFrame, Callable[[], None]]:
    """The stream with an end that can be declared: (stream, close).

    ``close()`` puts one mark behind all rows into a folder that the stream also reads; its next trigger moves the watermark past every row,
    which releases what still waits and fires all closing timers.
    """
    spark = frames.sparkSession
    folder = fresh_dir(spark, "end-marks")
    marks = spark.createDataFrame([], frames.schema)
    marks.write.parquet(folder)

    def close() -> None:
        row = spark.range(1).select(*[(F.lit(END).cast(f.dataType) if f.name == event_time else F.lit(None).cast(f.dataType)).alias(f.name)
                                      for f in frames.schema.fields])
        row.write.mode("append").parquet(folder)

    return frames.unionByName(spark.readStream.schema(frames.schema).parquet(folder)), close


def stream_resample(frames: DataFrame, step_us: float, delay: str = "1 second", flush_ms: int | None = None,
                    event_time: str = "event_time", range_ms: int = 60_000) -> DataFrame:
    """Constant-rate ticks. The last tick of a clip follows once the watermark is ``flush_ms`` past
    its last frame (None: never). Ranges of ``range_ms`` should hold some hundred frames."""
    return reordered(frames, folds.resample_fold(step_us), folds.RESAMPLE_OUT, delay, "pts_us bigint, dur_us bigint", ["pts_us"],
                     folds.resample_flush(step_us) if flush_ms is not None else None, flush_ms or 0, event_time, range_ms)


def stream_telemetry(telemetry: DataFrame, event_time: str = "ts", window: str = "1 minute", slide: str | None = None,
                     delay: str = "10 minutes", keys=("device_id",), values=("heap_ratio",)) -> DataFrame:
    """Tumbling (or sliding) window averages and maxima per device."""
    bounds = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    measures = [m for v in values for m in (F.avg(v).alias(f"avg_{v}"), F.max(v).alias(f"max_{v}"))]
    out = telemetry.withWatermark(event_time, delay).groupBy(bounds, *keys).agg(F.count(F.lit(1)).alias("samples"), *measures)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "samples",
                      *[f"{k}_{v}" for v in values for k in ("avg", "max")])


def seed_state(seeds: DataFrame, kind: str) -> DataFrame:
    """Initial-state rows for a stream that continues counters kept elsewhere.

    ``pacing`` seeds have frames and last_us; ``integrity`` seeds have decoded, last_us, end_us.
    """
    if kind == "pacing":
        state = F.struct(F.greatest(F.lit(0), F.coalesce("frames", F.lit(0))).alias("frames"), F.col("last_us").alias("last"),
                         *[F.lit(0).alias(c) for c in ("non_monotonic", "irregular", "missing")],
                         F.lit(None).cast("bigint").alias("min"), F.lit(None).cast("bigint").alias("max"))
    elif kind == "integrity":
        state = F.struct(F.greatest(F.lit(0), F.coalesce("decoded", F.lit(0))).alias("decoded"), F.col("last_us").alias("last"),
                         F.col("end_us").alias("end"), *[F.lit(0).alias(c) for c in ("gaps", "gap_us", "back", "stuck", "missing")])
    else:
        raise ValueError(f"no seed for {kind}")
    return seeds.select("clip_id", F.to_json(state, {"ignoreNullFields": "false"}).alias("state"))


def saved_state(spark: SparkSession, progress: str) -> DataFrame:
    """Counters of a stopped query, read from its checkpoint: what ``seed_state`` makes by hand, to start another query from."""
    held = (spark.read.format("statestore").option("path", progress).option("operatorId", 0).option("stateVarName", "fold").load())
    return held.select(F.explode(F.from_json("value.state", HELD)).alias("_held")).select("_held.*")


# ---- running ------------------------------------------------------------------------------

def prepare(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider."""
    if spark.conf.get(STATE_STORE_CONF, "") != ROCKSDB_PROVIDER:
        spark.conf.set(STATE_STORE_CONF, ROCKSDB_PROVIDER)


def run_available(stream: DataFrame, label: str, mode: str = "append", partitions: int | None = None, close: Callable[[], None] | None = None,
                  progress: str | None = None) -> DataFrame:
    """Processes everything available and returns the output with its trigger number ``batch``.

    Output and progress live in the shared work folder. A trigger that is repeated after a failure
    overwrites its own rows. ``partitions`` sets the number of state partitions (default: the cores). With ``close`` (see ``ending``) the
    input is then declared complete and the query goes on from its checkpoint to the end. ``progress`` names the checkpoint folder, for
    ``saved_state``.
    """
    spark = stream.sparkSession
    prepare(spark)
    target, progress = fresh_dir(spark, f"{label}-rows"), progress or fresh_dir(spark, f"{label}-progress")

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    def once() -> None:
        key = "spark.sql.shuffle.partitions"
        before = spark.conf.get(key)
        spark.conf.set(key, str(partitions or spark.sparkContext.defaultParallelism))
        try:
            run = (stream.writeStream.outputMode(mode).option("checkpointLocation", progress)
                   .trigger(availableNow=True).foreachBatch(sink).start())
        finally:
            spark.conf.set(key, before)
        run.awaitTermination()

    once()
    if close is not None:
        close()
        once()
    schema = stream.schema.simpleString()[len("struct<"):-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return spark.read.schema(f"{fields}, batch int").parquet(target) if schema else spark.read.parquet(target)


def latest(rows: DataFrame, keys=("clip_id",)) -> DataFrame:
    """The newest row per key of an update-mode output."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
