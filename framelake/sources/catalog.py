"""Catalogue and timeline readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.mathx import normalize_fps, seconds_to_us
from framelake.operators.ordered import SEGMENT_ROWS, attach, SEG, segment_of
from framelake.schemas import TABLES
from pyspark.sql import Window


def read_table(spark: SparkSession, name: str, path: str, file_format: str = "parquet") -> DataFrame:
    """Reads one of the library's tables with its fixed schema (parquet, json, orc or csv)."""
    reader = spark.read.schema(TABLES[name])
    if file_format == "csv":
        reader = reader.option("header", "true")
    return reader.format(file_format).load(path)


def normalize_clips(clips: DataFrame) -> DataFrame:
    """Bounded rate and a codec for every clip; missing audio flags become false."""
    out = clips.withColumn("fps", normalize_fps("fps"))
    if "codec" in clips.columns:
        out = out.withColumn("codec", F.when(F.coalesce(F.col("codec"), F.lit("")) == "", "unknown")
                             .otherwise(F.col("codec")))
    if "has_audio" in clips.columns:
        out = out.withColumn("has_audio", F.coalesce(F.col("has_audio"), F.lit(False)))
    return out


def read_clips(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return normalize_clips(read_table(spark, "clips", path, file_format))


def read_timeline(df: DataFrame, clip: str = "clip_id", arrival: str = "frame_no", seconds: str = "ts_s",
                  duration: str = "dur_s", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Seconds to microseconds, rebased so the first *arriving* frame of a clip is at 0.

    Deltas are kept; a frame before the first one is held at 0.
    """
    out = df.select(
        F.col(clip).alias("clip_id"), F.col(arrival).cast("bigint").alias("arrival"),
        F.greatest(F.lit(0), seconds_to_us(seconds)).alias("pts_us"),
        F.greatest(F.lit(1), seconds_to_us(duration)).alias("dur_us")).withColumn(SEG, segment_of("arrival", rows))
    whole = (Window.partitionBy("clip_id").orderBy(SEG)
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = attach(out, ["clip_id"], [F.min_by("pts_us", "arrival").alias("_p")],
                 lambda s: s.select("clip_id", SEG, F.first("_p").over(whole).alias("_origin")))
    return (out.withColumn("pts_us", F.greatest(F.lit(0), F.col("pts_us") - F.col("_origin")))
            .drop(SEG, "_origin"))
