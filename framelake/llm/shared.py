"""Small helpers of the operators: documents with the columns they need, cut lineage, dense numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.session import ensure_checkpoints, fresh_dir

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and goes on from there: lost executors cost nothing."""
    ensure_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one that all executors share."""
    return fresh_dir(spark, label)


def small_side(frame: DataFrame, rows: int) -> DataFrame:
    """A join side, counted first: broadcast if it has at most ``rows`` (narrow) rows, else left to a shuffled join."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def held_back(doc_id: Column, remainder: int) -> Column:
    """True for rows whose crc32(doc_id as text) mod 5 is the remainder; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == remainder


def dense_number(frame: DataFrame, group: str, order: list[str], name: str, rows: int = 1 << 18) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps.

    A group is cut into hash ranges of about ``rows`` rows, so one hot group spreads over many tasks; the
    numbers run through the ranges, and inside a range by ``order``. Equal rows are exchangeable.
    """
    counts = frame.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.max("_rows")).first()[0] or 1
    parts = max(1, -(-total // rows))
    cut_at = frame.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = cut_at.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"),
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = cut_at.withColumn("_row", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, numbered[group].eqNullSafe(offsets["_group"]) & (numbered["_part"] == offsets["_of"]))
            .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
            .drop("_part", "_row", "_group", "_of", "_before"))
