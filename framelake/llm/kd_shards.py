"""Operator 10, sharding: a k-d tree over document metadata, cut at weighted medians until leaves reach their bytes.

Dimensions are the logarithm of the text's bytes, source, language and ``doc_id``, each scaled to 0..1; source and
language are numbered by the order of their whole strings. A node that is to become k shards is cut along its widest
dimension where floor(k/2)/k of its bytes lie in front, so any number of shards comes out near equal. A median is found
by two sums over all rows of the level: bytes per 1/1024 of the node's range, then, inside the one bin the cut falls in,
bytes per 1/65536 of a hash of the text. A single value that a third of all rows share is thereby cut inside itself.
Rows are never sorted or gathered; the driver holds the tree, that is one row per shard and level.

Law: ``bytes``. Groups: equal texts go as one, by the smallest of each metadata value among them, while all of them
together hold at most ``TOGETHER`` of a leaf; larger groups would make leaves unequal and are dealt row by row. Null texts have
no bytes (8 with the end mark) and are equal to empty ones; null metadata lie at the lower end of their dimension. Equal
rows of a group that is dealt go the same way. Only the named columns are read; an empty table gives no rows, and a table
with fewer documents than shards leaves some empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.shared import cut, dense_number, read, small_side

SHARDS = 24
BINS = 1 << 10
SUB_BINS = 1 << 16
DIMENSIONS = ("size_log", "source_code", "lang_code", "id_code")
#: What names equal texts, and what their places depend on.
GROUP = ("text_key", "text_crc32")
PLACE = ("source_code", "lang_code", "id_code")
#: Share of a leaf up to which equal texts stay together: an end of a leaf is off by half of it at most.
TOGETHER = 1 / 16
#: Share of all bytes above which a group of equal texts is broadcast.
HOT = 1 / 10_000
#: Distinct sources or languages up to which their numbers are broadcast.
FEW_VALUES = 100_000
#: Levels after which the rows are written anew, to keep plans short.
LEVELS_PER_CUT = 6


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """``<name>_code``: the number of the string among the distinct ones, in order; -1 for null.

    Distinct values are numbered in ranges, each by its own task, so that they may be as many as the rows.
    """
    spread = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where(F.col(name).isNotNull())
    ranged = cut(spread.repartitionByRange(name).select(name, F.spark_partition_id().alias("_range")))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_range").orderBy(name)
    numbers = (ranged.join(starts, "_range")
               .select(F.col(name).alias("_value"), (F.col("_start") + F.row_number().over(inside) - 1).cast("double").alias("_code")))
    numbers = small_side(numbers, FEW_VALUES)
    return (rows.join(numbers, rows[name] == F.col("_value"), "left")
            .withColumn(f"{name}_code", F.coalesce("_code", F.lit(-1.0))).drop("_value", "_code", name))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's key and the dimensions; the text goes no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"), F.log2(size.cast("double")).alias("size_log"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("double").alias("id_code"))
    return _ranked(_ranked(cut(rows), "source"), "lang")


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of equal texts get one place and one ``tie``, where they fit a leaf together."""
    groups = (rows.groupBy(*GROUP).agg(F.sum("size").alias("_held"), F.count(F.lit(1)).alias("_n"), *[F.min(d).alias(f"_{d}") for d in PLACE])
              .where("_n > 1"))
    leaf = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = cut(groups.withColumn("_whole", F.col("_held") <= leaf * TOGETHER))
    # A group above a share of all bytes is one of few: those meet their rows as a broadcast table of at most 1/HOT rows, and no
    # group that is left is large enough to weigh on a task.
    hot = groups.where(F.col("_held") > leaf * shards * HOT)
    for side in (F.broadcast(hot), groups.where(F.col("_held") <= leaf * shards * HOT)):
        met = rows.join(side, list(GROUP), "left")
        moved = F.coalesce(F.col("_whole"), F.lit(False))
        rows = met.select("doc_id", "size", *GROUP, *[F.when(moved, F.col(f"_{d}")).otherwise(F.col(d)).alias(d) for d in PLACE], "size_log",
                          *([F.coalesce(F.col("_parted"), ~F.col("_whole")).alias("_parted")] if "_parted" in rows.columns
                            else [(~F.col("_whole")).alias("_parted")]))
    apart = F.xxhash64("doc_id", *GROUP)
    tie = F.when(F.coalesce(F.col("_parted"), F.lit(False)), apart).otherwise(F.xxhash64(*GROUP))
    return rows.withColumn("tie", F.pmod(tie, F.lit(SUB_BINS))).drop("_parted")


def _scaled(rows: DataFrame) -> DataFrame:
    ends = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for d in DIMENSIONS:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        wide = (hi - lo) if lo is not None and hi > lo else 1.0
        scaled[d] = F.coalesce((F.col(d) - (lo or 0.0)) / wide, F.lit(0.0))
    return rows.withColumns(scaled)


def _crossing(summed: DataFrame, by: str) -> DataFrame:
    """Per node the bin in which the bytes reach ``goal``, and the bytes in front of it."""
    upto = Window.partitionBy("node").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (summed.withColumn("after", F.sum("held").over(upto))
            .filter((F.col("after") >= F.col("goal")) & (F.col("after") - F.col("held") < F.col("goal"))))


def _bin(splits_value: Column) -> Column:
    return F.when(F.col("width") > 0, F.least(F.floor((splits_value - F.col("lo")) / F.col("width") * BINS),
                                             F.lit(BINS - 1))).otherwise(0)


def _level(spark: SparkSession, rows: DataFrame, leaves: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Cuts every node of more than one shard in two; node ids are first shards."""
    stats = (rows.filter(F.col("node").isin([n for n, k in leaves.items() if k > 1])).groupBy("node")
             .agg(F.sum("size").alias("held"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS
                                                 for n, f in (("lo", F.min), ("hi", F.max))])).collect()
    plans = []
    for s in stats:
        k = leaves[s["node"]]
        widest = max(range(len(DIMENSIONS)), key=lambda i: s[f"hi_{DIMENSIONS[i]}"] - s[f"lo_{DIMENSIONS[i]}"])
        lo, hi = s[f"lo_{DIMENSIONS[widest]}"], s[f"hi_{DIMENSIONS[widest]}"]
        plans.append((s["node"], widest, lo, hi - lo, s["held"] * (k // 2) / k, s["node"] + k // 2))
    after = {}
    for node, k in leaves.items():
        after.update({node: k // 2, node + k // 2: k - k // 2} if k > 1 else {node: k})
    if not plans:
        return rows, after
    named = "node int, dim int, lo double, width double, goal double, upper int"
    at = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
    # One row per shard at most, so these sides are as small as the tree.
    binned = rows.join(F.broadcast(spark.createDataFrame(plans, named)), "node").withColumn("bin", _bin(at))
    first = _crossing(binned.groupBy("node", "bin").agg(F.sum("size").alias("held"), F.first("goal").alias("goal")), "bin")
    bins = {r["node"]: (r["bin"], r["goal"] - (r["after"] - r["held"])) for r in first.collect()}
    inner = spark.createDataFrame([(n, b, float(g)) for n, (b, g) in bins.items()], "node int, bin long, goal double")
    inside = rows.join(F.broadcast(spark.createDataFrame(plans, named).drop("goal")), "node").withColumn("bin", _bin(at))
    second = _crossing(inside.join(F.broadcast(inner), ["node", "bin"]).groupBy("node", "tie")
                       .agg(F.sum("size").alias("held"), F.first("goal").alias("goal")), "tie")
    ties = {}
    for r in second.collect():  # the border part goes to the side that comes nearer
        ties[r["node"]] = r["tie"] + (r["after"] - r["goal"] <= r["goal"] - (r["after"] - r["held"]))
    rules = spark.createDataFrame([(*p, bins[p[0]][0], ties[p[0]]) for p in plans], named + ", cut_bin long, cut_tie long")
    routed = rows.join(F.broadcast(rules), "node", "left")
    upper = (_bin(at) > F.col("cut_bin")) | ((_bin(at) == F.col("cut_bin")) & (F.col("tie") >= F.col("cut_tie")))
    node = F.when(F.col("upper").isNotNull() & upper, F.col("upper")).otherwise(F.col("node"))
    return routed.select(*[c for c in rows.columns if c != "node"], node.alias("node")), after


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    ``shards`` leaves, or as many as ``target_bytes`` asks for.
    """
    spark = docs.sparkSession
    rows = metadata(docs)
    if target_bytes:
        shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    rows = cut(_scaled(_grouped(rows, shards))).withColumn("node", F.lit(0))
    leaves = {0: shards}
    level = 0
    while max(leaves.values()) > 1:
        rows, leaves = _level(spark, rows, leaves)
        level += 1
        if level % LEVELS_PER_CUT == 0:
            rows = cut(rows)
    placed = cut(rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard")))
    return dense_number(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return kd_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_kd_shards": op10_kd_shards}
ORACLES: dict[str, str] = {}
