"""How the sample tables stand in for clips, frames, planes, metrics, sessions, boxes and colours.

Each binding has a Spark form and the same rows as a SQL common table expression for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.mathx import micros
from framelake.operators.ordered import number_rows

DAY_US = 86_400_000_000
NOMINAL_STEP_US = 36_000_000_000  # the sample timelines hold about one row per ten hours
CACHE_BUDGET = 20_000_000  # bytes one owner of the sample cache table may keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", micros("ts").alias("pts_us"),
        F.lit(3_600_000_000).cast("bigint").alias("dur_us"), F.col("event_type").alias("kind"), "value")
    return number_rows(events, ["clip_id"], ["pts_us", "event_id"], F.expr(f"pts_us div {DAY_US}"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (timelines(spark, sf_dir)
            .withColumn("heap_ratio", F.col("value") / 500)
            .withColumn("codec_queue", (F.col("event_id") % 6).cast("int"))
            .withColumn("write_backlog", (F.col("event_id") % 4).cast("int"))
            .withColumn("status", F.least(F.lit(5), F.floor(F.col("value") / 25)).cast("int")))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = F.transform("embedding", lambda x: F.floor(
        F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x.cast("double") + 0.6) / 1.2 * 255.0)) + 0.5
    ).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("clip_id"), "vec_id",
        F.lit(8).alias("pw"), F.lit(8).alias("ph"), luma.alias("luma"))
    return number_rows(rows, ["clip_id"], ["vec_id"], F.expr("vec_id div 65536"))


def audio_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("clip_id"), "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    rows = number_rows(rows, ["clip_id"], ["vec_id"], F.expr("vec_id div 65536"), "block_no")
    return rows.select("clip_id", "block_no", "vec_id", (F.col("block_no") * 1_000_000).alias("ts_us"),
                       F.lit(64).alias("rate"), F.lit(1).alias("channels"), "samples")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 5
    has_audio = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip_id"),
        (F.lit(320) + (F.col("l_partkey") % 40) * 96).cast("int").alias("width"),
        (F.lit(240) + (F.col("l_suppkey") % 30) * 72).cast("int").alias("height"),
        F.when(line == 0, 24.0).when(line == 1, 25.0).when(line == 2, 30.0)
        .when(line == 3, 50.0).otherwise(60.0).alias("fps"),
        F.col("l_quantity").alias("duration_s"),
        F.floor(F.col("l_extendedprice") * 1000).cast("bigint").alias("size_bytes"),
        F.when(F.col("l_returnflag") == "A", "avc1.64002a")
        .when(F.col("l_returnflag") == "N", "vp09.00.40.08").otherwise("avc3.640028").alias("codec"),
        has_audio.alias("has_audio"),
        F.when(has_audio, F.when(F.col("l_partkey") % 7 == 0, "opus").otherwise("mp4a.40.2"))
        .alias("audio_codec"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("sample_no"),
        (F.col("l_discount") * 10).alias("exposure"),
        ((F.col("l_orderkey") % 150) / F.lit(100.0)).alias("contrast"),
        (F.col("l_tax") * 10).alias("noise"), (F.col("l_quantity") / 50).alias("detail"),
        ((F.col("l_partkey") % 100) / F.lit(100.0)).alias("blocking"),
        ((F.col("l_suppkey") % 10) / F.lit(10.0)).alias("banding"),
        ((F.col("l_partkey") % 37) / F.lit(37.0)).alias("saturation"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "in_progress").otherwise("aborted").alias("status"),
        (F.col("o_orderkey") % 500).alias("frames_written"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("bytes"),
        micros("o_orderdate").alias("last_access_us"),
        (F.col("o_orderkey") % 17 == 0).alias("pinned"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.sha2(F.col("text"), 256)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact_id"), actual.alias("actual_sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(actual).alias("expected_sha256"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("clip_id"),
        F.expr("l_orderkey div 100").alias("frame_no"),
        # line numbers repeat within an order; part and supplier make the number unique
        ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")).alias("box_no"),
        ((F.col("l_partkey") * 13) % 200).cast("double").alias("x"),
        ((F.col("l_suppkey") * 29 + F.col("l_linenumber") * 7) % 150).cast("double").alias("y"),
        (F.lit(20) + F.col("l_quantity") * 4).alias("width"),
        (F.lit(20) + (F.col("l_partkey") % 50) * 4).cast("double").alias("height"),
        (F.col("l_discount") * 10).alias("score"))


def colour_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 256).cast("int").alias("r"),
        ((F.col("l_suppkey") * 11 + F.col("l_orderkey")) % 256).cast("int").alias("g"),
        ((F.col("l_orderkey") * 5) % 256).cast("int").alias("b"))


CTES = {
    "T": """T AS (SELECT user_id AS clip_id, event_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
       epoch_us(ts) AS pts_us, CAST(3600000000 AS BIGINT) AS dur_us, event_type AS kind, value,
       value / 500 AS heap_ratio, event_id % 6 AS codec_queue, event_id % 4 AS write_backlog,
       least(5, CAST(floor(value / 25) AS INT)) AS status
     FROM events)""",
    "V": """V AS (SELECT CAST(label AS BIGINT) AS clip_id,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, vec_id, 8 AS pw, 8 AS ph,
       [CAST(floor(greatest(0.0, least(255.0, (CAST(x AS DOUBLE) + 0.6) / 1.2 * 255.0)) + 0.5) AS INT)
        FOR x IN embedding] AS luma
     FROM embeddings)""",
    "A": """A AS (SELECT CAST(label AS BIGINT) AS clip_id,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS block_no, vec_id,
       (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 1000000 AS ts_us,
       64 AS rate, [CAST(x AS DOUBLE) FOR x IN embedding] AS samples
     FROM embeddings)""",
    "C": """C AS (SELECT l_orderkey * 10 + l_linenumber AS clip_id,
       CAST(320 + (l_partkey % 40) * 96 AS INT) AS width, CAST(240 + (l_suppkey % 30) * 72 AS INT) AS height,
       CAST(CASE l_linenumber % 5 WHEN 0 THEN 24.0 WHEN 1 THEN 25.0 WHEN 2 THEN 30.0 WHEN 3 THEN 50.0
            ELSE 60.0 END AS DOUBLE) AS fps,
       l_quantity AS duration_s, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS size_bytes,
       CASE l_returnflag WHEN 'A' THEN 'avc1.64002a' WHEN 'N' THEN 'vp09.00.40.08' ELSE 'avc3.640028' END AS codec,
       l_linestatus = 'O' AS has_audio,
       CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_partkey % 7 = 0 THEN 'opus' ELSE 'mp4a.40.2' END END AS audio_codec
     FROM lineitem)""",
    "M": """M AS (SELECT l_orderkey AS clip_id, l_linenumber AS sample_no,
       l_discount * 10 AS exposure, (l_orderkey % 150) / CAST(100 AS DOUBLE) AS contrast, l_tax * 10 AS noise,
       l_quantity / 50 AS detail, (l_partkey % 100) / CAST(100 AS DOUBLE) AS blocking,
       (l_suppkey % 10) / CAST(10 AS DOUBLE) AS banding, (l_partkey % 37) / CAST(37 AS DOUBLE) AS saturation
     FROM lineitem)""",
    "S": """S AS (SELECT o_orderkey AS session_id, o_custkey AS owner,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'aborted' END AS status,
       o_orderkey % 500 AS frames_written, CAST(floor(o_totalprice * 100) AS BIGINT) AS bytes,
       epoch_us(o_orderdate) AS last_access_us, o_orderkey % 17 = 0 AS pinned
     FROM orders)""",
    "D": """D AS (SELECT doc_id AS artifact_id, sha256(text) AS actual_sha256,
       CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN sha256('x') ELSE sha256(text) END AS expected_sha256
     FROM documents)""",
    "B": """B AS (SELECT l_orderkey % 100 AS clip_id, l_orderkey // 100 AS frame_no,
       (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 1000000 + l_suppkey AS box_no,
       CAST((l_partkey * 13) % 200 AS DOUBLE) AS x,
       CAST((l_suppkey * 29 + l_linenumber * 7) % 150 AS DOUBLE) AS y,
       20 + l_quantity * 4 AS width, CAST(20 + (l_partkey % 50) * 4 AS DOUBLE) AS height, l_discount * 10 AS score
     FROM lineitem)""",
    "P": """P AS (SELECT l_orderkey * 10 + l_linenumber AS sample_id,
       CAST((l_partkey * 7 + l_linenumber) % 256 AS INT) AS r,
       CAST((l_suppkey * 11 + l_orderkey) % 256 AS INT) AS g, CAST((l_orderkey * 5) % 256 AS INT) AS b
     FROM lineitem)""",
}


def sql(bindings: str, body: str) -> str:
    """A statement whose leading common table expressions are the named bindings.

    ``body`` is a SELECT, or ``name AS (...), ... SELECT`` when it starts with more expressions.
    """
    parts = ",\n".join(CTES[b] for b in bindings)
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {parts}{glue}{body}"
