"""Idempotent stage outputs: immutable data folders, named by a log of versions.

A stage's rows are written to a folder of their own. What makes them the stage's output is one small file, the next version of the log, with
the folder and its index row. A version is created at once and only if nobody else has created it, so a reader sees the old output or the
new one, never data without an index row or half of either.

Writers are optimistic: a writer remembers the version at which it began. If others have taken the next version by the time it commits, it
reads theirs: versions of other stages only move its number on; one of its own stage means that it has lost, and it says so. The folder of
a writer that lost or died is named nowhere; ``unnamed_folders`` lists such folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.text import sanitize_name

INDEX_SCHEMA = ("name STRING, session_id STRING, stage_key STRING, bytes BIGINT, row_count BIGINT, created_at_us BIGINT, "
                "last_access_us BIGINT, pinned BOOLEAN")
LOG_SCHEMA = f"version BIGINT, folder STRING, {INDEX_SCHEMA}"


class StageConflict(RuntimeError):
    """Another writer has committed the same stage since this one began."""


def _log(path: str) -> str:
    return f"{path}/log"


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = context.Path(path)
    return context, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version; 0 where nothing has been committed."""
    _, folder, system = _files(spark, _log(path))
    if not system.exists(folder):
        return 0
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)


def _create(spark: SparkSession, path: str, version: int, row: dict) -> bool:
    """Puts a whole version file in place; False if that version exists."""
    context, folder, system = _files(spark, _log(path))
    system.mkdirs(folder)
    waiting, final = context.Path(folder, f".{uuid.uuid4().hex}.tmp"), context.Path(folder, f"{version:020d}.json")
    out = system.create(waiting, False)
    out.write((json.dumps({"version": version, **row}) + "\n").encode())
    out.close()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:  # a rename that does not overwrite is the one step that decides
        context.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(waiting, final, none)
        return True
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        system.delete(waiting, False)
        return False


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Every committed version."""
    if latest_version(spark, path) == 0:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(_log(path))


def _of(session_id: str, stage_key: str):
    return (F.col("session_id") == session_id) & (F.col("stage_key") == stage_key)


def commit_stage(spark: SparkSession, path: str, session_id: str, stage_key: str, folder: str, size: int, row_count: int, now_us: int,
                 since: int) -> int:
    """Makes a written folder the stage's output and returns its version; ``since`` is the version at which its writer began."""
    while True:
        log = read_log(spark, path).where(_of(session_id, stage_key))
        seen, created = log.agg(F.max("version"), F.min("created_at_us")).first()
        if seen is not None and seen > since:
            raise StageConflict(f"stage {stage_key} of {session_id} was committed as version {seen} since version {since}")
        row = {"folder": folder, "session_id": session_id, "stage_key": stage_key, "bytes": size, "row_count": row_count,
               "created_at_us": now_us if created is None else created, "last_access_us": now_us, "pinned": False,
               "name": spark.range(1).select(sanitize_name(F.lit(f"stage-{session_id}-{stage_key}"))).first()[0]}
        # the version after the newest one that was looked at: anything between is met by the rename
        version = latest_version(spark, path) + 1
        newer = read_log(spark, path).where(_of(session_id, stage_key) & (F.col("version") > since)) if version > 1 else None
        if newer is not None and not newer.isEmpty():
            continue
        if _create(spark, path, version, row):
            return version


def write_stage_output(df: DataFrame, path: str, session_id: str, stage_key: str, now_us: int, since: int | None = None) -> DataFrame:
    """Replaces the stage's output and returns it.

    Writing the same stage again keeps created_at and moves last_access. ``since`` is the version that the caller's decision to write
    rests on (default: the newest one now); a commit of the same stage after it raises ``StageConflict``.
    """
    spark = df.sparkSession
    since = latest_version(spark, path) if since is None else since
    folder = f"{path}/data/session_id={session_id}/stage_key={stage_key}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    context, target, system = _files(spark, folder)
    size = sum(s.getLen() for s in system.listStatus(target) if s.getPath().getName().endswith(".parquet"))
    commit_stage(spark, path, session_id, stage_key, folder, size, spark.read.parquet(folder).count(), now_us, since)
    return read_stage_output(spark, path, session_id, stage_key)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index row of each stage's newest version."""
    newest = Window.partitionBy("session_id", "stage_key").orderBy(F.col("version").desc())
    names = [part.split()[0] for part in INDEX_SCHEMA.split(", ")]
    return (read_log(spark, path).withColumn("_n", F.row_number().over(newest)).where("_n = 1")
            .select("session_id", "stage_key", *[n for n in names if n not in ("session_id", "stage_key")]))


def read_stage_output(spark: SparkSession, path: str, session_id: str, stage_key: str) -> DataFrame:
    """Rows of the stage as its newest version names them."""
    folder = read_log(spark, path).where(_of(session_id, stage_key)).agg(F.max_by("folder", "version")).first()[0]
    if folder is None:
        raise LookupError(f"no output of stage {stage_key} of {session_id}")
    return spark.read.parquet(folder)


def unnamed_folders(spark: SparkSession, path: str) -> list[str]:
    """Data folders that no stage's newest version names: replaced outputs, and those of writers that lost or died."""
    _, folder, system = _files(spark, f"{path}/data")
    if not system.exists(folder):
        return []
    there = [s.getPath().toUri().getPath() for session in system.listStatus(folder) for stage in system.listStatus(session.getPath())
             for s in system.listStatus(stage.getPath())]
    named = {r[0].removeprefix("file://") for r in read_log(spark, path).groupBy("session_id", "stage_key").agg(F.max_by("folder", "version").alias("f"))
             .select("f").toLocalIterator()}
    return sorted(f for f in there if f not in {n.split(":", 1)[-1] if n.startswith("file:") else n for n in named})
