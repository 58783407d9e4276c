"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "framelake") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you already have."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Methods over 8000 bytes are never compiled by the JVM; wide expressions run faster split up.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config(STATE_STORE_CONF, ROCKSDB_PROVIDER)
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only when that is unset (tests, one
    machine) is a temporary folder made, and it is then kept for the whole session.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Points DataFrame.checkpoint() at the shared folder unless the cluster already did."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))
