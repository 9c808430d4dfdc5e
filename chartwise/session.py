"""Spark session set-up shared by the library, the tests and the bench.

Everything that changes results (time zone) or scale behaviour (AQE, skew
handling, partition sizing, checkpoint folder) is configured here once.
On a cluster the session usually exists already; ``configure`` then only
fills in settings that are unset, so a cluster's own choices win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session needs for correct results: the driver's parquet
# timestamps are wall-clock (NTZ) values, and all epoch arithmetic assumes UTC.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}

# Scale settings: adaptive execution re-plans joins and partition counts
# from measured shuffle sizes, splits skewed partitions, and coalesces tiny
# ones. They are defaults only; a cluster's session keeps its own values.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply required settings and fill in unset defaults on ``spark``."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only when it is unset
    (local tests) is a fresh scratch folder created and registered; a
    cluster without the setting is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="chartwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "chartwise") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHARTWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
