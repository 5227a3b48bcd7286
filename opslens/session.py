"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every session gets. Sized for a cluster by default; tests and the
# bench override the partition count for local mode.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also where splitting a hot key costs the aggregate above it a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # broadcast only what the planner measured to be small; the threshold is
    # the size check (10 MB is Spark's default, stated here on purpose)
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # AQE sizes post-shuffle partitions to ~256 MB, so a generous shuffle
    # partition count on a cluster is coalesced instead of producing tiny tasks
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app_name: str = "opslens") -> SparkSession:
    """Return the active session or build one with :data:`BASE_CONF`.

    ``master``/``partitions`` are only for local runs; on a cluster the
    submitter decides both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, or the
    one that the program gave to ``setCheckpointDir``."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, asked of its own file system. A read that
    fails for any other reason raises, and is never taken for a missing path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the configured checkpoint dir; set one only where none is set
    (local tests). Never overrides what the cluster configured."""
    d = checkpoint_dir(spark)
    if d is None:
        # only a local master may go without a shared folder (tests)
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = fallback or os.environ.get("OPSLENS_LOCAL_CHECKPOINT", "/tmp/opslens-checkpoints")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - a core setting some sessions do not allow changing at runtime
            pass
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d
