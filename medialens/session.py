"""Session helpers: UTC, ANSI on, AQE on, no UI."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Sizing for a large cluster (hundreds of executors, tens of TB): splits and shuffle
# partitions of ~256 MB, a generous initial shuffle partition count that AQE coalesces,
# and AQE skew splitting for joins and rebalances.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "medialens", cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session configured the way every operator here expects.

    Locally tests pass ``local[*]`` and a small partition count; on a cluster pass
    ``cluster=True`` for :data:`CLUSTER_CONF` (AQE then sizes the shuffles at run time).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.ansi.enabled", "true")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          # Python call-site capture walks the stack on every Column call; a job that builds
          # plans with hundreds of expressions pays seconds for it on the driver
          .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if cluster:
        for k, v in CLUSTER_CONF.items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there; only a local session (tests) that leaves
    it unset gets one of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="medialens-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written stages and round trips."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
