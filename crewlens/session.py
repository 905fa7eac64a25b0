"""Spark session defaults shared by jobs, tests and the bench.

Cluster deployments pass their own settings through ``spark-submit``; the
builder below only fills in what is unset, so a cluster's
``spark.checkpoint.dir`` or shuffle sizing always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on for correct results (not tuning knobs).
REQUIRED_CONF = {
    # timestamps are compared against UTC-naive oracle values
    "spark.sql.session.timeZone": "UTC",
    # ANSI stays on: overflow and bad casts raise instead of turning into nulls
    "spark.sql.ansi.enabled": "true",
}

# Tuning defaults; a cluster config overrides any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast only small dimension-like sides; every explicit broadcast in
    # this package is a one-row or fixed-size table
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # AQE merges small shuffle partitions up to this size and splits skewed ones
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "crewlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the package defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    conf.update(REQUIRED_CONF)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    if shuffle_partitions is None and not spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        # unset by the deployment: size the shuffle to the cluster (AQE then
        # coalesces small partitions), not Spark's fixed default of 200
        spark.conf.set("spark.sql.shuffle.partitions", str(4 * spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local runs and tests) a private scratch folder is created for it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: a cluster run needs a shared folder for checkpoints"
        )
    local_dir = tempfile.mkdtemp(prefix="crewlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local_dir)
    spark.sparkContext.setCheckpointDir(local_dir)
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
