"""Spark session construction and a few session-level helpers.

Everything that depends on the cluster (checkpoint folder, partition
counts) is read from the session; defaults are only filled in where the
setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Settings every riskflow job relies on. AQE gives runtime re-planning:
# coalescing of small shuffle partitions, skew-join splitting and the
# runtime (size-checked) switch from sort-merge to broadcast joins.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    # broadcast only what AQE has measured at runtime to be small
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "riskflow", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or build) the session with riskflow's base settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    if not spark.sparkContext.master.startswith("local"):
        ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it is not installed on them."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="riskflow-ship-"), "riskflow"), "zip",
                                  os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)          # the driver serves it; nothing is read from its folder


def configure(spark: SparkSession) -> SparkSession:
    """Apply riskflow's runtime SQL settings to a session built elsewhere
    (time zone, AQE, skew join) and make sure a checkpoint folder is set."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            if spark.conf.isModifiable(k):         # the static ones belong to whoever built the session
                spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def reliable(df):
    """Cut the lineage of a reused intermediate: ``checkpoint()`` writes it to
    the shared checkpoint folder, so a lost executor does not force a
    recomputation of everything upstream."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written as Parquet to the shared folder and read back: like ``reliable``, with
    column statistics, column pruning, and sizes that the planner sees."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints / intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only when the setting is absent (local runs, tests) a
    scratch folder is created and registered.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="riskflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:          # one that the user has set stays
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def ts_lit(value: str) -> Column:
    """A TIMESTAMP_NTZ literal (driver tables carry zone-less timestamps)."""
    return F.to_timestamp_ntz(F.lit(value))
