"""Session settings, lineage cuts and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # work on long texts takes smaller batches and says so itself
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "trendloom", master: str | None = None,
                  **config: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **config}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    Only a local session without one gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="trendloom-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "saved") -> DataFrame:
    """Save `df` as a table in the shared folder and go on from there.

    Later uses, and lost executors, do not recompute it, and they read only
    the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
