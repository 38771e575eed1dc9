"""Session settings that the engine's results rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """UTC timestamps, adaptive plans and Arrow exchange; sizes are left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: ``spark.checkpoint.dir``, or, on one machine where that is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
