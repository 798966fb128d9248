"""Session defaults and durable intermediate results."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and time zone UTC; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Texts are small beside the work on them, so small partitions are worth a task of their own.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder in spark.checkpoint.dir; a local one only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lodestrata-checkpoints"))


def durable(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and cut its lineage; partitions and their order stay."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
