"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TAPELOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder of ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's tables and state under ``spark.checkpoint.dir``."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
