"""Session construction and the two settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

MARKET_ZONE = "Asia/Dhaka"


def local_session(app: str = "barwright", cores: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a session that runs in one process (tests, a
    laptop) may go without; elsewhere a temporary folder would be a different one on each machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="run-barwright-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared checkpoint folder; Spark creates it on write."""
    return f"{checkpoint_dir(spark)}/run-{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
