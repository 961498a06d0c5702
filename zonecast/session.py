"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def utc(spark: SparkSession) -> SparkSession:
    """All calendar logic is UTC; pin the session zone once."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(app: str = "zonecast", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; clusters bring their own."""
    return utc(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ZONECAST_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints, with the scheme of its file system.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only a local master without one gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="zonecast-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()  # as Spark resolved it, so executors read it from where Spark writes it


def run_together(tasks: list) -> list:
    """Run independent fits from driver threads, so their Spark jobs share the cluster; results keep the order."""
    if len(tasks) == 1:
        return [tasks[0]()]
    run = inheritable_thread_target(SparkSession.active())(lambda t: t())
    with ThreadPool(len(tasks)) as pool:
        return pool.map(run, tasks)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage reliably, so a lost executor does not replay an iterative fit."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
