"""Session settings and the shared folder that cut lineage and stream state live in."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app_name: str = "skyvane") -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster use the given one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SKYVANE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used, but only on a local master: on a
    cluster a machine-local folder would be lost with its executor.
    """
    root = _checkpoint_root(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoint_root(spark))
    return df.checkpoint()


def settled(df: DataFrame, purpose: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Its lineage is cut as by a checkpoint;
    besides, the planner knows its size before it plans a join, and shuffles nothing to a side
    that turns out to be small. Files of ``rows_per_file`` are dealt evenly to the tasks that read
    them, whatever the sizes of those that wrote."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


_local_root: dict[str, str] = {}


def _checkpoint_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="skyvane-")
    return _local_root[app]
