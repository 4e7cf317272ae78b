"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# SQL settings the operators expect; results depend on the first only.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Joins on (symbol, t) may reuse a partitioning by symbol: a symbol's rows are bounded
    # by the calendar, so this cannot create a hot partition.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Recording a Python call site for every column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_settings(spark: SparkSession) -> None:
    """Set on a running session whatever may still be set there."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster the master, memory and checkpoint folder come from spark-submit;
    only the SQL settings that results depend on are fixed here.
    """
    builder = (
        SparkSession.builder.appName("crosspanel")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_stage_dir: str | None = None


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, where the driver and the executors are
    one process, does a temporary folder stand in; it is kept here, not in the session.
    """
    global _local_stage_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_stage_dir is None:
        _local_stage_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_stage_dir


_staged: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets an operator
    that passes over its input several times pay for that input once.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.staged_path = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(stored: DataFrame) -> None:
    """Delete a table that ``stage`` wrote and that nothing reads any more."""
    _delete(stored.sparkSession, stored.staged_path)
    _staged.remove(stored.staged_path)


def release_all(spark: SparkSession) -> None:
    """Delete every staged table of this process: for the end of a run, when results are written."""
    while _staged:
        _delete(spark, _staged.pop())
