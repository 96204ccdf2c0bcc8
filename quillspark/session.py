"""Session factory and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", name: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on (UTC, adaptive plans)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset: a temporary one in local mode, an error on a cluster."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name for a folder of intermediate tables, which every executor can read and write."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with files that every executor can read and that outlive any of them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """df, whose rows are stored, read by no more tasks than there are cores. The driver keeps something of each task, and stored rows are often few in many parts."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df, whose rows are stored, has at most so many."""
    return gathered(df).limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A durable df, marked for broadcast if it has at most so many rows; else joins shuffle as usual. For narrow rows of fixed width."""
    df = durable(df)
    return F.broadcast(gathered(df)) if at_most(df, rows) else df


#: Rows of a task where sorts, windows and aggregates follow on one another. Adaptive plans put tasks together by compressed bytes, of which narrow rows of rising keys have few, so memory of a task
#: would grow with the table up to gigabytes.
TASK_ROWS = 200_000


def task_count(spark: SparkSession, rows: int) -> int:
    """How many tasks rows go to: as many as there are cores, more if a task had more than TASK_ROWS."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """df dealt by a hash of columns to tasks of about TASK_ROWS rows, which adaptive plans leave so. rows (counted, if not given): how many df has, about."""
    return df.repartition(task_count(df.sparkSession, df.count() if rows is None else rows), *by)


def together(df: DataFrame) -> DataFrame:
    """A durable df, in one task if it has at most TASK_ROWS rows, so that what groups and joins it needs no exchange; else as it is. For narrow rows of fixed width."""
    df = durable(df)
    return df.coalesce(1) if at_most(df, TASK_ROWS) else df


#: Bytes and rows of an Arrow batch between Spark and Python tasks.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows, unless the session's settings are stricter: both sides of a task hold whole batches."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.removeprefix("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context, for functions that run in Python tasks."""
    small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillspark-")  # the driver's file server hands the archive out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/quillspark", "zip", package.parent, package.name))
    context._quillspark_shipped = True
