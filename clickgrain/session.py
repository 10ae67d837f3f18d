"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

SHUFFLES_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folder: str | None = None


def build_session(app: str = "clickgrain", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A machine-local folder is only taken on a local master, and only where the setting is absent.
    """
    global _local_folder
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="clickgrain-")
    return _local_folder


def park(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and go on from the written table.

    This cuts the lineage at a file every executor can reach, so a lost executor costs one re-read
    and not the whole history; later steps also prune columns in the scan.
    """
    target = path or new_folder(df.sparkSession, label)
    with _shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executions begun within it delete their shuffle files at their end: nothing goes on from them."""
    before = spark.conf.get(SHUFFLES_FREED, "false")
    spark.conf.set(SHUFFLES_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_FREED, before)


def discard(parked: DataFrame) -> None:
    """Deletes a parked table. Call it when all that was made of it has been written."""
    spark, files = parked.sparkSession, parked.inputFiles()
    folders = {f.rpartition("/")[0] for f in files}
    for folder in folders:
        if f"/clickgrain/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"{folder} is not a parked table of this application")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the work folder, under the name of the application."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/clickgrain/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete everything this application has parked. Call it when no result is read any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns ``path`` (local, HDFS, object store) whether it exists."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
