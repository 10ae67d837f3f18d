"""Sinks: normalised Parquet, result documents, ingestion manifests."""

from __future__ import annotations

import datetime
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickgrain.functions import REMOVAL
from clickgrain.session import path_exists
from clickgrain.sources.readers import file_manifest, read_csv_log


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_day(log: DataFrame, path: str, gather: bool = False) -> None:
    """One folder per event date, rows in time order within each file.

    Rows stay on the task that read them, which suits files that arrive in time order and spares the
    shuffle. ``gather`` brings rows of like times together first; it cuts ranges of time, not days,
    so a busy day is still written by many tasks.
    """
    dated = log.withColumn("event_date", F.to_date("event_time"))
    if gather:
        tie = F.xxhash64(*log.columns)
        dated = dated.repartitionByRange("event_time", tie)
    (
        dated.sortWithinPartitions("event_date", "event_time")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(path)
    )


def normalise_to_parquet(
    spark: SparkSession, csv_paths: str | list[str], path: str, refresh: bool = False, gather: bool = False
) -> str:
    """Turn CSV files into the Parquet log once, without removals from the cart.

    Only a finished log is kept as it is; one that a broken job left half written is written anew.
    """
    if refresh or not path_exists(spark, f"{path}/_SUCCESS"):
        log = read_csv_log(spark, csv_paths)
        write_by_day(log.filter(F.col("event_type") != REMOVAL), path, gather)
    return path


def write_result_json(results: DataFrame, path: str) -> None:
    """Check results are one row per check, so one file is enough."""
    results.coalesce(1).write.mode("overwrite").json(path)


def write_manifest(log: DataFrame, path: str, target: str) -> None:
    (
        file_manifest(log)
        .withColumn("target", F.lit(target))
        .withColumn("ingested_at", F.current_timestamp())
        .write.mode("overwrite")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .json(path)
    )


@dataclass(frozen=True)
class IngestRun:
    """What one run has loaded. Times are UTC."""

    started: datetime.datetime
    ended: datetime.datetime
    seconds: float
    files: int
    rows: int
    first_event: datetime.datetime | None
    last_event: datetime.datetime | None
    source: str
    target: str


def ingest(spark: SparkSession, csv_paths: str | list[str], path: str, manifest: str) -> IngestRun:
    """Loads CSV files into the Parquet log and appends a row about the run to the table ``manifest``.

    Rows and event bounds are observed while the log is written, so nothing is read twice; the files are
    those of the scan. A manifest row is only there when the log has been written to its end. A task
    that runs again is counted once.
    """
    log = read_csv_log(spark, csv_paths)
    seen = Observation("ingest")
    bounds = [F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")]
    started = datetime.datetime.now(datetime.timezone.utc)
    write_parquet(log.observe(seen, F.count(F.lit(1)).alias("rows"), *bounds), path)
    ended = datetime.datetime.now(datetime.timezone.utc)
    found = seen.get
    source = csv_paths if isinstance(csv_paths, str) else ",".join(csv_paths)
    run = IngestRun(
        started, ended, (ended - started).total_seconds(), len(log.inputFiles()), found["rows"], found["first_event"], found["last_event"], source, path
    )
    schema = "started timestamp, ended timestamp, seconds double, files int, rows long, first_event timestamp, last_event timestamp, source string, target string"
    spark.createDataFrame([tuple(asdict(run).values())], schema).write.mode("append").parquet(manifest)
    return run
