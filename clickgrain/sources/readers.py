"""Scans: CSV in three schema modes, Parquet, landing zones, unions and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickgrain.sources.schema import log_schema


def read_csv_log(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """All matching files in one scan with a fixed schema; columns go by position."""
    return spark.read.csv(paths, schema=schema or log_schema(), header=True, enforceSchema=True)


def read_csv_inferred(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """For a first look only: inferring types reads the files twice."""
    return spark.read.csv(paths, header=True, inferSchema=True)


def read_parquet_log(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_landing_zone(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Every CSV file below ``root``, however deep the folders are."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(root, schema=schema or log_schema(), header=True)
    )


def union_in_order(*parts: DataFrame) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), parts)


def file_manifest(log: DataFrame) -> DataFrame:
    """One row per file that was read: rows, first and last event."""
    return (
        log.withColumn("file", F.col("_metadata.file_path"))
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("event_time").alias("first_event"),
            F.max("event_time").alias("last_event"),
        )
    )


def stable_sample(df: DataFrame, keys: list[str], per_mille: int = 1, seed: int = 42) -> DataFrame:
    """A sample that depends on the keys alone, so it is the same for every file layout."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), *keys)
    return df.filter(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1000 < per_mille)

