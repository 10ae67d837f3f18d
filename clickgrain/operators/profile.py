"""Distributions as tables: summaries, frequencies, histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.operators.ordered import Running, in_slices
from clickgrain.session import park


def describe_column(df: DataFrame, column: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, deviation, extremes and exact interpolated quantiles of a numeric column.

    The column is read once, into distinct values with their counts. Quantiles are read off running
    counts, so neither all values nor all distinct values meet in one task.
    """
    values = df.select(F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    counted = park(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    rows = F.sum("n")
    whole = counted.agg(F.struct((rows - 1).alias("last"), (F.sum(F.col("value") * F.col("n")) / rows).alias("mean"))).scalar()
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = in_slices(counted, [], [F.col("value")], [Running("upto", "sum", "n")], slices)
    summed = summed.withColumns({"last": whole["last"], "mean": whole["mean"]})
    squares = F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2))
    quarters = []
    for q in quantiles:
        place = F.col("last") * q
        low, high = (F.min(F.when(F.col("upto") > at, F.col("value"))) for at in (F.floor(place), F.ceil(place)))
        quarters.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{math.floor(q * 100)}"))
    return summed.agg(
        F.coalesce(rows, F.lit(0)).alias("count"),
        F.max("mean").alias("mean"),
        F.sqrt(F.try_divide(squares, rows - 1)).alias("std"),
        F.min("value").alias("min"),
        *quarters,
        F.max("value").alias("max"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Rows per bin of equal width between the smallest and the largest value; empty bins are left out."""
    values = df.select(F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    low, high = values.agg(F.min("value")).scalar(), values.agg(F.max("value")).scalar()
    position = F.floor(F.try_divide(F.lit(bins) * (F.col("value") - low), high - low)) + 1
    bucket = F.least(F.coalesce(position, F.lit(1)), F.lit(bins)).cast("int")
    width = (high - low) / bins
    return (
        values.withColumn("bin", bucket)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("bin_start", low + width * (F.col("bin") - 1))
    )


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have 1, 2, 3 … rows."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("total_interactions"))
    return sizes.groupBy("total_interactions").agg(F.count(F.lit(1)).alias("count")).orderBy("total_interactions")


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null being one of them."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias("distinct_values"))
