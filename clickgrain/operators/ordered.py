"""Row numbers, running sums, lags and last values per key in time order.

A window keeps one key on one task. For hot keys (and for an order over the whole table) the rows
are range-partitioned by key and order instead, each slice is scanned on its own, and what earlier
slices add up to is carried in from a table with one row per key and slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickgrain.operators.skew import Hot, mark_hot
from clickgrain.session import park

# Rows that a slice may well hold: a task sorts and scans them in seconds.
SLICE_ROWS = 500_000


@dataclass(frozen=True)
class Running:
    """``kind`` is ``number``, ``sum``, ``last`` (not null, this row included) or ``lag``."""

    out: str
    kind: str
    column: str | None = None


def _within(spec: Running, by_order, up_to_here) -> Column:
    if spec.kind == "number":
        return F.row_number().over(by_order).cast("long")
    if spec.kind == "sum":
        return F.sum(spec.column).over(up_to_here)
    if spec.kind == "last":
        return F.last(spec.column, ignorenulls=True).over(up_to_here)
    if spec.kind == "lag":
        return F.lag(spec.column).over(by_order)
    raise ValueError(f"unknown kind {spec.kind}")


def _windows(keys: Sequence[str], order: Sequence[Column]):
    by_order = W.partitionBy(*keys).orderBy(*order)
    return by_order, by_order.rowsBetween(W.unboundedPreceding, W.currentRow)


def _number_sums(specs: Sequence[Running]) -> bool:
    return all(s.kind in ("number", "sum") for s in specs)


def in_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], specs: Sequence[Running], slices: int
) -> DataFrame:
    """The scan for keys of any size: every slice is one task, whatever key its rows belong to."""
    kept = df.columns
    ranged = df.withColumn("slice_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(slices, *[F.col(k) for k in keys], *order, F.col("slice_tie"))
    # Written out: the ranges come from a sample, and both uses below must see the same ones.
    ranged = park(ranged.withColumn("slice", F.spark_partition_id()), "slices")

    slice_keys = [*keys, "slice"]
    by_order, up_to_here = _windows(slice_keys, [*order, F.col("slice_tie")])
    numbered = ranged.withColumn("slice_row", F.row_number().over(by_order))
    for spec in specs:
        numbered = numbered.withColumn(f"in_{spec.out}", _within(spec, by_order, up_to_here))

    totals, carried = [F.count(F.lit(1)).alias("slice_rows")], []
    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    if not keys:
        earlier = W.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("slice_row")
    for spec in specs:
        carry = f"before_{spec.out}"
        if spec.kind == "number":
            totals.append(F.count(F.lit(1)).alias(carry))
            carried.append(F.sum(carry).over(earlier).alias(carry))
        elif spec.kind == "sum":
            totals.append(F.sum(spec.column).alias(carry))
            carried.append(F.sum(carry).over(earlier).alias(carry))
        elif spec.kind == "last":
            present = F.when(F.col(spec.column).isNotNull(), place)
            totals.append(F.max_by(spec.column, present).alias(carry))
            carried.append(F.last(carry, ignorenulls=True).over(earlier).alias(carry))
        else:
            totals.append(F.max_by(spec.column, place).alias(carry))
            carried.append(F.last(carry).over(earlier).alias(carry))
    # One row per (hot key, slice) that share rows: at most keys + slices rows, so it fits anywhere.
    source = ranged if _number_sums(specs) else numbered
    carries = source.groupBy(*slice_keys).agg(*totals).select(*slice_keys, *carried)
    renamed = carries.withColumnsRenamed({k: f"carry_{k}" for k in slice_keys})
    same = [F.col(k).eqNullSafe(F.col(f"carry_{k}")) for k in slice_keys]
    joined = numbered.join(F.broadcast(renamed), same, "left")

    for spec in specs:
        inside, before = F.col(f"in_{spec.out}"), F.col(f"before_{spec.out}")
        if spec.kind == "number":
            value = inside + F.coalesce(before, F.lit(0))
        elif spec.kind == "sum":
            value = F.when(inside.isNull(), before).otherwise(inside + F.coalesce(before, F.lit(0)))
        elif spec.kind == "last":
            value = F.coalesce(inside, before)
        else:
            value = F.when(F.col("slice_row") == 1, before).otherwise(inside)
        joined = joined.withColumn(spec.out, value)
    return joined.select(*kept, *[s.out for s in specs])


def slices_of(hot: Hot, partitions: int) -> int:
    """How many slices the rows of hot keys are cut into.

    Two per share of a hot key, as ranges drawn from a sample are not all of one size; but a share may be
    a few rows and the keys many, and a slice is a task and a file. So no more than a shuffle has
    partitions, unless slices of ``SLICE_ROWS`` need more. A slice holds rows of many keys where those are small.
    """
    needed = math.ceil(getattr(hot, "rows", 0) / SLICE_ROWS)
    return max(2, min(2 * sum(hot.values()), max(partitions, needed)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    specs: Sequence[Running],
    hot: Hot | None = None,
) -> DataFrame:
    """Adds the ``specs`` columns; keys in ``hot`` take the sliced way, the others a plain window."""
    by_order, up_to_here = _windows(keys, order)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns({s.out: _within(s, by_order, up_to_here) for s in specs})

    if not hot:
        return plain(df)
    marked = mark_hot(df, keys, hot)
    cold = marked.filter(F.col("hot_parts").isNull()).drop("hot_parts")
    large = marked.filter(F.col("hot_parts").isNotNull()).drop("hot_parts")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plain(cold).unionByName(in_slices(large, keys, order, specs, slices_of(hot, partitions)))


def global_number(df: DataFrame, order: Sequence[Column], out: str, slices: int | None = None) -> DataFrame:
    """Row number over the whole table without bringing it to one task."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_slices(df, [], order, [Running(out, "number")], slices=count)


def sort_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Global sort. Rows with equal sort values may be divided between tasks, however many they are."""
    return df.withColumn("sort_tie", F.monotonically_increasing_id()).orderBy(*columns, "sort_tie").drop("sort_tie")
