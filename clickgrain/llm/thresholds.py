"""Thresholds that cut every group of rows at a given weight, found without a sort.

Rows carry a key of 60 bits. Weights are summed by group and bucket of the key (at most 1,024
buckets), the bucket in which a group's budget is passed is divided between its lowest and its
highest key into 1,024 again, and so on until it holds one key value. A bucket of no more than 1,024
rows is divided by its key values at once. Every round is one aggregate with map-side sums over the
rows still in question; what is shuffled has at most 1,024 rows a group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickgrain.session import park

KEY_BITS, STEP = 60, 10


def hash_key(*columns: Column) -> Column:
    """60 bits of an MD5, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(*columns)), 1, 15), 16, 10).cast("long")


def cut_points(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(grp, cut, below) from ``rows`` (grp, key, weight) and ``budgets`` (grp, budget).

    The rows with ``key < cut`` weigh ``below``: of all such sums the nearest to the budget, the
    smaller one in a tie. Rows of one key value stay together, so nested budgets take nested rows.
    Pass written tables: ``rows`` is read once a round. Groups without rows are left out. Where
    ``budgets`` has the columns low, high (a group's lowest and highest key) and n (its rows), the
    first round begins between them.
    """
    whole = {"low": F.lit(0), "high": F.lit((1 << KEY_BITS) - 1), "n": F.lit(1 << KEY_BITS)}
    span = [F.col(c) if c in budgets.columns else whole[c].cast("long").alias(c) for c in whole]
    state = _divided(budgets.select("grp", F.col("budget").cast("double"), F.lit(0).cast("long").alias("below"), *span))
    done = None
    by_bucket = Window.partitionBy("grp").orderBy("bucket")
    while True:
        bucket = F.expr("shiftright(key - base, shift)")
        sums = (
            rows.join(state, "grp")
            .filter(F.col("key").between(F.col("base"), F.col("top")))
            .groupBy("grp", "budget", "below", bucket.alias("bucket"))
            .agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"))
        )
        reached = F.col("below") + F.sum("weight").over(by_bucket)
        here = (
            sums.withColumn("reached", reached)
            .withColumn("over", F.col("reached") > F.col("budget"))
            # The first bucket past the budget; without one, the last bucket.
            .withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("over").desc(), F.when(F.col("over"), F.col("bucket")).otherwise(-F.col("bucket")))))
            .filter(F.col("place") == 1)
            .withColumn("before", F.col("reached") - F.col("weight"))
            .withColumn("single", ~F.col("over") | (F.col("low") == F.col("high")))
            .withColumn("take", ~F.col("over") | (F.col("reached") - F.col("budget") < F.col("budget") - F.col("before")))
        )
        here = park(here, "boundary")
        ended = here.filter(F.col("single")).select(
            "grp",
            F.when(F.col("take"), F.col("high") + 1).otherwise(F.col("low")).alias("cut"),
            F.when(F.col("take"), F.col("reached")).otherwise(F.col("before")).cast("long").alias("below"),
        )
        done = ended if done is None else done.unionByName(ended)
        state = _divided(here.filter(~F.col("single")).select("grp", "budget", F.col("before").cast("long").alias("below"), "low", "high", "n"))
        if state.isEmpty():
            break
    return done


def _divided(groups: DataFrame) -> DataFrame:
    """``groups`` (grp, budget, below, low, high, n) with the shift that makes buckets of the keys from low to high."""
    bits = F.length(F.bin(F.col("high") - F.col("low")))
    shift = F.when(F.col("n") <= (1 << STEP), 0).otherwise(F.greatest(bits - STEP, F.lit(0)))
    return groups.select("grp", "budget", "below", F.col("low").alias("base"), F.col("high").alias("top"), shift.alias("shift"))
