"""Chronological splits per user or by calendar, and what the parts have in common."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickgrain.operators.ordered import Running, running
from clickgrain.operators.skew import find_hot, left_join


def ranked_history(log: DataFrame, time: str = "event_time", hot_rows: int | None = None) -> DataFrame:
    """Adds ``total_interactions`` and ``interaction_rank`` (1 = oldest) per user.

    Rows without a user drop out. Events at one instant go by a hash of the rest of the row, so the
    rank is the same for every file layout.
    """
    known = log.filter(F.col("user_id").isNotNull())
    hot = find_hot(known, {"user": ["user_id"]}, min_rows=hot_rows)["user"]
    rest = [c for c in log.columns if c not in ("user_id", time)]
    order = [F.col(time), F.xxhash64(*rest)]
    if hot:
        totals = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_interactions"))
        counted = left_join(known, totals, ["user_id"], hot)
    else:
        counted = known.withColumn("total_interactions", F.count(F.lit(1)).over(W.partitionBy("user_id")))
    return running(counted, ["user_id"], order, [Running("interaction_rank", "number")], hot)


def _first_of(cases: Sequence[tuple[Column, str]], rest: str) -> Column:
    """The name of the first condition that holds."""
    chosen = None
    for condition, name in cases:
        chosen = F.when(condition, name) if chosen is None else chosen.when(condition, name)
    return F.lit(rest) if chosen is None else chosen.otherwise(rest)


def part_of(cutoffs: Sequence[tuple[str, float]], rest: str) -> Column:
    """Name of the first part whose share of the user's history reaches the row."""
    reached = [(F.col("interaction_rank") <= F.col("total_interactions") * share, name) for name, share in cutoffs]
    return _first_of(reached, rest)


def split_history(
    log: DataFrame,
    cutoffs: Sequence[tuple[str, float]] = (("train", 0.8),),
    rest: str = "test",
    above: int = 10,
    time: str = "event_time",
    hot_rows: int | None = None,
) -> DataFrame:
    """Users with more than ``above`` events; adds ``interaction_rank`` and ``split``."""
    ranked = ranked_history(log, time, hot_rows).filter(F.col("total_interactions") > above)
    return ranked.withColumn("split", part_of(cutoffs, rest)).drop("total_interactions")


def train_flag(
    log: DataFrame,
    share: float = 0.7,
    above: int = 3,
    all_train_upto: int = 2,
    time: str = "event_time",
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds ``is_train``; users with at most ``all_train_upto`` events are in train as a whole."""
    ranked = ranked_history(log, time, hot_rows).filter(F.col("total_interactions") > above)
    early = F.col("interaction_rank") <= F.col("total_interactions") * share
    small = F.col("total_interactions") <= all_train_upto
    return ranked.withColumn("is_train", early | small).drop("total_interactions")


def calendar_split(
    log: DataFrame, ends: Sequence[tuple[str, datetime.datetime]], rest: str = "test", time: str = "event_time"
) -> DataFrame:
    """Adds ``split``: the first part that ends after the event."""
    return log.withColumn("split", _first_of([(F.col(time) < F.lit(end), name) for name, end in ends], rest))


def write_parts(split: DataFrame, path: str, names: Sequence[str] = ("train", "test")) -> dict[str, str]:
    """All parts in one pass, one folder each; returns the folder per part of ``names``, the parts of the split."""
    split.write.mode("overwrite").partitionBy("split").parquet(path)
    return {name: f"{path}/split={name}" for name in names}


def split_parts(split: DataFrame, names: Sequence[str] = ("train", "test")) -> dict[str, DataFrame]:
    return {name: split.filter(F.col("split") == name) for name in names}


def coverage(split: DataFrame, columns: Mapping[str, str], names: Sequence[str]) -> DataFrame:
    """For each id column and ordered pair of parts: ids of the left one, common ids, ids it has alone.

    Ids are folded to one row with a flag per part first, so every pair comes from the same shuffle.
    """
    reports = []
    for noun, column in columns.items():
        flags = split.groupBy(column).agg(*[F.bool_or(F.col("split") == n).alias(f"in_{n}") for n in names])
        known = flags.filter(F.col(column).isNotNull())
        pairs = [(a, b) for a in names for b in names if a != b]
        counts = []
        for a, b in pairs:
            left, right = F.col(f"in_{a}"), F.col(f"in_{b}")
            counts.append(
                F.struct(
                    F.lit(noun).alias("id"),
                    F.lit(a).alias("part"),
                    F.lit(b).alias("other"),
                    F.count_if(left).alias("ids"),
                    F.count_if(left & right).alias("common"),
                    F.count_if(left & ~right).alias("alone"),
                )
            )
        reports.append(known.agg(F.array(*counts).alias("rows")).select(F.inline("rows")))
    report = reports[0]
    for more in reports[1:]:
        report = report.unionByName(more)
    return report
