"""Session and visit analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.functions import PURCHASE, VIEW, is_event, seconds_between
from clickgrain.operators.cleaning import drop_category_code, drop_missing_session, fill_brand
from clickgrain.operators.grains import SESSION_KEYS
from clickgrain.operators.ordered import Running, running
from clickgrain.operators.skew import find_hot, left_join


# Purchases of one instant that one row stands for while they are dealt over the tasks.
PORTION = 1000


def visit_log(log: DataFrame) -> DataFrame:
    """The log as the visit questions read it: copies and removals stay in."""
    return log.transform(drop_category_code).transform(fill_brand).transform(drop_missing_session)


def with_session_purchase(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Adds ``session_purchase``: whether the row's session holds a purchase."""
    hot = find_hot(log, {"session": SESSION_KEYS}, min_rows=hot_rows)["session"]
    flags = log.groupBy(*SESSION_KEYS).agg(
        F.coalesce(F.bool_or(is_event(PURCHASE)), F.lit(False)).alias("session_purchase")
    )
    return left_join(log, flags, SESSION_KEYS, hot, null_safe=True)


def views_before_purchase(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per purchase: views of its session up to and including its instant.

    Events of one instant are folded first: they see the same views, and a crowded instant becomes
    one row of the running sum.
    """
    moment_keys = [*SESSION_KEYS, "event_time"]
    moments = log.groupBy(*moment_keys).agg(
        F.count_if(is_event(VIEW)).alias("views"), F.count_if(is_event(PURCHASE)).alias("purchases")
    )
    hot = find_hot(log, {"session": SESSION_KEYS}, min_rows=hot_rows)
    summed = running(
        moments, SESSION_KEYS, [F.col("event_time")], [Running("views_before_purchase", "sum", "views")], hot["session"]
    )
    # Each instant's row is repeated once per purchase: in portions that are dealt over the tasks first.
    buying = summed.filter("purchases > 0")
    last = F.floor((F.col("purchases") - 1) / PORTION)
    portions = buying.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    held = F.least(F.lit(PORTION).cast("long"), F.col("purchases") - F.col("portion") * PORTION).cast("int")
    dealt = portions.withColumn("held", held).repartition(*moment_keys, "portion")
    each = dealt.withColumn("purchase", F.explode(F.array_repeat(F.lit(1), F.col("held"))))
    return each.select(*SESSION_KEYS, "views_before_purchase")


def daily_sessions(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", F.to_date("event_time").alias("date")).agg(
        F.count_distinct("user_session").alias("distinct_sessions")
    )


def active_days(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(F.count_distinct(F.to_date("event_time")).alias("daily_visit_frequency"))


def weekly_sessions(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", F.weekofyear("event_time").alias("week")).agg(
        F.count_distinct("user_session").alias("distinct_sessions")
    )


def active_weeks(log: DataFrame, with_year: bool = False) -> DataFrame:
    """Distinct ISO week numbers per user; ``with_year`` tells week 1 of two years apart."""
    week = F.weekofyear("event_time")
    if with_year:
        week = F.extract(F.lit("YEAROFWEEK"), F.col("event_time")) * 100 + week
    return log.groupBy("user_id").agg(F.count_distinct(week).alias("weekly_visit_frequency"))


def with_time_diff(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Adds ``time_diff``: seconds since the previous event of the session, 0 for the first."""
    hot = find_hot(log, {"session": SESSION_KEYS}, min_rows=hot_rows)["session"]
    previous = Running("previous_time", "lag", "event_time")
    lagged = running(log, SESSION_KEYS, [F.col("event_time")], [previous], hot)
    gap = seconds_between(F.col("previous_time"), F.col("event_time"))
    return lagged.withColumn("time_diff", F.coalesce(gap, F.lit(0))).drop("previous_time")


def session_lengths(log: DataFrame) -> DataFrame:
    """Sum of the gaps within a session, which is its last second minus its first: no ordering needed."""
    length = seconds_between(F.min("event_time"), F.max("event_time")).cast("double")
    return log.groupBy(*SESSION_KEYS).agg(length.alias("session_length"))


def average_session_length(log: DataFrame) -> DataFrame:
    return session_lengths(log).groupBy("user_id").agg(F.avg("session_length").alias("average_session_length"))
