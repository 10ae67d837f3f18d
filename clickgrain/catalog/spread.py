"""Operators with the rows of hot keys spread over several tasks, against the same SQL as without.

``HOT`` is set so low that most keys of the test tables count as hot.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clickgrain.catalog.base import ORACLES, parked_clean, query
from clickgrain.catalog.visits import parked_visits
from clickgrain.functions import PURCHASE, VIEW, is_event
from clickgrain.operators import cleaning, splits, visits
from clickgrain.operators.skew import find_hot
from clickgrain.plans import mlprep, store
from clickgrain.session import park
from clickgrain.sources.testlog import event_log

HOT = 20


def spread(key: str):
    return query(f"{key}_spread", ORACLES[key])


@spread("sp1_two_way_split")
def sp1(spark, sf_dir):
    rows = parked_clean(spark, sf_dir).withColumnRenamed("event_time", "event_timestamp")
    return splits.split_history(rows, time="event_timestamp", hot_rows=HOT)


@spread("sa1_rows_with_session_purchase")
def sa1(spark, sf_dir):
    return visits.with_session_purchase(parked_visits(spark, sf_dir), hot_rows=HOT)


@spread("sa2_views_before_purchase")
def sa2(spark, sf_dir):
    return visits.views_before_purchase(parked_visits(spark, sf_dir), hot_rows=HOT)


@spread("cl15_backfill_brand")
def cl15(spark, sf_dir):
    log = park(event_log(spark, sf_dir), "log")
    return cleaning.backfill_brand(log, find_hot(log, {"product": ["product_id"]}, min_rows=HOT)["product"])


@spread("jn8_as_of_join")
def jn8(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    bought = rows.filter(is_event(PURCHASE)).select("user_id", "event_time", "product_id")
    seen = rows.filter(is_event(VIEW)).select(
        "user_id", "event_time", F.col("product_id").alias("viewed_product"), F.col("price").alias("viewed_price")
    )
    hot = find_hot(rows, {"user": ["user_id"]}, min_rows=HOT)["user"]
    return store.as_of(bought, seen, ["user_id"], ["viewed_product", "viewed_price"], "event_time", hot)


@spread("ml1_indexed_rows")
def ml1(spark, sf_dir):
    rows = parked_clean(spark, sf_dir, removals=True)
    labels = park(mlprep.frequency_index(rows.filter("event_type = 'purchase'"), "user_session"), "labels")
    hot = find_hot(rows, {"keys": ["user_session"]}, min_rows=HOT)["keys"]
    indexed = mlprep.with_index(rows, labels, "user_session", hot=hot)
    return indexed.select("user_id", "product_id", "event_time", "event_type", "user_session_index")
