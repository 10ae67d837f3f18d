"""Invariants of the feature table. Its values are compared with SQL in test_oracles."""

import pytest
from pyspark.sql import functions as F

from clickgrain.catalog.base import parked_clean
from clickgrain.operators.splits import split_history
from clickgrain.plans.features import feature_table
from clickgrain.session import park


@pytest.fixture(scope="module")
def cleaned(spark, sf_dir):
    return parked_clean(spark, sf_dir)


@pytest.fixture(scope="module")
def table(cleaned):
    return park(feature_table(cleaned), "features")


def test_every_event_has_one_row(cleaned, table):
    assert table.count() == cleaned.count()


def test_value_ranges(table):
    outside = table.filter(
        ~F.col("popularity_percentile").between(0, 1)
        | (F.abs(F.pow("hour_sin", 2) + F.pow("hour_cos", 2) - 1) > 1e-9)
        | (F.col("Recency") < 0)
        | (F.col("total_purchase_by_user") != F.col("Frequency"))
        | F.col("interaction_score").isNull()
    )
    assert outside.count() == 0


def test_split_is_disjoint_and_in_time_order(table):
    split = split_history(table, time="event_timestamp")
    assert split.filter("split NOT IN ('train', 'test')").count() == 0
    edges = split.groupBy("user_id").agg(
        F.max(F.when(F.col("split") == "train", F.col("event_timestamp"))).alias("last_train"),
        F.min(F.when(F.col("split") == "test", F.col("event_timestamp"))).alias("first_test"),
    )
    assert edges.filter("last_train > first_test").count() == 0
