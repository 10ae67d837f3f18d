"""The interaction log derived from the ``events`` and ``part`` test tables.

The rules, including the faults seeded for the cleaning steps, are listed in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    at = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    copies = F.when(F.col("event_id") % 100 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        events.join(part, F.col("k") == F.col("p_partkey"))
        .withColumn("copy", F.explode(copies))
        .select(
            at.alias("event_time"),
            F.when(F.col("event_type") == "click", "cart")
            .when(F.col("event_type") == "error", "remove_from_cart")
            .otherwise(F.col("event_type"))
            .alias("event_type"),
            F.col("k").cast("string").alias("product_id"),
            F.col("p_type").alias("category_id"),
            F.lit(None).cast("string").alias("category_code"),
            F.when(F.col("k") % 7 != 0, F.col("p_brand")).alias("brand"),
            F.when(F.col("event_id") % 50 == 0, -F.col("value")).otherwise(F.col("value")).alias("price"),
            user.alias("user_id"),
            F.when(F.col("event_id") % 97 != 0, F.concat_ws("-", user, F.date_format(at, "yyyyMMdd"))).alias(
                "user_session"
            ),
        )
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase-only log from orders, lines and parts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("l_linenumber")).alias(
                "event_time"
            ),
            F.lit("purchase").alias("event_type"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("p_type").alias("category_id"),
            F.lit(None).cast("string").alias("category_code"),
            F.col("p_brand").alias("brand"),
            F.col("l_extendedprice").alias("price"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderkey").cast("string").alias("user_session"),
        )
    )
