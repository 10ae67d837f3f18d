"""Cleaning steps and the audits around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.functions import CART, PURCHASE, REMOVAL, VIEW, is_event
from clickgrain.operators.skew import Hot, left_join

UNKNOWN_BRAND = "UNKNOWN"


def drop_category_code(log: DataFrame) -> DataFrame:
    return log.drop("category_code")


def fill_brand(log: DataFrame) -> DataFrame:
    return log.na.fill({"brand": UNKNOWN_BRAND})


def flag_missing_brand(log: DataFrame) -> DataFrame:
    """A brand that really reads UNKNOWN counts as missing too."""
    return log.withColumn("is_brand_missing", (F.col("brand") == UNKNOWN_BRAND).cast("int"))


def drop_missing_session(log: DataFrame) -> DataFrame:
    return log.na.drop(subset=["user_session"])


def drop_copies(log: DataFrame) -> DataFrame:
    """Equal rows are folded before the shuffle, so a large group of copies travels as few rows."""
    return log.dropDuplicates()


def positive_price(log: DataFrame) -> DataFrame:
    return log.withColumn("price", F.abs("price"))


def clean(log: DataFrame) -> DataFrame:
    """All steps in order. Copies are judged before the sign of the price is dropped."""
    return (
        log.transform(drop_category_code)
        .transform(fill_brand)
        .transform(flag_missing_brand)
        .transform(drop_missing_session)
        .transform(drop_copies)
        .transform(positive_price)
    )


def drop_removals(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event_type") != REMOVAL)


def split_event_types(log: DataFrame) -> dict[str, DataFrame]:
    return {kind: log.filter(is_event(kind)) for kind in (CART, PURCHASE, VIEW)}


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls of every column, one job, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def copy_groups(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Groups of equal rows (nulls are equal) with more than one member."""
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def surplus_copies(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows."""
    return copy_groups(df).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def copy_groups_by_type(df: DataFrame) -> DataFrame:
    return copy_groups(df).groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


def negative_prices(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") < 0)


def backfill_brand(log: DataFrame, hot: Hot | None = None) -> DataFrame:
    """A null brand takes the smallest brand seen for its product."""
    # Distinct pairs first: a text minimum is found by sorting, and this leaves few rows to sort.
    pairs = log.filter(F.col("brand").isNotNull()).select("product_id", "brand").distinct()
    known = pairs.groupBy("product_id").agg(F.min("brand").alias("known_brand"))
    joined = left_join(log, known, ["product_id"], hot)
    filled = F.coalesce("brand", "known_brand")
    return joined.withColumn("brand", filled).drop("known_brand").select(log.columns)
