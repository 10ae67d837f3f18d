"""Single features attached to the rows of a cleaned log, for use without the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.functions import two_day_bucket, weight_of
from clickgrain.operators import grains
from clickgrain.operators.skew import Hot, left_join


def with_two_day_purchases(cleaned: DataFrame, hot: Hot | None = None) -> DataFrame:
    rows = cleaned.withColumn("two_day", two_day_bucket(F.col("event_time")))
    joined = left_join(rows, grains.two_day_purchases(cleaned), ["user_id", "two_day"], hot)
    return joined.drop("two_day").na.fill({"Num_purchase_per_2day": 0})


def with_normalised_price(cleaned: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Price over the mean price of all events in the category; a null category is one of its own."""
    means = cleaned.groupBy("category_id").agg(F.avg("price").alias("avg_cat_price"))
    joined = left_join(cleaned, means, ["category_id"], hot, null_safe=True)
    return joined.withColumn("normalised_price", F.try_divide("price", "avg_cat_price")).drop("avg_cat_price")


def product_popularity(cleaned: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Per (product, category): views of the product over the views of the category's best."""
    parents = grains.product_categories(grains.cube(cleaned))
    totals = grains.product_totals(parents).select("product_id", "total_view_of_product")
    best = grains.categories(parents, totals).select("category_id", "max_view_category")
    rows = left_join(parents.select("product_id", "category_id"), totals, ["product_id"])
    rows = left_join(rows, best, ["category_id"], hot, null_safe=True).na.fill({"total_view_of_product": 0})
    share = F.col("total_view_of_product") / F.col("max_view_category")
    return rows.withColumn("popularity_percentile", F.when(F.col("max_view_category") > 0, share).otherwise(0.0))


def with_interaction_score(
    cleaned: DataFrame, weights: dict[str, float] | None = None, hot: Hot | None = None
) -> DataFrame:
    """Weight of the row's event times all counted interactions of its user with its product."""
    counts = ["user_product_view", "user_product_cart", "user_product_purchase", "user_product_frm_cart"]
    pair_rows = grains.pairs(grains.cube(cleaned)).select("user_id", "product_id", *counts)
    joined = left_join(cleaned, pair_rows, ["user_id", "product_id"], hot).na.fill(0, counts)
    total = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return joined.withColumn("interaction_weight", weight_of(F.col("event_type"), weights)).withColumn(
        "interaction_score", total * F.col("interaction_weight")
    )


def pair_conversion(cleaned: DataFrame) -> DataFrame:
    """Per (user, product): purchases over views, null without a view."""
    return grains.pairs(grains.cube(cleaned)).select(
        "user_id",
        "product_id",
        F.try_divide("user_product_purchase", "user_product_view").alias("view_to_purchase_conversion_rate"),
    )


def with_top_purchased(
    cleaned: DataFrame, item: str, noun: str, filler: str, hot: Hot | None = None
) -> DataFrame:
    """Top-3 purchased items of the row's user."""
    counted = cleaned.groupBy("user_id", item).agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    names = [f"{i}_most_purchased_{noun}" for i in (1, 2, 3)]
    joined = left_join(cleaned, grains.top_purchased(counted, item, noun), ["user_id"], hot)
    return joined.na.fill(filler, names)
