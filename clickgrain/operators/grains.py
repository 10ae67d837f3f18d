"""Aggregates of the cleaned log, one table per grain.

``cube`` (user, product, category) is the only large one built from events; the user, product and
category tables are rolled up from it, so they read the log no further and a hot user or product
has been cut down to one row per partner before its own shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickgrain.functions import (
    CART,
    DAY_SECONDS,
    PURCHASE,
    REMOVAL,
    VIEW,
    days_between,
    is_event,
    ratio_or_zero,
    seconds_between,
    steady_round,
    two_day_bucket,
)

CUBE_KEYS = ["user_id", "product_id", "category_id"]
SESSION_KEYS = ["user_id", "user_session"]
NO_PURCHASE = "No purchase"


def _price_of(kind: str) -> Column:
    return F.when(is_event(kind), F.col("price"))


def _time_of(kind: str) -> Column:
    return F.when(is_event(kind), F.col("event_time"))


def cube(clean: DataFrame) -> DataFrame:
    return clean.groupBy(*CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_event(VIEW)).alias("views"),
        F.count_if(is_event(CART)).alias("carts"),
        F.count_if(is_event(PURCHASE)).alias("purchases"),
        F.count_if(is_event(REMOVAL)).alias("removals"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_count"),
        F.sum(_price_of(PURCHASE)).alias("spend"),
        F.count(_price_of(PURCHASE)).alias("spend_count"),
        F.min(_time_of(VIEW)).alias("first_view"),
        F.min(_time_of(PURCHASE)).alias("first_purchase"),
        F.max(_time_of(PURCHASE)).alias("last_purchase"),
    )


def pairs(cube_rows: DataFrame) -> DataFrame:
    """(user, product): counts, first view and purchase, days between the two."""
    rolled = cube_rows.groupBy("user_id", "product_id").agg(
        F.sum("views").alias("user_product_view"),
        F.sum("carts").alias("user_product_cart"),
        F.sum("purchases").alias("user_product_purchase"),
        F.sum("removals").alias("user_product_frm_cart"),
        F.sum("spend").alias("spend"),
        F.sum("spend_count").alias("spend_count"),
        F.min("first_view").alias("first_view"),
        F.min("first_purchase").alias("first_purchase"),
        F.max("last_purchase").alias("last_purchase"),
    )
    return rolled.withColumn(
        "view_to_purchase_time", days_between(F.col("first_view"), F.col("first_purchase")).cast("double")
    )


def with_pair_totals(cube_rows: DataFrame) -> DataFrame:
    """Cube keys with the totals of the cell's (user, product); null where either is null.

    A pair has one cell per category of its product, so the window holds a handful of rows.
    """
    pair = W.partitionBy("user_id", "product_id")
    known = F.col("user_id").isNotNull() & F.col("product_id").isNotNull()
    totals = {
        "user_product_view": F.sum("views").over(pair),
        "user_product_cart": F.sum("carts").over(pair),
        "user_product_purchase": F.sum("purchases").over(pair),
        "user_product_frm_cart": F.sum("removals").over(pair),
        "view_to_purchase_time": days_between(
            F.min("first_view").over(pair), F.min("first_purchase").over(pair)
        ).cast("double"),
    }
    return cube_rows.select(*CUBE_KEYS, *[F.when(known, value).alias(name) for name, value in totals.items()])


def log_span(clean: DataFrame) -> DataFrame:
    """One row: first and last event of the cleaned log."""
    return clean.agg(F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))


def user_totals(pair_rows: DataFrame) -> DataFrame:
    """Per user: everything that needs counts, sums and distinct products only.

    A pair row is one product of the user, so distinct products are a plain count here.
    """
    known = F.col("product_id").isNotNull()
    return pair_rows.groupBy("user_id").agg(
        F.sum("user_product_purchase").alias("Frequency"),
        F.sum("spend").alias("Monetary"),
        F.sum("spend_count").alias("spend_count"),
        F.sum("user_product_cart").alias("total_cart_by_user"),
        F.sum("user_product_purchase").alias("total_purchase_by_user"),
        F.sum("user_product_view").alias("total_view_by_user"),
        F.count_if(known & (F.col("user_product_purchase") > 0)).alias("total_unique_product_purchases_by_user"),
        F.count_if(known & (F.col("user_product_cart") > 0)).alias("total_unique_product_add_cart_by_user"),
        F.max("last_purchase").alias("last_purchase"),
    )


def recency_days(last_purchase: Column, span: DataFrame) -> Column:
    """Days from the last purchase to the end of the log; the whole span without a purchase."""
    end = span.select("last_event").scalar()
    start = span.select("first_event").scalar()
    return days_between(F.coalesce(last_purchase, start), end).cast("double")


def users(pair_rows: DataFrame, span: DataFrame) -> DataFrame:
    return (
        user_totals(pair_rows)
        .withColumn("Recency", recency_days(F.col("last_purchase"), span))
        .withColumn(
            "Avg_purchase_price",
            F.coalesce(
                F.when(F.col("spend_count") > 0, steady_round(F.col("Monetary") / F.col("spend_count"))), F.lit(0.0)
            ).cast("float"),
        )
        .withColumn("Monetary", F.coalesce("Monetary", F.lit(0.0)))
        .drop("spend_count", "last_purchase")
    )


def top_purchased(
    cube_rows: DataFrame, item: str = "category_id", noun: str = "category", count: int = 3
) -> DataFrame:
    """Per user with purchases: the most purchased items, later places falling back to the first.

    A null item counts 0 purchases and so comes last; equal counts go by the item itself.
    """
    counted = (
        cube_rows.groupBy("user_id", item)
        .agg(F.sum("purchases").alias("bought"))
        .filter("bought > 0")
        .withColumn("bought", F.when(F.col(item).isNull(), 0).otherwise(F.col("bought")))
    )
    # Rows per user are distinct items, and the filter below lets Spark cut them before the shuffle.
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("bought"), F.col(item).asc_nulls_last()))
    best = counted.withColumn("place", place).filter(F.col("place") <= count)
    at = [F.max(F.when(F.col("place") == i, F.col(item))) for i in range(1, count + 1)]
    names = [f"{i}_most_purchased_{noun}" for i in range(1, count + 1)]
    return best.groupBy("user_id").agg(*[F.coalesce(a, at[0]).alias(n) for a, n in zip(at, names)])


def product_categories(cube_rows: DataFrame) -> DataFrame:
    """(product, category): the common parent of the product and category tables."""
    return cube_rows.groupBy("product_id", "category_id").agg(
        F.sum("views").alias("views"),
        F.sum("carts").alias("carts"),
        F.sum("purchases").alias("purchases"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("price_count").alias("price_count"),
    )


def product_totals(product_category_rows: DataFrame) -> DataFrame:
    return product_category_rows.groupBy("product_id").agg(
        F.sum("carts").alias("total_cart_of_product"),
        F.sum("purchases").alias("total_purchase_of_product"),
        F.sum("views").alias("total_view_of_product"),
    )


def products(product_category_rows: DataFrame, compat: bool = False) -> DataFrame:
    """Per product: counts and conversion ratios.

    ``compat`` gives the conversion rate the value of the cart ratio, which is what users of the
    original feature table have in their data.
    """
    cart, bought, seen = (F.col(f"total_{k}_of_product") for k in ("cart", "purchase", "view"))
    cart_ratio = ratio_or_zero(cart, bought)
    return product_totals(product_category_rows).select(
        "*",
        cart_ratio.alias("product_cart_to_purchase_conversion_ratio"),
        (cart_ratio if compat else ratio_or_zero(bought, seen)).alias("view_to_purchase_conversion_rate_for_item"),
        ratio_or_zero(seen, bought).alias("view_to_purchase_ratio"),
    )


def categories(product_category_rows: DataFrame, product_rows: DataFrame) -> DataFrame:
    """Per category: mean price of its events and the views of its most viewed product."""
    views = product_rows.select("product_id", "total_view_of_product")
    return (
        product_category_rows.join(views, "product_id", "left")
        .groupBy("category_id")
        .agg(
            F.try_divide(F.sum("price_sum"), F.sum("price_count")).alias("avg_cat_price"),
            F.max(F.coalesce("total_view_of_product", F.lit(0))).alias("max_view_category"),
        )
    )


def sessions(clean: DataFrame) -> DataFrame:
    """Per (user, session): duration, mean price, counts by type and cart ratios."""
    seen, cart, bought = (F.col(f"num_session_{k}") for k in ("views", "cart", "purchase"))
    return (
        clean.groupBy(*SESSION_KEYS)
        .agg(
            seconds_between(F.min("event_time"), F.max("event_time")).alias("session_duration"),
            steady_round(F.avg("price")).alias("Avg_session_prices"),
            F.count_if(is_event(VIEW)).alias("num_session_views"),
            F.count_if(is_event(CART)).alias("num_session_cart"),
            F.count_if(is_event(PURCHASE)).alias("num_session_purchase"),
            F.count_if(is_event(REMOVAL)).alias("num_session_frm_cart"),
            steady_round(F.avg(_price_of(REMOVAL))).alias("Avg_session_intent_prices"),
        )
        .withColumn("session_cart_to_purchase_ratio", ratio_or_zero(cart, bought))
        .withColumn(
            "session_cart_abandonment_rate",
            steady_round(F.when(cart == 0, F.lit(0.0)).otherwise(F.lit(1.0) - bought / cart)),
        )
    )


def two_day_purchases(clean: DataFrame) -> DataFrame:
    return (
        clean.filter(is_event(PURCHASE))
        .groupBy("user_id", two_day_bucket(F.col("event_time")).alias("two_day"))
        .agg(F.count(F.lit(1)).alias("Num_purchase_per_2day"))
    )


def span_days(span: DataFrame) -> Column:
    return (seconds_between(span.select("first_event").scalar(), span.select("last_event").scalar())) / DAY_SECONDS
