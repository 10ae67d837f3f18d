"""The wide feature table: one row per cleaned event, 47 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.functions import cycle, two_day_bucket, weight_of
from clickgrain.operators import grains
from clickgrain.operators.cleaning import clean, drop_removals
from clickgrain.operators.skew import find_hot, left_join
from clickgrain.session import park

# The column order of the feature table.
FEATURE_COLUMNS = [
    "event_timestamp", "product_id", "category_id", "brand", "price", "user_id", "user_session",
    "is_brand_missing", "Num_purchase_per_2day", "Recency", "Frequency", "Monetary",
    "total_cart_by_user", "total_purchase_by_user", "total_view_by_user", "Avg_purchase_price",
    "total_unique_product_purchases_by_user", "total_unique_product_add_cart_by_user",
    "view_to_purchase_time", "normalised_price",
    "1_most_purchased_category", "2_most_purchased_category", "3_most_purchased_category",
    "session_duration", "Avg_session_prices", "num_session_views", "num_session_cart",
    "num_session_purchase", "session_cart_to_purchase_ratio", "session_cart_abandonment_rate",
    "total_cart_of_product", "total_purchase_of_product", "total_view_of_product",
    "popularity_percentile", "product_cart_to_purchase_conversion_ratio",
    "view_to_purchase_conversion_rate_for_item", "view_to_purchase_ratio", "interaction_score",
    "day", "month", "week", "hour_sin", "hour_cos", "minutes_sin", "minutes_cos", "second_sin", "second_cos",
]

TOP_CATEGORIES = [f"{i}_most_purchased_category" for i in (1, 2, 3)]
USER_COUNTS = [
    "Frequency", "total_cart_by_user", "total_purchase_by_user", "total_view_by_user",
    "total_unique_product_purchases_by_user", "total_unique_product_add_cart_by_user",
]
PRODUCT_COUNTS = ["total_cart_of_product", "total_purchase_of_product", "total_view_of_product"]
PRODUCT_RATIOS = [
    "product_cart_to_purchase_conversion_ratio", "view_to_purchase_conversion_rate_for_item", "view_to_purchase_ratio",
]
PAIR_COUNTS = ["user_product_view", "user_product_cart", "user_product_purchase", "user_product_frm_cart"]
SESSION_COUNTS = ["num_session_views", "num_session_cart", "num_session_purchase"]
SESSION_RATIOS = ["session_cart_to_purchase_ratio", "session_cart_abandonment_rate"]


def time_features(log: DataFrame, period: int = 24, keep_parts: bool = False) -> DataFrame:
    """Calendar parts and their positions on a circle. ``week`` is the day of the week, 1 = Sunday.

    One period serves hours, minutes and seconds alike, as in the tables already in use.
    """
    at = F.col("event_time")
    parts = {"hour": F.hour(at), "minutes": F.minute(at), "seconds": F.second(at)}
    added = {"day": F.day(at), "month": F.month(at), "week": F.dayofweek(at)}
    for part, name in (("hour", "hour"), ("minutes", "minutes"), ("seconds", "second")):
        added[f"{name}_sin"], added[f"{name}_cos"] = cycle(parts[part], period)
    return log.withColumns({**added, **(parts if keep_parts else {})})


def enriched_cube(cube_rows: DataFrame, span: DataFrame, compat: bool = False, hot_rows: int | None = None) -> DataFrame:
    """User, pair, product and category features side by side, one row per cube cell.

    Attaching them here and not to the events means the events are shuffled once for all four, and
    a hot user or product meets its features with one row per partner.
    """
    pair_rows = grains.pairs(cube_rows)
    parents = grains.product_categories(cube_rows)
    product_rows = grains.products(parents, compat)
    category_rows = grains.categories(parents, product_rows)
    user_rows = left_join(grains.users(pair_rows, span), grains.top_purchased(cube_rows), ["user_id"])
    hot = find_hot(
        cube_rows, {"user": ["user_id"], "product": ["product_id"], "category": ["category_id"]}, min_rows=hot_rows
    )
    cells = grains.with_pair_totals(cube_rows)
    cells = left_join(cells, user_rows, ["user_id"], hot["user"])
    cells = left_join(cells, product_rows, ["product_id"], hot["product"])
    cells = left_join(cells, category_rows, ["category_id"], hot["category"], null_safe=True)
    whole_span = grains.span_days(span)
    return cells.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in USER_COUNTS + PRODUCT_COUNTS + PAIR_COUNTS},
            **{c: F.coalesce(c, F.lit(0.0)) for c in [*PRODUCT_RATIOS, "Monetary", "view_to_purchase_time"]},
            **{c: F.coalesce(c, F.lit(grains.NO_PURCHASE)) for c in TOP_CATEGORIES},
            "Avg_purchase_price": F.coalesce("Avg_purchase_price", F.lit(0).cast("float")),
            "Recency": F.coalesce("Recency", whole_span),
        }
    ).withColumn(
        "popularity_percentile",
        F.when(F.col("max_view_category") > 0, F.col("total_view_of_product") / F.col("max_view_category")).otherwise(
            0.0
        ),
    )


def feature_table(
    cleaned: DataFrame,
    compat: bool = False,
    weights: dict[str, float] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """All features of a cleaned log.

    ``cleaned`` is read several times, so pass a written table (``feature_table_of_log`` does).
    The events are shuffled three times: by two-day bucket, by session and by cube cell.
    """
    cube_rows = park(grains.cube(cleaned), "cube")
    hot = find_hot(
        cleaned.withColumn("two_day", two_day_bucket(F.col("event_time"))),
        {"cell": grains.CUBE_KEYS, "session": grains.SESSION_KEYS, "two_day": ["user_id", "two_day"]},
        min_rows=hot_rows,
    )
    cells = enriched_cube(cube_rows, grains.log_span(cleaned), compat, hot_rows)
    session_rows = grains.sessions(cleaned).drop("num_session_frm_cart", "Avg_session_intent_prices")

    # The widest table comes last: its columns never travel in a later shuffle of the events.
    rows = cleaned.withColumn("two_day", two_day_bucket(F.col("event_time")))
    rows = left_join(rows, grains.two_day_purchases(cleaned), ["user_id", "two_day"], hot["two_day"])
    rows = left_join(rows, session_rows, grains.SESSION_KEYS, hot["session"])
    rows = left_join(rows, cells, grains.CUBE_KEYS, hot["cell"], null_safe=True)

    pair_total = sum((F.col(c) for c in PAIR_COUNTS[1:]), F.col(PAIR_COUNTS[0]))
    rows = rows.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in [*SESSION_COUNTS, "Num_purchase_per_2day"]},
            **{c: F.coalesce(c, F.lit(0.0)) for c in [*SESSION_RATIOS, "Avg_session_prices"]},
            "normalised_price": F.try_divide("price", "avg_cat_price"),
            "interaction_score": pair_total * weight_of(F.col("event_type"), weights),
        }
    )
    return time_features(rows).withColumnRenamed("event_time", "event_timestamp").select(*FEATURE_COLUMNS)


def feature_table_of_log(
    log: DataFrame, compat: bool = False, weights: dict[str, float] | None = None, hot_rows: int | None = None
) -> DataFrame:
    """From the raw log: removals out, cleaned, written once, then all features."""
    cleaned = park(clean(drop_removals(log)), "clean")
    return feature_table(cleaned, compat, weights, hot_rows)
