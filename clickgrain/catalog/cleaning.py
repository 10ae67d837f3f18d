"""CL1-CL20: projections, filters, cleaning and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickgrain.catalog.base import clean_log, query, with_log
from clickgrain.functions import weight_of
from clickgrain.operators import cleaning
from clickgrain.operators.skew import find_hot
from clickgrain.session import park
from clickgrain.sources.testlog import event_log

LOG_COLUMNS = "event_time, event_type, product_id, category_id, category_code, brand, price, user_id, user_session"


@query("cl1_drop_category_code", with_log("SELECT * EXCLUDE (category_code) FROM log"))
def cl1(spark, sf_dir):
    return cleaning.drop_category_code(event_log(spark, sf_dir))


@query("cl2_fill_brand", with_log("SELECT * REPLACE (coalesce(brand, 'UNKNOWN') AS brand) FROM log"))
def cl2(spark, sf_dir):
    return cleaning.fill_brand(event_log(spark, sf_dir))


@query(
    "cl3_missing_brand_flag",
    with_log(
        """SELECT * REPLACE (coalesce(brand, 'UNKNOWN') AS brand),
CAST(coalesce(brand, 'UNKNOWN') = 'UNKNOWN' AS INTEGER) AS is_brand_missing FROM log"""
    ),
)
def cl3(spark, sf_dir):
    return cleaning.flag_missing_brand(cleaning.fill_brand(event_log(spark, sf_dir)))


@query("cl4_drop_missing_session", with_log("SELECT * FROM log WHERE user_session IS NOT NULL"))
def cl4(spark, sf_dir):
    return cleaning.drop_missing_session(event_log(spark, sf_dir))


@query("cl5_drop_copies", with_log("SELECT DISTINCT * FROM log"))
def cl5(spark, sf_dir):
    return cleaning.drop_copies(event_log(spark, sf_dir))


@query("cl6_positive_price", with_log("SELECT * REPLACE (abs(price) AS price) FROM log"))
def cl6(spark, sf_dir):
    return cleaning.positive_price(event_log(spark, sf_dir))


@query("cl7_clean", with_log("SELECT * FROM clean_all_abs"))
def cl7(spark, sf_dir):
    return cleaning.clean(event_log(spark, sf_dir))


@query("cl8_drop_removals", with_log("SELECT * FROM log WHERE event_type <> 'remove_from_cart'"))
def cl8(spark, sf_dir):
    return cleaning.drop_removals(event_log(spark, sf_dir))


@query(
    "cl9_split_event_types",
    with_log("SELECT event_type AS slice, * FROM clean WHERE event_type IN ('cart', 'purchase', 'view')"),
)
def cl9(spark, sf_dir):
    slices = cleaning.split_event_types(clean_log(spark, sf_dir))
    tagged = [rows.withColumn("slice", F.lit(kind)) for kind, rows in slices.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


NULLS = ", ".join(f"count(*) FILTER ({c.strip()} IS NULL) AS {c.strip()}" for c in LOG_COLUMNS.split(","))


@query("cl10_null_profile", with_log(f"SELECT {NULLS} FROM log"))
def cl10(spark, sf_dir):
    return cleaning.null_profile(event_log(spark, sf_dir))


@query(
    "cl11_surplus_copies",
    with_log("SELECT (SELECT count(*) FROM log) - (SELECT count(*) FROM (SELECT DISTINCT * FROM log)) AS surplus"),
)
def cl11(spark, sf_dir):
    return cleaning.surplus_copies(event_log(spark, sf_dir))


COPIES = f"copies AS (SELECT {LOG_COLUMNS}, count(*) AS count FROM log GROUP BY {LOG_COLUMNS} HAVING count(*) > 1)"


@query("cl12_copy_groups", with_log("SELECT * FROM copies", COPIES))
def cl12(spark, sf_dir):
    return cleaning.copy_groups(event_log(spark, sf_dir))


@query(
    "cl13_copy_groups_by_type",
    with_log("SELECT event_type, count(*) AS count FROM copies GROUP BY event_type", COPIES),
)
def cl13(spark, sf_dir):
    return cleaning.copy_groups_by_type(event_log(spark, sf_dir))


@query("cl14_negative_prices", with_log("SELECT * FROM log WHERE price < 0"))
def cl14(spark, sf_dir):
    return cleaning.negative_prices(event_log(spark, sf_dir))


@query("cl14_negative_price_count", with_log("SELECT count(*) AS count FROM log WHERE price < 0"))
def cl14_count(spark, sf_dir):
    return cleaning.negative_prices(event_log(spark, sf_dir)).agg(F.count(F.lit(1)).alias("count"))


@query(
    "cl15_backfill_brand",
    with_log(
        "SELECT * REPLACE (coalesce(brand, min(brand) OVER (PARTITION BY product_id)) AS brand) FROM log"
    ),
)
def cl15(spark, sf_dir):
    log = park(event_log(spark, sf_dir), "log")
    return cleaning.backfill_brand(log, find_hot(log, {"product": ["product_id"]})["product"])


@query(
    "cl16_renames",
    with_log(
        """SELECT event_time AS event_timestamp, user_id AS train_user_id, category_id AS preferred_category, event_type
FROM clean"""
    ),
)
def cl16(spark, sf_dir):
    renamed = clean_log(spark, sf_dir).withColumnsRenamed(
        {"event_time": "event_timestamp", "user_id": "train_user_id", "category_id": "preferred_category"}
    )
    return renamed.select("event_timestamp", "train_user_id", "preferred_category", "event_type")


@query(
    "cl17_conditional_column",
    with_log(
        """SELECT user_id, event_time, CASE event_type WHEN 'view' THEN 0.3::DOUBLE WHEN 'cart' THEN 0.7::DOUBLE
ELSE 0.0::DOUBLE END AS weight FROM clean_all_abs"""
    ),
)
def cl17(spark, sf_dir):
    weight = F.coalesce(weight_of(F.col("event_type"), {"view": 0.3, "cart": 0.7}), F.lit(0.0))
    return clean_log(spark, sf_dir, removals=True).select("user_id", "event_time", weight.alias("weight"))


@query(
    "cl18_row_filters",
    with_log(
        """SELECT * FROM clean WHERE (price > 10 AND event_type = 'purchase') OR (is_brand_missing = 1 AND price <= 5)"""
    ),
)
def cl18(spark, sf_dir):
    dear = (F.col("price") > 10) & (F.col("event_type") == "purchase")
    return clean_log(spark, sf_dir).filter(dear | F.expr("is_brand_missing = 1 AND price <= 5"))


@query("cl19_preview", with_log("SELECT * FROM clean ORDER BY ALL NULLS LAST LIMIT 20"))
def cl19(spark, sf_dir):
    log = clean_log(spark, sf_dir)
    return log.orderBy(*[F.col(c).asc_nulls_last() for c in log.columns]).limit(20)


@query(
    "cl20_row_lookup",
    with_log(
        """SELECT c.* FROM clean c JOIN (SELECT product_id, price FROM clean ORDER BY price DESC, product_id DESC LIMIT 1) d
ON c.product_id = d.product_id AND c.price = d.price"""
    ),
)
def cl20(spark, sf_dir):
    """Rows of one product at one price: those of the dearest event."""
    rows = park(clean_log(spark, sf_dir), "clean")
    dearest = rows.agg(F.max(F.struct("price", "product_id"))).scalar()
    return rows.filter((F.col("product_id") == dearest["product_id"]) & (F.col("price") == dearest["price"]))
