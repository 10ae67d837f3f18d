"""FT1-FT31: behavioural features."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickgrain.catalog.base import clean_log, parked_clean, query, r, rounded, seconds, with_log
from clickgrain.functions import WEIGHTS_WITH_REMOVALS, two_day_bucket, weight_of
from clickgrain.operators import attach, grains
from clickgrain.operators.skew import find_hot, left_join
from clickgrain.plans.features import FEATURE_COLUMNS, feature_table_of_log, time_features
from clickgrain.sources.testlog import event_log, order_log

EVENT = ["user_id", "product_id", "event_time", "event_type"]


def hot_keys(df, *keys):
    return find_hot(df, {"keys": list(keys)})["keys"]


def cube_of(spark, sf_dir, removals=False):
    return grains.cube(clean_log(spark, sf_dir, removals))


@query(
    "ft1_two_day_purchases",
    with_log(
        f"""
SELECT c.user_id, c.product_id, c.event_time, c.event_type, coalesce(b.n, 0) AS Num_purchase_per_2day
FROM clean c LEFT JOIN (SELECT user_id, {seconds('event_time')} // 172800 AS bucket, count(*) AS n
                        FROM clean WHERE event_type = 'purchase' GROUP BY ALL) b
  ON c.user_id = b.user_id AND {seconds('c.event_time')} // 172800 = b.bucket"""
    ),
)
def ft1(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    hot = hot_keys(cleaned.withColumn("two_day", two_day_bucket(F.col("event_time"))), "user_id", "two_day")
    return attach.with_two_day_purchases(cleaned, hot).select(*EVENT, "Num_purchase_per_2day")


RECENCY_SQL = f"""
span AS (SELECT min({seconds('event_time')}) AS t0, max({seconds('event_time')}) AS t1 FROM clean),
recency AS (SELECT user_id, (any_value(t1) - coalesce(max({seconds('event_time')}) FILTER (event_type = 'purchase'), any_value(t0))) / 86400.0::DOUBLE AS Recency
            FROM clean CROSS JOIN span GROUP BY user_id)"""


@query("ft2_recency", with_log(f"SELECT user_id, {r('Recency', 6)} AS Recency FROM recency", RECENCY_SQL))
def ft2(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    users = grains.users(grains.pairs(grains.cube(cleaned)), grains.log_span(cleaned))
    return rounded(users.select("user_id", "Recency"), 6)


@query(
    "ft3_frequency",
    with_log("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS Frequency FROM clean GROUP BY user_id"),
)
def ft3(spark, sf_dir):
    return grains.user_totals(grains.pairs(cube_of(spark, sf_dir))).select("user_id", "Frequency")


@query(
    "ft4_monetary",
    with_log(
        f"""SELECT user_id, {r("coalesce(sum(price) FILTER (event_type = 'purchase'), 0)")} AS Monetary
FROM clean GROUP BY user_id"""
    ),
)
def ft4(spark, sf_dir):
    totals = grains.user_totals(grains.pairs(cube_of(spark, sf_dir)))
    return rounded(totals.select("user_id", F.coalesce("Monetary", F.lit(0.0)).alias("Monetary")))


@query(
    "ft4_monetary_of_orders",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS Frequency, {r('sum(l_extendedprice)', 2)} AS Monetary,
count(DISTINCT l_partkey) AS total_unique_product_purchases_by_user
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def ft4_orders(spark, sf_dir):
    totals = grains.user_totals(grains.pairs(grains.cube(order_log(spark, sf_dir))))
    columns = ["user_id", "Frequency", "Monetary", "total_unique_product_purchases_by_user"]
    return rounded(totals.select(*columns), 2)


@query(
    "ft5_user_event_totals",
    with_log(
        """SELECT user_id, count(*) FILTER (event_type = 'cart') AS total_cart_by_user,
count(*) FILTER (event_type = 'purchase') AS total_purchase_by_user, count(*) FILTER (event_type = 'view') AS total_view_by_user
FROM clean GROUP BY user_id"""
    ),
)
def ft5(spark, sf_dir):
    totals = grains.user_totals(grains.pairs(cube_of(spark, sf_dir)))
    return totals.select("user_id", "total_cart_by_user", "total_purchase_by_user", "total_view_by_user")


@query(
    "ft6_avg_purchase_price",
    with_log(
        f"""SELECT user_id, CAST(coalesce({r("avg(price) FILTER (event_type = 'purchase')", 2)}, 0) AS FLOAT) AS Avg_purchase_price
FROM clean GROUP BY user_id"""
    ),
)
def ft6(spark, sf_dir):
    cleaned = clean_log(spark, sf_dir)
    return grains.users(grains.pairs(grains.cube(cleaned)), grains.log_span(cleaned)).select(
        "user_id", "Avg_purchase_price"
    )


@query(
    "ft7_unique_products",
    with_log(
        """SELECT user_id, count(DISTINCT product_id) FILTER (event_type = 'purchase') AS total_unique_product_purchases_by_user,
count(DISTINCT product_id) FILTER (event_type = 'cart') AS total_unique_product_add_cart_by_user FROM clean GROUP BY user_id"""
    ),
)
def ft7(spark, sf_dir):
    return grains.user_totals(grains.pairs(cube_of(spark, sf_dir))).select(
        "user_id", "total_unique_product_purchases_by_user", "total_unique_product_add_cart_by_user"
    )


PAIR_TIME_SQL = f"""
pair_time AS (SELECT user_id, product_id,
  (min({seconds('event_time')}) FILTER (event_type = 'purchase') - min({seconds('event_time')}) FILTER (event_type = 'view')) / 86400.0::DOUBLE AS days
  FROM clean GROUP BY ALL)"""


@query(
    "ft8_view_to_purchase_time",
    with_log(
        f"SELECT user_id, product_id, {r('coalesce(days, 0)', 6)} AS view_to_purchase_time FROM pair_time", PAIR_TIME_SQL
    ),
)
def ft8(spark, sf_dir):
    pairs = grains.pairs(cube_of(spark, sf_dir)).na.fill({"view_to_purchase_time": 0.0})
    return rounded(pairs.select("user_id", "product_id", "view_to_purchase_time"), 6)


@query(
    "ft9_normalised_price",
    with_log(
        f"""SELECT user_id, product_id, event_time, event_type,
{r('price / avg(price) OVER (PARTITION BY category_id)', 6)} AS normalised_price FROM clean"""
    ),
)
def ft9(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    rows = attach.with_normalised_price(cleaned, hot_keys(cleaned, "category_id"))
    return rounded(rows.select(*EVENT, "normalised_price"), 6)


def top_sql(item: str, noun: str, filler: str, source: str = "clean") -> tuple[str, str]:
    ctes = f"""
counted AS (SELECT user_id, {item} AS item, count({item}) AS n FROM {source} WHERE event_type = 'purchase' GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item ASC NULLS LAST) AS place FROM counted),
tops AS (SELECT user_id, max(item) FILTER (place = 1) AS t1, max(item) FILTER (place = 2) AS t2, max(item) FILTER (place = 3) AS t3
         FROM placed GROUP BY user_id)"""
    columns = ", ".join(f"coalesce(t{i}, t1, '{filler}') AS \"{i}_most_purchased_{noun}\"" for i in (1, 2, 3))
    return ctes, columns


CATEGORY_CTES, CATEGORY_COLUMNS = top_sql("category_id", "category", "No purchase")
BRAND_CTES, BRAND_COLUMNS = top_sql("brand", "brand", "UNKNOWN")


@query(
    "ft10_top_categories",
    with_log(
        f"SELECT u.user_id, {CATEGORY_COLUMNS} FROM (SELECT DISTINCT user_id FROM clean) u LEFT JOIN tops USING (user_id)",
        CATEGORY_CTES,
    ),
)
def ft10(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    users = cube.select("user_id").distinct()
    names = [f"{i}_most_purchased_category" for i in (1, 2, 3)]
    return left_join(users, grains.top_purchased(cube), ["user_id"]).na.fill(grains.NO_PURCHASE, names)


@query(
    "ft11_top_brands",
    with_log(
        f"SELECT c.user_id, c.product_id, c.event_time, c.event_type, {BRAND_COLUMNS} FROM clean c LEFT JOIN tops USING (user_id)",
        BRAND_CTES,
    ),
)
def ft11(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    rows = attach.with_top_purchased(cleaned, "brand", "brand", "UNKNOWN", hot_keys(cleaned, "user_id"))
    return rows.select(*EVENT, *[f"{i}_most_purchased_brand" for i in (1, 2, 3)])


def session_query(key: str, columns: list[str], sql: str, removals: bool = False):
    source = "clean_all_abs" if removals else "clean"

    @query(key, with_log(f"SELECT user_id, user_session, {sql} FROM {source} GROUP BY user_id, user_session"))
    def run(spark, sf_dir):
        return grains.sessions(clean_log(spark, sf_dir, removals)).select(*grains.SESSION_KEYS, *columns)


def times(kind: str) -> str:
    return f"count(*) FILTER (event_type = '{kind}')"


session_query(
    "ft12_session_duration",
    ["session_duration"],
    f"max({seconds('event_time')}) - min({seconds('event_time')}) AS session_duration",
)
session_query("ft13_avg_session_prices", ["Avg_session_prices"], f"{r('avg(price)', 2)} AS Avg_session_prices")
session_query(
    "ft14_session_event_counts",
    ["num_session_views", "num_session_cart", "num_session_purchase"],
    f"{times('view')} AS num_session_views, {times('cart')} AS num_session_cart, {times('purchase')} AS num_session_purchase",
)
CART_RATIO = f"CASE WHEN {times('purchase')} = 0 THEN 0 ELSE {r(times('cart') + ' / ' + times('purchase'), 2)} END"
ABANDONMENT = f"CASE WHEN {times('cart')} = 0 THEN 0 ELSE {r('1 - ' + times('purchase') + ' / ' + times('cart'), 2)} END"
session_query(
    "ft15_session_cart_to_purchase",
    ["session_cart_to_purchase_ratio"],
    f"CAST({CART_RATIO} AS DOUBLE) AS session_cart_to_purchase_ratio",
)
session_query(
    "ft16_session_cart_abandonment",
    ["session_cart_abandonment_rate"],
    f"CAST({ABANDONMENT} AS DOUBLE) AS session_cart_abandonment_rate",
)
session_query(
    "ft28_session_removals",
    ["num_session_frm_cart"],
    f"{times('remove_from_cart')} AS num_session_frm_cart",
    removals=True,
)
session_query(
    "ft31_session_intent_price",
    ["Avg_session_intent_prices"],
    f"""{r("avg(price) FILTER (event_type = 'remove_from_cart')", 2)} AS Avg_session_intent_prices""",
    removals=True,
)

PRODUCT_SQL = f"""
product AS (SELECT product_id, {times('cart')} AS carts, {times('purchase')} AS purchases, {times('view')} AS views
            FROM clean GROUP BY product_id)"""
PRODUCT_CART_RATIO = f"CAST(CASE WHEN purchases = 0 THEN 0 ELSE {r('carts / purchases', 2)} END AS DOUBLE)"
PRODUCT_RATE = f"CAST(CASE WHEN views = 0 THEN 0 ELSE {r('purchases / views', 2)} END AS DOUBLE)"
PRODUCT_VIEW_RATIO = f"CAST(CASE WHEN purchases = 0 THEN 0 ELSE {r('views / purchases', 2)} END AS DOUBLE)"


def product_query(key: str, columns: list[str], sql: str, compat: bool = False):
    @query(key, with_log(f"SELECT product_id, {sql} FROM product", PRODUCT_SQL))
    def run(spark, sf_dir):
        rows = grains.products(grains.product_categories(cube_of(spark, sf_dir)), compat)
        return rows.select("product_id", *columns)


product_query(
    "ft17_product_event_totals",
    ["total_cart_of_product", "total_purchase_of_product", "total_view_of_product"],
    "carts AS total_cart_of_product, purchases AS total_purchase_of_product, views AS total_view_of_product",
)
product_query(
    "ft19_product_cart_to_purchase",
    ["product_cart_to_purchase_conversion_ratio"],
    f"{PRODUCT_CART_RATIO} AS product_cart_to_purchase_conversion_ratio",
)
product_query(
    "ft20_product_conversion_rate",
    ["view_to_purchase_conversion_rate_for_item"],
    f"{PRODUCT_RATE} AS view_to_purchase_conversion_rate_for_item",
)
product_query(
    "ft20_product_conversion_rate_compat",
    ["view_to_purchase_conversion_rate_for_item"],
    f"{PRODUCT_CART_RATIO} AS view_to_purchase_conversion_rate_for_item",
    compat=True,
)
product_query(
    "ft21_product_view_to_purchase", ["view_to_purchase_ratio"], f"{PRODUCT_VIEW_RATIO} AS view_to_purchase_ratio"
)


POPULARITY_SQL = """
popularity AS (SELECT DISTINCT c.product_id, c.category_id, p.views AS total_view_of_product,
                      max(p.views) OVER (PARTITION BY c.category_id) AS best
               FROM clean c JOIN product p USING (product_id))"""


@query(
    "ft18_popularity_percentile",
    with_log(
        f"""SELECT product_id, category_id, total_view_of_product,
{r('CASE WHEN best > 0 THEN total_view_of_product / best ELSE 0 END', 6)} AS popularity_percentile FROM popularity""",
        PRODUCT_SQL,
        POPULARITY_SQL,
    ),
)
def ft18(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    rows = attach.product_popularity(cleaned, hot_keys(cleaned, "category_id"))
    return rounded(rows.drop("max_view_category"), 6)


@query(
    "ft22_user_product_counts",
    with_log(
        f"""SELECT user_id, product_id, {times('view')} AS user_product_view, {times('cart')} AS user_product_cart,
{times('purchase')} AS user_product_purchase FROM clean GROUP BY user_id, product_id"""
    ),
)
def ft22(spark, sf_dir):
    return grains.pairs(cube_of(spark, sf_dir)).select(
        "user_id", "product_id", "user_product_view", "user_product_cart", "user_product_purchase"
    )


# Signups have no weight, so they are none of the interactions that a score counts.
SCORED = "FILTER (event_type <> 'signup')"
WEIGHT = "CASE event_type WHEN 'view' THEN 0.3::DOUBLE WHEN 'cart' THEN 0.5::DOUBLE WHEN 'purchase' THEN 1.0::DOUBLE END"
WEIGHT_ALL = (
    "CASE event_type WHEN 'view' THEN 0.3::DOUBLE WHEN 'cart' THEN 0.7::DOUBLE"
    " WHEN 'purchase' THEN 2.0::DOUBLE WHEN 'remove_from_cart' THEN -0.3::DOUBLE END"
)


@query(
    "ft23_interaction_weight",
    with_log(f"SELECT user_id, product_id, event_time, event_type, {WEIGHT} AS interaction_weight FROM clean_all_abs"),
)
def ft23(spark, sf_dir):
    rows = clean_log(spark, sf_dir, removals=True)
    return rows.select(*EVENT, weight_of(F.col("event_type")).alias("interaction_weight"))


@query(
    "ft24_interaction_score",
    with_log(
        f"""SELECT user_id, product_id, event_time, event_type,
{r(f'({WEIGHT}) * count(*) {SCORED} OVER (PARTITION BY user_id, product_id)', 6)} AS interaction_score FROM clean"""
    ),
)
def ft24(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    rows = attach.with_interaction_score(cleaned, hot=hot_keys(cleaned, "user_id", "product_id"))
    return rounded(rows.select(*EVENT, "interaction_score"), 6)


@query(
    "ft25_interaction_score_with_removals",
    with_log(
        f"""SELECT user_id, product_id, event_time, event_type,
{r(f'({WEIGHT_ALL}) * count(*) {SCORED} OVER (PARTITION BY user_id, product_id)', 6)} AS interaction_score FROM clean_all_abs"""
    ),
)
def ft25(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir, removals=True)
    hot = hot_keys(cleaned, "user_id", "product_id")
    rows = attach.with_interaction_score(cleaned, WEIGHTS_WITH_REMOVALS, hot)
    return rounded(rows.select(*EVENT, "interaction_score"), 6)


PARTS_SQL = """CAST(day(event_time) AS INTEGER) AS day, CAST(month(event_time) AS INTEGER) AS month,
CAST(dayofweek(event_time) + 1 AS INTEGER) AS week"""


@query(
    "ft26_calendar_parts",
    with_log(
        f"""SELECT user_id, product_id, event_time, event_type, {PARTS_SQL}, CAST(hour(event_time) AS INTEGER) AS hour,
CAST(minute(event_time) AS INTEGER) AS minutes, CAST(second(event_time) AS INTEGER) AS seconds FROM clean"""
    ),
)
def ft26(spark, sf_dir):
    rows = time_features(clean_log(spark, sf_dir), keep_parts=True)
    return rows.select(*EVENT, "day", "month", "week", "hour", "minutes", "seconds")


def cycle_sql(part: str, name: str, period: int = 24) -> str:
    angle = f"2 * pi() * {part}(event_time) / {period}"
    return f"{r(f'sin({angle})', 6)} AS {name}_sin, {r(f'cos({angle})', 6)} AS {name}_cos"


CYCLES_SQL = ", ".join(cycle_sql(p, n) for p, n in (("hour", "hour"), ("minute", "minutes"), ("second", "second")))
CYCLE_COLUMNS = ["hour_sin", "hour_cos", "minutes_sin", "minutes_cos", "second_sin", "second_cos"]


@query("ft27_time_cycles", with_log(f"SELECT user_id, product_id, event_time, event_type, {CYCLES_SQL} FROM clean"))
def ft27(spark, sf_dir):
    return rounded(time_features(clean_log(spark, sf_dir)).select(*EVENT, *CYCLE_COLUMNS), 6)


@query(
    "ft28_user_product_removals",
    with_log(
        f"""SELECT user_id, product_id, {times('remove_from_cart')} AS user_product_frm_cart
FROM clean_all_abs GROUP BY user_id, product_id"""
    ),
)
def ft28(spark, sf_dir):
    return grains.pairs(cube_of(spark, sf_dir, removals=True)).select("user_id", "product_id", "user_product_frm_cart")


@query(
    "ft30_pair_conversion",
    with_log(
        f"""SELECT user_id, product_id, CASE WHEN {times('view')} > 0 THEN
{r(f"{times('purchase')} / {times('view')}", 6)} END AS view_to_purchase_conversion_rate FROM clean GROUP BY user_id, product_id"""
    ),
)
def ft30(spark, sf_dir):
    return rounded(attach.pair_conversion(clean_log(spark, sf_dir)), 6)


def feature_ctes(compat: bool = False) -> list[str]:
    rate = PRODUCT_CART_RATIO if compat else PRODUCT_RATE
    return [
        RECENCY_SQL,
        PAIR_TIME_SQL,
        CATEGORY_CTES,
        PRODUCT_SQL,
        f"""
user_row AS (SELECT user_id, {times('cart')} AS u_carts, {times('purchase')} AS u_purchases, {times('view')} AS u_views,
  {r("coalesce(sum(price) FILTER (event_type = 'purchase'), 0)")} AS Monetary,
  CAST(coalesce({r("avg(price) FILTER (event_type = 'purchase')", 2)}, 0) AS FLOAT) AS Avg_purchase_price,
  count(DISTINCT product_id) FILTER (event_type = 'purchase') AS bought, count(DISTINCT product_id) FILTER (event_type = 'cart') AS carted
  FROM clean GROUP BY user_id),
session_row AS (SELECT user_id, user_session, max({seconds('event_time')}) - min({seconds('event_time')}) AS session_duration,
  {r('avg(price)', 2)} AS Avg_session_prices, {times('view')} AS num_session_views, {times('cart')} AS num_session_cart,
  {times('purchase')} AS num_session_purchase, CAST({CART_RATIO} AS DOUBLE) AS session_cart_to_purchase_ratio,
  CAST({ABANDONMENT} AS DOUBLE) AS session_cart_abandonment_rate FROM clean GROUP BY user_id, user_session),
two_day AS (SELECT user_id, {seconds('event_time')} // 172800 AS bucket, count(*) AS n FROM clean
            WHERE event_type = 'purchase' GROUP BY ALL),
features AS (SELECT c.event_time AS event_timestamp, c.product_id, c.category_id, c.brand, c.price, c.user_id, c.user_session,
  c.is_brand_missing, coalesce(d.n, 0) AS Num_purchase_per_2day, {r('q.Recency', 6)} AS Recency, u.u_purchases AS Frequency,
  u.Monetary, u.u_carts AS total_cart_by_user, u.u_purchases AS total_purchase_by_user, u.u_views AS total_view_by_user,
  u.Avg_purchase_price, u.bought AS total_unique_product_purchases_by_user, u.carted AS total_unique_product_add_cart_by_user,
  {r('coalesce(t.days, 0)', 6)} AS view_to_purchase_time,
  {r('c.price / avg(c.price) OVER (PARTITION BY c.category_id)', 6)} AS normalised_price, {CATEGORY_COLUMNS},
  s.session_duration, s.Avg_session_prices, s.num_session_views, s.num_session_cart, s.num_session_purchase,
  s.session_cart_to_purchase_ratio, s.session_cart_abandonment_rate,
  p.carts AS total_cart_of_product, p.purchases AS total_purchase_of_product, p.views AS total_view_of_product,
  {r('CASE WHEN max(p.views) OVER (PARTITION BY c.category_id) > 0 THEN p.views / max(p.views) OVER (PARTITION BY c.category_id) ELSE 0 END', 6)} AS popularity_percentile,
  {PRODUCT_CART_RATIO} AS product_cart_to_purchase_conversion_ratio, {rate} AS view_to_purchase_conversion_rate_for_item,
  {PRODUCT_VIEW_RATIO} AS view_to_purchase_ratio,
  {r(f'({WEIGHT}) * count(*) {SCORED} OVER (PARTITION BY c.user_id, c.product_id)', 6)} AS interaction_score,
  {PARTS_SQL}, {CYCLES_SQL}
  FROM clean c JOIN recency q USING (user_id) JOIN user_row u USING (user_id) JOIN pair_time t USING (user_id, product_id)
  LEFT JOIN tops USING (user_id) JOIN session_row s USING (user_id, user_session) JOIN product p USING (product_id)
  LEFT JOIN two_day d ON d.user_id = c.user_id AND d.bucket = {seconds('c.event_time')} // 172800)""",
    ]


FEATURE_LIST = ", ".join(f'"{c}"' for c in FEATURE_COLUMNS)


def shown(table):
    """Feature columns as they are compared: sums to 4 digits, ratios and angles to 6."""
    return table.select(
        *[
            F.round(F.col(f"`{name}`"), 4 if name == "Monetary" else 6).alias(name) if kind == "double" else f"`{name}`"
            for name, kind in table.dtypes
        ]
    )


@query("ft29_feature_table", with_log(f"SELECT {FEATURE_LIST} FROM features", *feature_ctes()))
def ft29(spark, sf_dir):
    return shown(feature_table_of_log(event_log(spark, sf_dir)))


@query("ft29_feature_table_compat", with_log(f"SELECT {FEATURE_LIST} FROM features", *feature_ctes(compat=True)))
def ft29_compat(spark, sf_dir):
    return shown(feature_table_of_log(event_log(spark, sf_dir), compat=True))
