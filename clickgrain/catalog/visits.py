"""Joins, aggregates, windows, set operators, visits and splits (JN, AG, WN, SA, SO, SE, SP)."""

from __future__ import annotations

import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickgrain.catalog.base import clean_log, parked_clean, query, r, rounded, seconds, with_log
from clickgrain.catalog.features import PAIR_TIME_SQL, PRODUCT_SQL
from clickgrain.functions import CART, PURCHASE, VIEW, days_between, is_event, two_day_bucket
from clickgrain.operators import attach, grains, profile, splits, visits
from clickgrain.operators.ordered import Running, running, sort_rows
from clickgrain.operators.ranking import truth, truth_sets
from clickgrain.operators.skew import find_hot, left_join
from clickgrain.session import new_folder, park
from clickgrain.sources.testlog import event_log

EVENT = ["user_id", "product_id", "event_time", "event_type"]
VISITS = """
visit AS (SELECT event_time, event_type, product_id, category_id, coalesce(brand, 'UNKNOWN') AS brand, price, user_id, user_session
          FROM log WHERE user_session IS NOT NULL)"""


def visit_rows(spark, sf_dir):
    return visits.visit_log(event_log(spark, sf_dir))


def parked_visits(spark, sf_dir):
    return park(visit_rows(spark, sf_dir), "visits")


def hot_keys(df, *keys):
    return find_hot(df, {"keys": list(keys)})["keys"]


# Joins ------------------------------------------------------------------------------------------


@query(
    "jn1_left_join_one_key",
    with_log(
        f"""SELECT c.user_id, c.product_id, c.event_time, c.event_type, coalesce(v.n, 0) AS total_view_of_product
FROM clean c LEFT JOIN (SELECT product_id, count(*) AS n FROM clean WHERE event_type = 'view' GROUP BY 1) v USING (product_id)"""
    ),
)
def jn1(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    views = rows.filter(is_event(VIEW)).groupBy("product_id").agg(F.count(F.lit(1)).alias("total_view_of_product"))
    joined = left_join(rows, views, ["product_id"], hot_keys(rows, "product_id"))
    return joined.na.fill({"total_view_of_product": 0}).select(*EVENT, "total_view_of_product")


@query(
    "jn2_left_join_two_keys",
    with_log(
        """SELECT c.user_id, c.product_id, c.event_time, c.event_type, coalesce(v.n, 0) AS num_session_cart
FROM clean c LEFT JOIN (SELECT user_id, user_session, count(*) AS n FROM clean WHERE event_type = 'cart' GROUP BY ALL) v
USING (user_id, user_session)"""
    ),
)
def jn2(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    carts = rows.filter(is_event(CART)).groupBy(*grains.SESSION_KEYS).agg(F.count(F.lit(1)).alias("num_session_cart"))
    joined = left_join(rows, carts, grains.SESSION_KEYS, hot_keys(rows, *grains.SESSION_KEYS))
    return joined.na.fill({"num_session_cart": 0}).select(*EVENT, "num_session_cart")


@query(
    "jn3_left_join_time_bucket",
    with_log(
        f"""SELECT c.user_id, {seconds('c.event_time')} // 172800 AS bucket, coalesce(any_value(b.n), 0) AS n
FROM clean c LEFT JOIN (SELECT user_id, {seconds('event_time')} // 172800 AS bucket, count(*) AS n
                        FROM clean WHERE event_type = 'purchase' GROUP BY ALL) b
  ON c.user_id = b.user_id AND {seconds('c.event_time')} // 172800 = b.bucket GROUP BY ALL"""
    ),
)
def jn3(spark, sf_dir):
    rows = clean_log(spark, sf_dir)
    buckets = rows.select("user_id", two_day_bucket(F.col("event_time")).alias("two_day")).distinct()
    joined = left_join(buckets, grains.two_day_purchases(rows), ["user_id", "two_day"])
    return joined.select(
        "user_id", F.col("two_day").alias("bucket"), F.coalesce("Num_purchase_per_2day", F.lit(0)).alias("n")
    )


@query(
    "jn4_left_join_renamed_key",
    with_log(
        f"""SELECT c.user_id, c.product_id, c.event_time, c.event_type, {r('coalesce(m.mean, 0)', 2)} AS mean_purchase_price
FROM clean c LEFT JOIN (SELECT user_id, avg(price) AS mean FROM clean WHERE event_type = 'purchase' GROUP BY 1) m USING (user_id)"""
    ),
)
def jn4(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    means = rows.filter(is_event(PURCHASE)).groupBy("user_id").agg(F.avg("price").alias("mean_purchase_price"))
    joined = left_join(rows, means, ["user_id"], hot_keys(rows, "user_id")).na.fill({"mean_purchase_price": 0.0})
    return rounded(joined.select(*EVENT, "mean_purchase_price"), 2)


@query(
    "jn5_inner_join_first_view_purchase",
    with_log(
        f"SELECT user_id, product_id, {r('days', 6)} AS view_to_purchase_time FROM pair_time WHERE days IS NOT NULL",
        PAIR_TIME_SQL,
    ),
)
def jn5(spark, sf_dir):
    # Both sides of the join come out of one aggregate; a pair without either has no difference.
    pairs = grains.pairs(grains.cube(clean_log(spark, sf_dir))).filter("view_to_purchase_time IS NOT NULL")
    return rounded(pairs.select("user_id", "product_id", "view_to_purchase_time"), 6)


@query(
    "jn6_total_back_to_rows",
    with_log(
        """SELECT user_id, product_id, event_time, event_type, count(*) OVER (PARTITION BY user_id) AS total_interactions
FROM clean WHERE user_id IS NOT NULL"""
    ),
)
def jn6(spark, sf_dir):
    rows = parked_clean(spark, sf_dir).filter("user_id IS NOT NULL")
    totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_interactions"))
    return left_join(rows, totals, ["user_id"], hot_keys(rows, "user_id")).select(*EVENT, "total_interactions")


# Aggregates -------------------------------------------------------------------------------------


@query("ag1_count_rows", with_log("SELECT user_id, count(*) AS n FROM clean GROUP BY user_id"))
def ag1(spark, sf_dir):
    return clean_log(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("ag2_count_column", with_log("SELECT product_id, count(brand) AS n FROM log GROUP BY product_id"))
def ag2(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("product_id").agg(F.count("brand").alias("n"))


@query(
    "ag3_count_distinct", with_log("SELECT user_id, count(DISTINCT product_id) AS n FROM clean GROUP BY user_id")
)
def ag3(spark, sf_dir):
    return clean_log(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("product_id").alias("n"))


@query("ag4_sum", with_log(f"SELECT category_id, {r('sum(price)')} AS total FROM clean GROUP BY category_id"))
def ag4(spark, sf_dir):
    return rounded(clean_log(spark, sf_dir).groupBy("category_id").agg(F.sum("price").alias("total")))


@query(
    "ag5_mean_rounded",
    with_log(f"SELECT user_session, {r('avg(price)', 2)} AS mean_price FROM clean GROUP BY user_session"),
)
def ag5(spark, sf_dir):
    return rounded(clean_log(spark, sf_dir).groupBy("user_session").agg(F.avg("price").alias("mean_price")), 2)


@query(
    "ag6_min_max",
    with_log(
        "SELECT user_session, min(event_time) AS session_start, max(event_time) AS session_end FROM clean GROUP BY user_session"
    ),
)
def ag6(spark, sf_dir):
    return (
        clean_log(spark, sf_dir)
        .groupBy("user_session")
        .agg(F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"))
    )


@query(
    "ag7_global_extremes",
    with_log(
        f"""SELECT user_id, {r(f"((SELECT max({seconds('event_time')}) FROM clean) - max({seconds('event_time')})) / 86400.0::DOUBLE", 6)} AS days_since_last
FROM clean GROUP BY user_id"""
    ),
)
def ag7(spark, sf_dir):
    rows = clean_log(spark, sf_dir)
    end = grains.log_span(rows).select("last_event").scalar()
    last = rows.groupBy("user_id").agg(F.max("event_time").alias("last_event"))
    return rounded(last.select("user_id", days_between(F.col("last_event"), end).alias("days_since_last")), 6)


PLACED = """
placed AS (SELECT user_id, category_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category_id) AS place
           FROM (SELECT user_id, category_id, count(*) AS n FROM clean WHERE event_type = 'purchase' GROUP BY ALL))"""


def placed_categories(spark, sf_dir):
    counted = clean_log(spark, sf_dir).filter(is_event(PURCHASE)).groupBy("user_id", "category_id").count()
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("count"), "category_id"))
    return counted.withColumn("place", place.cast("long"))


@query(
    "ag8_pivot_first",
    with_log(
        """SELECT user_id, max(category_id) FILTER (place = 1) AS first, max(category_id) FILTER (place = 2) AS second,
max(category_id) FILTER (place = 3) AS third FROM placed WHERE place <= 3 GROUP BY user_id""",
        PLACED,
    ),
)
def ag8(spark, sf_dir):
    wide = placed_categories(spark, sf_dir).filter("place <= 3").groupBy("user_id").pivot("place", [1, 2, 3])
    return wide.agg(F.first("category_id")).withColumnsRenamed({"1": "first", "2": "second", "3": "third"})


@query(
    "ag9_first",
    with_log("SELECT user_id, category_id AS preferred_category FROM placed WHERE place = 1", PLACED),
)
def ag9(spark, sf_dir):
    best = placed_categories(spark, sf_dir).filter("place = 1")
    return best.groupBy("user_id").agg(F.first("category_id").alias("preferred_category"))


@query(
    "ag10_collect_set",
    with_log(
        """SELECT user_id, count(DISTINCT product_id) AS size, string_agg(DISTINCT product_id, ',' ORDER BY product_id) AS items
FROM clean WHERE event_type = 'purchase' GROUP BY user_id"""
    ),
)
def ag10(spark, sf_dir):
    bought = truth(clean_log(spark, sf_dir).filter(is_event(PURCHASE)), "user_id", "product_id")
    sets = truth_sets(bought, "user_id", "product_id")
    size = F.size("true_items").cast("long")
    return sets.select("user_id", size.alias("size"), F.array_join("true_items", ",").alias("items"))


@query(
    "ag11_group_size_histogram",
    with_log(
        """SELECT n AS total_interactions, count(*) AS count FROM (SELECT user_id, count(*) AS n FROM log GROUP BY user_id) GROUP BY n"""
    ),
)
def ag11(spark, sf_dir):
    return profile.size_histogram(event_log(spark, sf_dir), "user_id")


@query(
    "ag12_distinct_values",
    with_log("SELECT count(*) AS distinct_values FROM (SELECT DISTINCT user_session FROM log)"),
)
def ag12(spark, sf_dir):
    return profile.distinct_count(event_log(spark, sf_dir), "user_session")


@query(
    "ag13_several_averages",
    with_log(
        f"""SELECT event_type, {r('avg(price)')} AS avg_price, {r('avg(is_brand_missing)')} AS avg_missing,
{r('avg(hour(event_time))')} AS avg_hour FROM clean_all_abs GROUP BY event_type"""
    ),
)
def ag13(spark, sf_dir):
    return rounded(
        clean_log(spark, sf_dir, removals=True)
        .groupBy("event_type")
        .agg(
            F.avg("price").alias("avg_price"),
            F.avg("is_brand_missing").alias("avg_missing"),
            F.avg(F.hour("event_time")).alias("avg_hour"),
        )
    )


SUMMARY = "count(v) AS count, {} AS mean, {} AS std, min(v) AS min, {} AS p25, {} AS p50, {} AS p75, max(v) AS max".format(
    r("avg(v)"),
    r("stddev_samp(v)"),
    *[r(f"quantile_cont(v, {q})") for q in (0.25, 0.5, 0.75)],
)


@query("ag15_summary_of_price", with_log(f"SELECT {SUMMARY} FROM (SELECT price AS v FROM clean)"))
def ag15(spark, sf_dir):
    return rounded(profile.describe_column(clean_log(spark, sf_dir), "price"))


@query("ag16_value_counts", with_log("SELECT event_type, count(*) AS count FROM visit GROUP BY event_type", VISITS))
def ag16(spark, sf_dir):
    return profile.value_counts(visit_rows(spark, sf_dir), "event_type")


def histogram_sql(source: str, column: str, bins: int) -> tuple[str, str]:
    cte = f"""
edge AS (SELECT min({column})::DOUBLE AS low, max({column})::DOUBLE AS high FROM {source}),
binned AS (SELECT low, high, CASE WHEN low = high THEN 1 ELSE
           least(CAST(floor({bins} * ({column}::DOUBLE - low) / (high - low)) AS INTEGER) + 1, {bins}) END AS bin
           FROM {source}, edge WHERE {column} IS NOT NULL)"""
    body = f"""SELECT bin, count(*) AS count, {r(f'any_value(low) + (any_value(high) - any_value(low)) / {bins} * (bin - 1)')} AS bin_start
FROM binned GROUP BY bin"""
    return body, cte


PRICE_BODY, PRICE_CTE = histogram_sql("visit", "price", 20)


@query("ag17_histogram_of_price", with_log(PRICE_BODY, VISITS, PRICE_CTE))
def ag17(spark, sf_dir):
    return rounded(profile.histogram(visit_rows(spark, sf_dir), "price", 20))


# Windows ----------------------------------------------------------------------------------------


@query(
    "wn1_row_number_by_time",
    with_log(
        """SELECT user_id, product_id, event_time, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS interaction_rank
FROM clean"""
    ),
)
def wn1(spark, sf_dir):
    return splits.ranked_history(parked_clean(spark, sf_dir)).select(*EVENT, "interaction_rank")


@query("wn2_top_three_by_count", with_log("SELECT user_id, category_id, place FROM placed WHERE place <= 3", PLACED))
def wn2(spark, sf_dir):
    return placed_categories(spark, sf_dir).filter("place <= 3").select("user_id", "category_id", "place")


@query("wn3_first_by_count", with_log("SELECT user_id, category_id FROM placed WHERE place = 1", PLACED))
def wn3(spark, sf_dir):
    return placed_categories(spark, sf_dir).filter("place = 1").select("user_id", "category_id")


@query(
    "wn4_mean_over_category",
    with_log(
        f"""SELECT user_id, product_id, event_time, event_type, {r('avg(price) OVER (PARTITION BY category_id)')} AS avg_cat_price FROM clean"""
    ),
)
def wn4(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    means = rows.groupBy("category_id").agg(F.avg("price").alias("avg_cat_price"))
    joined = left_join(rows, means, ["category_id"], hot_keys(rows, "category_id"), null_safe=True)
    return rounded(joined.select(*EVENT, "avg_cat_price"))


@query(
    "wn5_max_views_in_category",
    with_log(
        """SELECT DISTINCT c.product_id, c.category_id, max(p.views) OVER (PARTITION BY c.category_id) AS max_view_category
FROM clean c JOIN product p USING (product_id)""",
        PRODUCT_SQL,
    ),
)
def wn5(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    shares = attach.product_popularity(rows, hot_keys(rows, "category_id"))
    return shares.select("product_id", "category_id", "max_view_category")


@query(
    "wn6_running_views",
    with_log(
        """SELECT DISTINCT user_id, user_session, event_time,
CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, user_session ORDER BY event_time) AS BIGINT) AS views
FROM visit""",
        VISITS,
    ),
)
def wn6(spark, sf_dir):
    rows = parked_visits(spark, sf_dir)
    moments = rows.groupBy(*grains.SESSION_KEYS, "event_time").agg(F.count_if(is_event(VIEW)).alias("seen"))
    hot = hot_keys(rows, *grains.SESSION_KEYS)
    summed = running(moments, grains.SESSION_KEYS, [F.col("event_time")], [Running("views", "sum", "seen")], hot)
    return summed.drop("seen")


LAGGED = f"""
lagged AS (SELECT *, coalesce({seconds('event_time')} - lag({seconds('event_time')}) OVER (PARTITION BY user_id, user_session ORDER BY event_time), 0) AS time_diff
           FROM visit)"""


@query(
    "wn7_time_since_previous",
    with_log("SELECT user_id, user_session, event_time, time_diff FROM lagged", VISITS, LAGGED),
)
def wn7(spark, sf_dir):
    rows = visits.with_time_diff(parked_visits(spark, sf_dir))
    return rows.select("user_id", "user_session", "event_time", "time_diff")


FLAGGED = """
flagged AS (SELECT *, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, user_session) AS session_purchase FROM visit)"""


@query(
    "wn8_session_has_purchase",
    with_log("SELECT DISTINCT user_id, user_session, session_purchase FROM flagged", VISITS, FLAGGED),
)
def wn8(spark, sf_dir):
    rows = visits.with_session_purchase(parked_visits(spark, sf_dir))
    return rows.select("user_id", "user_session", "session_purchase").distinct()


# Visits -----------------------------------------------------------------------------------------


@query("sa1_rows_with_session_purchase", with_log("SELECT * FROM flagged", VISITS, FLAGGED))
def sa1(spark, sf_dir):
    rows = visits.with_session_purchase(parked_visits(spark, sf_dir))
    return sort_rows(rows, "user_id", "user_session", "event_time")


BEFORE = """
before AS (SELECT * FROM (SELECT user_id, user_session, event_type,
           CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, user_session ORDER BY event_time) AS BIGINT) AS views_before_purchase
           FROM visit) WHERE event_type = 'purchase')"""


@query(
    "sa2_views_before_purchase",
    with_log("SELECT user_id, user_session, views_before_purchase FROM before", VISITS, BEFORE),
)
def sa2(spark, sf_dir):
    return visits.views_before_purchase(parked_visits(spark, sf_dir))


@query(
    "sa3_daily_sessions",
    with_log(
        """SELECT user_id, CAST(event_time AS DATE) AS date, count(DISTINCT user_session) AS distinct_sessions FROM visit GROUP BY ALL""",
        VISITS,
    ),
)
def sa3(spark, sf_dir):
    return visits.daily_sessions(visit_rows(spark, sf_dir))


@query(
    "sa4_active_days",
    with_log(
        "SELECT user_id, count(DISTINCT CAST(event_time AS DATE)) AS daily_visit_frequency FROM visit GROUP BY user_id",
        VISITS,
    ),
)
def sa4(spark, sf_dir):
    return visits.active_days(visit_rows(spark, sf_dir))


@query(
    "sa5_weekly_sessions",
    with_log(
        """SELECT user_id, CAST(weekofyear(event_time) AS INTEGER) AS week, count(DISTINCT user_session) AS distinct_sessions
FROM visit GROUP BY ALL""",
        VISITS,
    ),
)
def sa5(spark, sf_dir):
    return visits.weekly_sessions(visit_rows(spark, sf_dir))


@query(
    "sa6_active_weeks",
    with_log(
        "SELECT user_id, count(DISTINCT weekofyear(event_time)) AS weekly_visit_frequency FROM visit GROUP BY user_id",
        VISITS,
    ),
)
def sa6(spark, sf_dir):
    return visits.active_weeks(visit_rows(spark, sf_dir))


LENGTHS = """
lengths AS (SELECT user_id, user_session, CAST(sum(time_diff) AS DOUBLE) AS session_length FROM lagged GROUP BY user_id, user_session)"""


@query("sa7_session_lengths", with_log("SELECT * FROM lengths", VISITS, LAGGED, LENGTHS))
def sa7(spark, sf_dir):
    return visits.session_lengths(visit_rows(spark, sf_dir))


@query(
    "sa8_average_session_length",
    with_log(
        f"SELECT user_id, {r('avg(session_length)')} AS average_session_length FROM lengths GROUP BY user_id",
        VISITS,
        LAGGED,
        LENGTHS,
    ),
)
def sa8(spark, sf_dir):
    return rounded(visits.average_session_length(visit_rows(spark, sf_dir)))


@query(
    "sa9_views_before_purchase_summary",
    with_log(f"SELECT {SUMMARY} FROM (SELECT views_before_purchase::DOUBLE AS v FROM before)", VISITS, BEFORE),
)
def sa9_views(spark, sf_dir):
    views = visits.views_before_purchase(parked_visits(spark, sf_dir))
    return rounded(profile.describe_column(views, "views_before_purchase"))


DAYS = """
active AS (SELECT user_id, count(DISTINCT CAST(event_time AS DATE)) AS days FROM visit GROUP BY user_id)"""
DAYS_BODY, DAYS_CTE = histogram_sql("active", "days", 10)


@query("sa9_active_days_histogram", with_log(DAYS_BODY, VISITS, DAYS, DAYS_CTE))
def sa9_days(spark, sf_dir):
    return rounded(profile.histogram(visits.active_days(visit_rows(spark, sf_dir)), "daily_visit_frequency", 10))


# Sorts, limits, set operators -------------------------------------------------------------------


@query("so1_sort_one_column", with_log("SELECT * FROM clean"))
def so1(spark, sf_dir):
    return sort_rows(clean_log(spark, sf_dir), "event_time")


@query("so2_sort_several_columns", with_log("SELECT * FROM visit", VISITS))
def so2(spark, sf_dir):
    return sort_rows(visit_rows(spark, sf_dir), "user_id", "user_session", "event_time")


@query(
    "so3_descending_window",
    with_log(
        """SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, product_id) AS place
FROM (SELECT user_id, product_id, count(*) AS n FROM clean GROUP BY ALL)"""
    ),
)
def so3(spark, sf_dir):
    counted = park(clean_log(spark, sf_dir).groupBy("user_id", "product_id").count(), "pairs")
    ranked = running(
        counted, ["user_id"], [F.desc("count"), F.col("product_id")], [Running("place", "number")], hot_keys(counted, "user_id")
    )
    return ranked.drop("count")


@query("so4_limit", with_log(f"SELECT {', '.join(EVENT)} FROM clean ORDER BY ALL NULLS LAST LIMIT 1000"))
def so4(spark, sf_dir):
    return clean_log(spark, sf_dir).select(*EVENT).orderBy(*[F.col(c).asc_nulls_last() for c in EVENT]).limit(1000)


@query(
    "so5_top_three_products",
    with_log(
        """SELECT * FROM (SELECT user_id, product_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, product_id) AS place
FROM (SELECT user_id, product_id, count(*) AS n FROM clean GROUP BY ALL)) WHERE place <= 3"""
    ),
)
def so5(spark, sf_dir):
    counted = clean_log(spark, sf_dir).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "product_id"))
    return counted.withColumn("place", place.cast("long")).filter("place <= 3")


@query(
    "se1_union_all",
    with_log("SELECT * FROM log WHERE event_type = 'view' UNION ALL SELECT * FROM log WHERE event_type = 'purchase'"),
)
def se1(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.filter(is_event(VIEW)).unionByName(log.filter(is_event(PURCHASE)))


@query("se2_distinct", with_log("SELECT DISTINCT user_id, product_id FROM log"))
def se2(spark, sf_dir):
    return event_log(spark, sf_dir).select("user_id", "product_id").distinct()


def split_sql(source: str, cutoffs: list[tuple[str, float]], above: int, columns: str, time: str = "event_time") -> str:
    cases = " ".join(f"WHEN rank <= total * {share}::DOUBLE THEN '{name}'" for name, share in cutoffs)
    return f"""
parts AS (SELECT {columns}, rank AS interaction_rank, CASE {cases} ELSE 'test' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY {time}) AS rank
  FROM {source} WHERE user_id IS NOT NULL) WHERE total > {above})"""


THREE = [("train", 0.75), ("val", 0.9)]
KEYS = "user_id, product_id, event_time, event_type"
THREE_PARTS = split_sql("log", THREE, 10, KEYS)


def three_parts(spark, sf_dir):
    return splits.split_history(park(event_log(spark, sf_dir), "log"), THREE)


@query(
    "se3_users_in_both",
    with_log(
        """SELECT user_id FROM parts WHERE split = 'val' INTERSECT SELECT user_id FROM parts WHERE split = 'train'""",
        THREE_PARTS,
    ),
)
def se3(spark, sf_dir):
    parts = splits.split_parts(three_parts(spark, sf_dir), ("train", "val"))
    return parts["val"].select("user_id").intersect(parts["train"].select("user_id"))


@query(
    "se4_products_only_in_one",
    with_log(
        """SELECT product_id FROM parts WHERE split = 'train' AND event_type = 'purchase'
EXCEPT SELECT product_id FROM parts WHERE split = 'test' AND event_type = 'purchase'""",
        THREE_PARTS,
    ),
)
def se4(spark, sf_dir):
    parts = splits.split_parts(three_parts(spark, sf_dir).filter(is_event(PURCHASE)))
    return parts["train"].select("product_id").subtract(parts["test"].select("product_id"))


def coverage_sql(noun: str, column: str) -> str:
    return f"""SELECT '{noun}' AS id, a.name AS part, b.name AS other, count(*) FILTER (ia) AS ids, count(*) FILTER (ia AND ib) AS common,
count(*) FILTER (ia AND NOT ib) AS alone
FROM (VALUES ('train'), ('val'), ('test')) a(name) JOIN (VALUES ('train'), ('val'), ('test')) b(name) ON a.name <> b.name
JOIN (SELECT {column}, s.name AS na, t.name AS nb, bool_or(split = s.name) AS ia, bool_or(split = t.name) AS ib FROM parts,
      (VALUES ('train'), ('val'), ('test')) s(name), (VALUES ('train'), ('val'), ('test')) t(name) GROUP BY ALL) f
  ON f.na = a.name AND f.nb = b.name GROUP BY a.name, b.name"""


@query(
    "se5_split_coverage",
    with_log(f"{coverage_sql('user', 'user_id')} UNION ALL {coverage_sql('product', 'product_id')}", THREE_PARTS),
)
def se5(spark, sf_dir):
    split = three_parts(spark, sf_dir)
    return splits.coverage(split, {"user": "user_id", "product": "product_id"}, ["train", "val", "test"])


# Splits -----------------------------------------------------------------------------------------

CLEAN_COLUMNS = "event_time AS event_timestamp, event_type, product_id, category_id, brand, price, user_id, user_session, is_brand_missing"


@query(
    "sp1_two_way_split",
    with_log("SELECT * FROM parts", split_sql("clean", [("train", 0.8)], 10, CLEAN_COLUMNS)),
)
def sp1(spark, sf_dir):
    rows = parked_clean(spark, sf_dir).withColumnRenamed("event_time", "event_timestamp")
    return splits.split_history(rows, time="event_timestamp")


@query("sp2_three_way_split", with_log("SELECT * FROM parts", THREE_PARTS))
def sp2(spark, sf_dir):
    return three_parts(spark, sf_dir).select(*EVENT, "interaction_rank", "split")


@query(
    "sp3_three_way_split_written",
    with_log(
        "SELECT * FROM parts",
        "kept AS (SELECT * FROM log WHERE event_type <> 'remove_from_cart')",
        split_sql("kept", [("train", 0.7), ("val", 0.85)], 2, KEYS),
    ),
)
def sp3(spark, sf_dir):
    log = park(event_log(spark, sf_dir).filter("event_type <> 'remove_from_cart'"), "log")
    split = splits.split_history(log, [("train", 0.7), ("val", 0.85)], above=2)
    folder = new_folder(spark, "parts")
    splits.write_parts(split, folder)
    return spark.read.parquet(folder).select(*EVENT, "interaction_rank", "split")


FLAG = """
flag AS (SELECT user_id, product_id, event_time, event_type, rank AS interaction_rank, rank <= total * 0.7::DOUBLE OR total <= {small} AS is_train FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS rank
  FROM clean WHERE user_id IS NOT NULL) WHERE total > {above})"""


@query("sp4_train_flag", with_log("SELECT * FROM flag", FLAG.format(small=2, above=3)))
def sp4(spark, sf_dir):
    return splits.train_flag(parked_clean(spark, sf_dir)).select(*EVENT, "interaction_rank", "is_train")


@query("sp4_train_flag_small_users_kept", with_log("SELECT * FROM flag", FLAG.format(small=40, above=0)))
def sp4_kept(spark, sf_dir):
    rows = splits.train_flag(parked_clean(spark, sf_dir), above=0, all_train_upto=40)
    return rows.select(*EVENT, "interaction_rank", "is_train")


@query(
    "sp5_calendar_split",
    with_log(
        """SELECT *, CASE WHEN event_time < TIMESTAMP '2024-01-18' THEN 'train' WHEN event_time < TIMESTAMP '2024-01-24' THEN 'val'
ELSE 'test' END AS split FROM log"""
    ),
)
def sp5(spark, sf_dir):
    ends = [("train", datetime.datetime(2024, 1, 18)), ("val", datetime.datetime(2024, 1, 24))]
    return splits.calendar_split(event_log(spark, sf_dir), ends)
