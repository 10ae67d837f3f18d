"""Small hand-made inputs, one per rule that is easy to get wrong."""

import datetime

import pytest
from pyspark.sql import functions as F

from clickgrain.functions import cycle, ndcg_at_k, precision_at_k, recall_at_k
from clickgrain.operators import attach, cleaning, profile, quality, ranking, splits, visits
from clickgrain.plans import store
from clickgrain.plans.features import feature_table, feature_table_of_log
from clickgrain.session import park
from clickgrain.sources import declared_schema, normalise_to_parquet


def day(n, clock="10:00:00"):
    return f"2024-01-{n:02d} {clock}"


def event(at, kind, product="p1", category="c1", brand="b", price=10.0, user="u1", session="s1"):
    return (at, kind, product, category, brand, price, user, session)


def features(make_log, rows, **options):
    cleaned = park(cleaning.clean(make_log(rows)), "micro")
    return feature_table(cleaned, **options)


def test_mean_price_over_1000_keeps_its_value(make_log):
    table = features(make_log, [event(day(1), "purchase", price=1234.5)])
    assert table.first()["Avg_purchase_price"] == 1234.5


def test_conversion_rate_and_its_compatible_value(make_log):
    rows = [event(day(1, f"10:00:0{i}"), "view") for i in range(4)]
    rows += [event(day(2), "cart"), event(day(2, "11:00:00"), "purchase"), event(day(3), "purchase")]
    assert features(make_log, rows).first()["view_to_purchase_conversion_rate_for_item"] == 0.5
    assert features(make_log, rows, compat=True).first()["view_to_purchase_conversion_rate_for_item"] == 0.5
    more = [*rows, event(day(4), "cart")]
    assert features(make_log, more, compat=True).first()["view_to_purchase_conversion_rate_for_item"] == 1.0


def test_bought_before_viewed_and_same_instant(make_log):
    rows = [
        event(day(1), "purchase"), event(day(3), "view"),
        event(day(5), "purchase", product="p2"), event(day(5), "view", product="p2"),
    ]
    found = {r["product_id"]: r["view_to_purchase_time"] for r in features(make_log, rows).collect()}
    assert found == {"p1": -2.0, "p2": 0.0}


def test_user_without_purchase(make_log):
    rows = [event(day(1), "view", user="u2"), event(day(4), "purchase"), event(day(5), "view")]
    row = features(make_log, rows).filter("user_id = 'u2'").first()
    assert row["Recency"] == 4.0 and row["Frequency"] == 0 and row["Monetary"] == 0.0
    assert row["1_most_purchased_category"] == row["3_most_purchased_category"] == "No purchase"


def test_top_categories_fall_back_and_break_ties_by_name(make_log):
    one = [event(day(1), "purchase", category="z")]
    row = features(make_log, one).first()
    assert [row[f"{i}_most_purchased_category"] for i in (1, 2, 3)] == ["z", "z", "z"]
    tied = [event(day(i), "purchase", category=c) for i, c in ((1, "b"), (2, "a"), (3, None), (4, "c"), (5, "c"))]
    row = features(make_log, tied).first()
    assert [row[f"{i}_most_purchased_category"] for i in (1, 2, 3)] == ["c", "a", "b"]


def test_session_ratios(make_log):
    carts = [event(day(1), "cart")]
    row = features(make_log, carts).first()
    assert row["session_cart_to_purchase_ratio"] == 0.0 and row["session_cart_abandonment_rate"] == 1.0
    buys = [event(day(1), "purchase")]
    row = features(make_log, buys).first()
    assert row["session_cart_to_purchase_ratio"] == 0.0 and row["session_cart_abandonment_rate"] == 0.0
    more = [event(day(1), "cart"), event(day(1, "11:00:00"), "purchase"), event(day(1, "12:00:00"), "purchase")]
    row = features(make_log, more).first()
    assert row["session_cart_to_purchase_ratio"] == 0.5 and row["session_cart_abandonment_rate"] == -1.0
    assert row["session_duration"] == 7200


def test_null_keys_do_not_join_but_form_a_window_group(make_log):
    rows = [
        event(day(1), "purchase", user=None, price=4.0, category=None),
        event(day(2), "purchase", user=None, price=8.0, category=None),
        event(day(3), "view", price=5.0),
    ]
    table = features(make_log, rows)
    assert table.count() == 3
    null_user = table.filter("user_id IS NULL").orderBy("event_timestamp").collect()
    assert [r["Frequency"] for r in null_user] == [0, 0]
    assert [r["interaction_score"] for r in null_user] == [0.0, 0.0]
    assert null_user[0]["session_duration"] is None and null_user[0]["num_session_purchase"] == 0
    assert null_user[0]["normalised_price"] == pytest.approx(4 / 6)
    assert null_user[0]["Recency"] == 2.0


def test_zero_price_category(make_log):
    assert features(make_log, [event(day(1), "view", price=0.0)]).first()["normalised_price"] is None


def test_literal_unknown_brand_counts_as_missing(make_log):
    rows = [event(day(1), "view", brand="UNKNOWN"), event(day(2), "view", brand=None), event(day(3), "view")]
    flags = cleaning.clean(make_log(rows)).orderBy("event_time").collect()
    assert [r["is_brand_missing"] for r in flags] == [1, 1, 0]


def test_copies_are_judged_before_the_sign_is_dropped(make_log):
    rows = [event(day(1), "view", price=-3.0), event(day(1), "view", price=3.0), event(day(1), "view", price=3.0)]
    assert [r["price"] for r in cleaning.clean(make_log(rows)).collect()] == [3.0, 3.0]


def test_removals_do_not_reach_the_feature_table(make_log):
    rows = [event(day(1), "remove_from_cart"), event(day(2), "view")]
    assert feature_table_of_log(make_log(rows)).count() == 1


def test_two_day_bucket_starts_at_the_epoch(make_log):
    rows = [event(day(1), "purchase"), event(day(2), "purchase"), event(day(3), "purchase"), event(day(5), "view")]
    found = attach.with_two_day_purchases(cleaning.clean(make_log(rows))).orderBy("event_time").collect()
    bucket = [int(r["event_time"].replace(tzinfo=datetime.timezone.utc).timestamp()) // 172800 for r in found]
    expected = [sum(b == c and r["event_type"] == "purchase" for c, r in zip(bucket, found)) for b in bucket]
    assert [r["Num_purchase_per_2day"] for r in found] == expected


def test_split_threshold_and_cut(make_log):
    rows = [event(day(i), "view", user="ten") for i in range(1, 11)]
    rows += [event(day(i), "view", user="eleven") for i in range(1, 12)]
    split = splits.split_history(make_log(rows))
    assert {r["user_id"] for r in split.collect()} == {"eleven"}
    assert [r["split"] for r in split.orderBy("interaction_rank").collect()] == ["train"] * 8 + ["test"] * 3
    parts = splits.split_parts(split)
    assert parts["train"].count() + parts["test"].count() == split.count()


def test_small_users_can_stay_in_train(make_log):
    rows = [event(day(1), "view", user="a"), event(day(2), "view", user="a")]
    flags = splits.train_flag(make_log(rows), above=0).orderBy("interaction_rank").collect()
    assert [r["is_train"] for r in flags] == [True, True]
    assert splits.train_flag(make_log(rows)).count() == 0


def test_views_before_purchase_counts_peers_and_repeats(make_log):
    rows = [
        event(day(1), "view"), event(day(1, "10:05:00"), "view", product="p2"),
        event(day(1, "10:05:00"), "purchase"), event(day(1, "10:05:00"), "purchase", product="p3"),
        event(day(1, "10:06:00"), "view"),
    ]
    found = visits.views_before_purchase(visits.visit_log(make_log(rows))).collect()
    assert [r["views_before_purchase"] for r in found] == [2, 2]


def test_session_length_equals_the_sum_of_gaps(make_log):
    log = make_log([event(day(1, f"10:00:{s:02d}.7"), "view") for s in (1, 5, 30)])
    gaps = visits.with_time_diff(log).agg(F.sum("time_diff")).first()[0]
    assert visits.session_lengths(log).first()["session_length"] == float(gaps) == 29.0


def test_summary_of_constants_and_quantiles(spark):
    numbers = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    row = profile.describe_column(numbers, "v").first()
    assert (row["count"], row["mean"], row["p25"], row["p50"], row["p75"]) == (4, 2.5, 1.75, 2.5, 3.25)
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert profile.histogram(same, "v", 5).collect()[0]["count"] == 2


def test_cycle_uses_one_period_for_all_parts(spark):
    sine, cosine = cycle(F.lit(6))
    row = spark.range(1).select(sine.alias("s"), cosine.alias("c"), (sine * sine + cosine * cosine).alias("one")).first()
    assert row["s"] == pytest.approx(1.0) and row["c"] == pytest.approx(0.0, abs=1e-9)
    assert row["one"] == pytest.approx(1.0)


@pytest.fixture()
def bad_log(make_log):
    rows = [
        event(day(1), "signup"), event(day(1), "view", user=None), event(day(2), "view", product=None),
        event(day(3), "view", category=None), event(day(4), None), event(day(5), "view", session=None),
        event(None, "view"), event(day(6), "view"), event(day(6), "view"),
    ]
    return make_log(rows).withColumn("price", F.col("price").cast("string"))


def test_suite_finds_every_fault(bad_log):
    results = {(r["kind"], r["columns"]): r for r in quality.run_suite(bad_log.drop("brand").withColumn("brand", F.lit("x"))).collect()}
    assert all(results[("not_null", c)]["unexpected"] == 1 for c in quality.NEVER_NULL)
    assert results[("in_set", "event_type")]["unexpected"] == 1
    assert results[("unique", ",".join(quality.ALL_COLUMNS))]["unexpected"] == 2
    assert not results[("type", "price")]["success"]
    assert results[("type", "event_time")]["success"]
    with pytest.raises(quality.ChecksFailed, match="not_null"):
        quality.raise_on_failure(quality.run_suite(bad_log))


def test_first_place_for_nine_columns_fails_eight_times(make_log):
    results = quality.run_suite(make_log([event(day(1), "view")]), quality.standard_suite(index=0))
    failed = results.filter("kind = 'exists' AND NOT success").count()
    assert failed == 8 and results.count() == 24


def test_missing_column_is_reported(make_log):
    checks = [quality.Check("exists", ("colour",)), quality.Check("type", ("colour",), ("StringType",))]
    assert [r["success"] for r in quality.run_suite(make_log([event(day(1), "view")]), checks).collect()] == [False] * 2


def test_metrics_with_repeats_and_as_sets(spark):
    truth_rows = spark.createDataFrame([("u", "a", 2), ("u", "b", 1), ("v", "c", 1)], "user string, item string, times long")
    places = spark.createDataFrame([("u", "b", 1), ("u", "x", 2), ("u", "a", 3), ("w", "c", 1)], "user string, item string, place int")
    lists = spark.createDataFrame([(["a", "a", "b"], ["b", "x", "a"])], "t array<string>, p array<string>")
    for k in (1, 2, 3):
        (row,) = ranking.user_metrics(truth_rows, places, "user", "item", k).collect()
        arrays = lists.select(
            recall_at_k(F.col("t"), F.col("p"), k), precision_at_k(F.col("t"), F.col("p"), k), ndcg_at_k(F.col("t"), F.col("p"), k)
        ).first()
        assert (row["recall"], row["precision"], row["ndcg"]) == pytest.approx(tuple(arrays))
        assert 0 <= row["recall"] <= 1 and 0 <= row["ndcg"] <= 1
        (as_set,) = ranking.user_metrics(truth_rows, places, "user", "item", k, repeats=False).collect()
        assert as_set["recall"] == pytest.approx(row["hits"] / 2)


def test_equal_lists_need_the_same_order_and_length(spark):
    truth_rows = spark.createDataFrame([("u", "a", 1), ("u", "b", 1), ("v", "a", 2), ("w", "a", 1), ("w", "b", 1)], "user string, item string, times long")
    places = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "a", 1), ("w", "b", 1), ("w", "a", 2)], "user string, item string, place int")
    found = ranking.equal_lists(truth_rows, places, "user", "item").collect()
    assert [(r["user"], r["true_items"]) for r in found] == [("u", ["a", "b"])]


def test_latest_row_and_its_window(spark, make_log):
    table = features(make_log, [event("2023-10-01 00:00:00", "view", user="old"), event(day(1), "view"), event(day(9), "cart")])
    newest = store.latest(table, store.CUSTOMER_VIEW).collect()
    assert [(r["user_id"], r["event_timestamp"].day) for r in newest] == [("u1", 9)]
    assert store.latest(table, store.CUSTOMER_VIEW, months=6).count() == 2


def test_lookup_of_known_and_unknown_keys(spark, make_log, tmp_path):
    table = park(features(make_log, [event(day(1), "view"), event(day(2), "purchase")]), "features")
    folders = store.materialise(table, str(tmp_path / "online"))
    tables = {name: spark.read.parquet(path) for name, path in folders.items()}
    known = {"user_id": "u1", "product_id": "p1", "user_session": "s1", "category_id": "c1"}
    rows = store.lookup_rows(spark, [known, {**known, "user_id": "nobody"}], tables).orderBy("user_id").collect()
    assert rows[0]["Frequency"] is None and rows[0]["total_purchase_of_product"] == 1
    assert rows[1]["Frequency"] == 1 and rows[1]["interaction_score"] == 2.0
    assert len(store.feature_references()) == 42


def test_schema_from_configuration():
    schema = declared_schema([{"name": "a", "type": "StringType"}, {"name": "b", "type": "FloatType"}])
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("a", "string", True), ("b", "float", True)]
    with pytest.raises(ValueError, match="Nonsense"):
        declared_schema([{"name": "a", "type": "Nonsense"}])


def test_normalised_log_is_kept_until_refreshed(spark, make_log, tmp_path):
    source, target = str(tmp_path / "csv"), str(tmp_path / "parquet")
    make_log([event(day(1), "view"), event(day(2), "remove_from_cart")]).write.csv(source, header=True)
    assert normalise_to_parquet(spark, source, target) == target
    assert spark.read.parquet(target).count() == 1
    make_log([event(day(3), "view"), event(day(4), "cart")]).write.mode("overwrite").csv(source, header=True)
    normalise_to_parquet(spark, source, target)
    assert spark.read.parquet(target).count() == 1
    normalise_to_parquet(spark, source, target, refresh=True)
    assert spark.read.parquet(target).count() == 2
