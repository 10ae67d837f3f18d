"""Hot keys: spread joins and sliced scans give what the plain plan gives."""

import random

import pytest
from pyspark.sql import functions as F

from clickgrain.operators import ordered
from clickgrain.operators.ordered import Running, global_number, in_slices, running, slices_of, sort_rows
from clickgrain.operators.skew import HotKeys, find_hot, left_join
from clickgrain.operators.splits import ranked_history, split_history, train_flag
from clickgrain.operators.visits import views_before_purchase, with_session_purchase, with_time_diff
from clickgrain.plans.features import feature_table
from clickgrain.plans.mlprep import frequency_index, with_index
from clickgrain.plans.store import as_of, point_in_time
from clickgrain.session import park
from clickgrain.sources.testlog import event_log


@pytest.fixture(scope="module")
def events(spark):
    """A third of the rows belongs to one key, another part to none."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else (None if i % 10 == 1 else f"k{rng.randrange(20)}")
        rows.append((key, rng.randrange(200), i, rng.randrange(10) if i % 4 else None))
    return park(spark.createDataFrame(rows, "key string, at int, id int, value int"), "events")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_find_hot_finds_the_large_keys_only(events):
    hot = find_hot(events, {"key": ["key"], "id": ["id"]}, min_rows=100)
    expected = events.filter("key = 'hot'").select(F.xxhash64("key")).first()[0]
    assert list(hot["key"]) == [expected] and hot["key"][expected] == 2
    assert hot["id"] == {}
    assert find_hot(events, {"key": ["key"]}) == {"key": {}}


@pytest.mark.parametrize("null_safe", [False, True])
def test_spread_join_equals_plain_join(events, null_safe):
    side = events.groupBy("key").agg(F.sum("value").alias("total"))
    hot = find_hot(events, {"key": ["key"]}, min_rows=15)["key"]
    assert len(hot) >= 2
    plain = left_join(events, side, ["key"], None, null_safe)
    spread = left_join(events, side, ["key"], hot, null_safe)
    assert spread.columns == plain.columns
    assert rows_of(spread) == rows_of(plain)
    assert spread.count() == events.count()


def test_spread_join_uses_several_tasks(events, spark):
    side = events.groupBy("key").agg(F.sum("value").alias("total"))
    hot = find_hot(events, {"key": ["key"]}, min_rows=20)["key"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = left_join(events, side, ["key"], hot).filter("key = 'hot'").withColumn("p", F.spark_partition_id())
        assert spread.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def brute_force(rows):
    """Row number, running sum, last value and lag per key in order of (at, id)."""
    state, out = {}, {}
    for key, at, ident, value in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        number, total, last, previous = state.get(key, (0, None, None, None))
        if value is not None:
            total, last = (total or 0) + value, value
        out[ident] = (number + 1, total, last, previous)
        state[key] = (number + 1, total, last, value)
    return out


SPECS = [
    Running("number", "number"),
    Running("total", "sum", "value"),
    Running("last", "last", "value"),
    Running("previous", "lag", "value"),
]


@pytest.mark.parametrize("min_rows", [10_000, 100, 15])
def test_running_equals_brute_force(events, min_rows):
    hot = find_hot(events, {"key": ["key"]}, min_rows=min_rows)["key"]
    scanned = running(events, ["key"], [F.col("at"), F.col("id")], SPECS, hot)
    found = {r["id"]: (r["number"], r["total"], r["last"], r["previous"]) for r in scanned.collect()}
    assert found == brute_force([tuple(r) for r in events.collect()])


@pytest.mark.parametrize("slices", [1, 3, 16, 64])
def test_slices_of_any_number_give_the_same(events, slices):
    scanned = in_slices(events, ["key"], [F.col("at"), F.col("id")], SPECS, slices)
    found = {r["id"]: (r["number"], r["total"], r["last"], r["previous"]) for r in scanned.collect()}
    assert found == brute_force([tuple(r) for r in events.collect()])


def test_many_small_hot_keys_make_few_slices(events, monkeypatch):
    """A slice is a task and a file: with some rows a share there were more of them than rows."""
    hot, made = find_hot(events, {"key": ["key"]}, min_rows=2)["key"], []
    cut = ordered.in_slices
    monkeypatch.setattr(ordered, "in_slices", lambda *a: made.append(a[-1]) or cut(*a))
    scanned = running(events, ["key"], [F.col("at"), F.col("id")], SPECS, hot)
    found = {r["id"]: (r["number"], r["total"], r["last"], r["previous"]) for r in scanned.collect()}
    assert made == [4] and hot.rows == 600 and sum(hot.values()) >= 300
    assert found == brute_force([tuple(r) for r in events.collect()])


def test_large_hot_keys_keep_their_slices():
    hot = HotKeys({1: 3, 2: 40})
    hot.rows = 43 * 1_000_000
    assert slices_of(hot, 4) == slices_of(hot, 200) == 86
    hot.rows = 3 * ordered.SLICE_ROWS
    assert slices_of(hot, 2) == 3 and slices_of(hot, 20) == 20
    assert slices_of({1: 1}, 200) == 2 and slices_of({1: 500}, 200) == 200


def test_global_number_and_sort(events):
    numbered = global_number(events, [F.desc("at"), F.col("id")], "n", slices=7)
    found = [r["id"] for r in numbered.orderBy("n").collect()]
    expected = sorted(events.collect(), key=lambda r: (-r["at"], r["id"]))
    assert found == [r["id"] for r in expected]
    assert [r["at"] for r in sort_rows(events, "at").collect()] == sorted(r["at"] for r in events.collect())


def test_as_of_equals_brute_force(spark):
    rng = random.Random(3)
    offers = [(rng.choice(["a", "b", "c", None]), rng.randrange(50), rng.randrange(1000)) for _ in range(150)]
    asks = [(rng.choice(["a", "a", "b", "d", None]), rng.randrange(60), i) for i in range(200)]
    features = park(spark.createDataFrame(offers, "k string, t int, f int"), "offers")
    entities = park(spark.createDataFrame(asks, "k string, t int, id int"), "asks")
    expected = []
    for k, t, i in asks:
        fits = [(ft, f) for fk, ft, f in offers if k is not None and fk == k and ft <= t]
        expected.append((k, t, i, max(fits)[1] if fits else None))
    keys = entities.select("k").unionByName(features.select("k"))
    for hot_rows in (10_000, 20):
        hot = find_hot(keys, {"k": ["k"]}, min_rows=hot_rows)["k"]
        found = as_of(entities, features, ["k"], ["f"], "t", hot)
        assert rows_of(found) == sorted(expected, key=str)


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return park(event_log(spark, sf_dir), "log")


@pytest.mark.parametrize(
    "operator", [views_before_purchase, with_session_purchase, with_time_diff, split_history, train_flag]
)
def test_operators_do_not_depend_on_what_is_hot(raw, operator):
    log = park(raw.dropDuplicates().filter("user_session IS NOT NULL"), "log")
    assert rows_of(operator(log, hot_rows=5)) == rows_of(operator(log))


def test_copies_get_distinct_ranks(raw):
    plain, sliced = ranked_history(raw), ranked_history(raw, hot_rows=20)
    assert rows_of(plain) == rows_of(sliced)
    assert plain.select("user_id", "interaction_rank").distinct().count() == raw.count()


def test_feature_table_does_not_depend_on_what_is_hot(spark, sf_dir):
    from clickgrain.catalog.base import parked_clean

    cleaned = parked_clean(spark, sf_dir)
    columns = feature_table(cleaned).dtypes
    rounded = [F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in columns]
    plain, spread = feature_table(cleaned), feature_table(cleaned, hot_rows=8)
    assert rows_of(plain.select(*rounded)) == rows_of(spread.select(*rounded))
    entities = plain.select("event_timestamp", "user_id", "product_id", "user_session", "category_id")
    table = park(plain, "features")
    once, twice = point_in_time(entities, table), point_in_time(entities, table, hot_rows=50)
    assert rows_of(once) == rows_of(twice)


def test_index_is_a_bijection_and_keeps_unseen(raw):
    labels = frequency_index(raw.filter("user_id <> '3'"), "user_id")
    indexes = sorted(r["index"] for r in labels.collect())
    assert indexes == [float(i) for i in range(len(indexes))]
    hot = find_hot(raw, {"user": ["user_id"]}, min_rows=20)["user"]
    unseen = with_index(raw, labels, "user_id", hot=hot).filter("user_id = '3'").select("user_id_index").distinct()
    assert [r[0] for r in unseen.collect()] == [float(len(indexes))]
