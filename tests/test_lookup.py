"""Latest tables: a lookup of one key needs about one row group."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clickgrain.plans import store


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("latest") / "view")
    rows = spark.range(20_000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("user_id"), F.concat(F.lit("p"), F.pmod(F.hash("id"), F.lit(500))).alias("product_id"),
        F.timestamp_seconds(F.col("id")).alias("event_timestamp"), F.col("id").cast("double").alias("interaction_score"),
    )
    # Otherwise Spark makes one file of so few rows.
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        store.write_for_lookup(rows.repartition(7, "interaction_score"), store.USER_PRODUCT_VIEW, at)
    finally:
        spark.conf.set(coalesce, before)
    return at


def bounds(folder, column):
    found = []
    for path in glob.glob(f"{folder}/*.parquet"):
        groups = pq.ParquetFile(path).metadata
        for i in range(groups.num_row_groups):
            own = next(c for c in (groups.row_group(i).column(j) for j in range(groups.num_columns)) if c.path_in_schema == column)
            found.append((own.statistics.min, own.statistics.max, groups.row_group(i).num_rows))
    return found


def test_row_groups_hold_ranges_of_keys(folder):
    groups = bounds(folder, "user_id")
    assert len(groups) > 2 and sum(n for *_, n in groups) == 20_000
    for key in ("000000", "004321", "019999"):
        assert sum(low <= key <= high for low, high, _ in groups) == 1


def test_lookup_pushes_its_keys_and_finds_them(spark, folder):
    tables = {store.USER_PRODUCT_VIEW.name: spark.read.parquet(folder)}
    known = tables[store.USER_PRODUCT_VIEW.name].filter("user_id = '004321'").first()
    asked = [{"user_id": "004321", "product_id": known.product_id}, {"user_id": "004321", "product_id": "none"}, {"user_id": None, "product_id": None}]
    found = store.lookup_rows(spark, asked, tables, [store.USER_PRODUCT_VIEW])
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "004321" in plan.split("PushedFilters", 1)[1]
    assert sorted((r.product_id or "", r.interaction_score) for r in found.collect() if r.interaction_score is not None) == [(known.product_id, 4321.0)]
    assert found.count() == 3
