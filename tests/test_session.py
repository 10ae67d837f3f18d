"""Parked tables: shuffle files go with the write, tables go when discarded."""

import pytest
from pyspark.sql import functions as F

from clickgrain.session import SHUFFLES_FREED, discard, park, path_exists


def test_park_keeps_the_setting_and_the_rows(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = spark.conf.get(SHUFFLES_FREED)
    parked = park(counted, "counted")
    assert spark.conf.get(SHUFFLES_FREED) == before
    assert sorted(parked.collect()) == sorted(counted.collect())


def test_discard_deletes_parked_tables_only(spark, sf_dir):
    parked = park(spark.range(10), "numbers")
    folder = parked.inputFiles()[0].rpartition("/")[0]
    discard(parked)
    assert not path_exists(spark, folder)
    with pytest.raises(ValueError):
        discard(spark.read.parquet(f"{sf_dir}/region.parquet"))
