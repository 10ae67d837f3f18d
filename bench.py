"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from clickgrain.catalog import QUERIES
from clickgrain.session import build_session, release

HEADLINES = [
    "cl7_clean",
    "dq7_suite",
    "io5_normalised_parquet",
    "ft2_recency",
    "ft7_unique_products",
    "ft10_top_categories",
    "ft12_session_duration",
    "ft18_popularity_percentile",
    "ft24_interaction_score",
    "ft4_monetary_of_orders",
    "ft29_feature_table",
    "sa2_views_before_purchase",
    "sa8_average_session_length",
    "sp1_two_way_split",
    "se5_split_coverage",
    "jn8_as_of_join",
    "fv3_latest_customer",
    "fv4_point_in_time",
    "ml1_indexed_rows",
    "rc8_mean_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's readers and writers once, so that the first query is not charged for them.
    QUERIES["cl7_clean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
