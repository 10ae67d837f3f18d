"""DQ1-DQ8: checks over the log as it comes in, signups and copies included."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickgrain.catalog.base import query, r, with_log
from clickgrain.functions import EVENT_TYPES
from clickgrain.operators import quality
from clickgrain.session import new_folder, park
from clickgrain.sources import write_result_json
from clickgrain.sources.testlog import event_log

RESULT = ["position", "kind", "columns", "rows", "unexpected", "success", "unexpected_percent"]
ALLOWED = ", ".join(f"'{t}'" for t in EVENT_TYPES)
COLUMN_LIST = ", ".join(quality.ALL_COLUMNS)
TYPE_NAMES = {"price": "DoubleType", "event_time": "TimestampType"}


def incoming(spark, sf_dir):
    return event_log(spark, sf_dir)


def suite_sql(index: int | None = None) -> str:
    """One SELECT per check; the order of columns in the log is that of ``log``."""
    order = ["event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session"]
    selects = []
    for place, check in enumerate(quality.standard_suite(index)):
        column = check.columns[0]
        if check.kind == "exists":
            rows, bad = "0", str(int(index is not None and order.index(column) != index))
        elif check.kind == "type":
            rows, bad = "0", str(int(TYPE_NAMES.get(column, "StringType") not in check.values))
        elif check.kind == "not_null":
            rows, bad = "count(*)", f"count(*) FILTER ({column} IS NULL)"
        elif check.kind == "in_set":
            rows, bad = f"count({column})", f"count(*) FILTER ({column} NOT IN ({ALLOWED}))"
        else:
            rows = "count(*)"
            bad = f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM log GROUP BY {COLUMN_LIST}) WHERE n > 1)"
        selects.append(
            f"SELECT {place} AS position, '{check.kind}' AS kind, '{check.subject}' AS columns,"
            f" CAST({rows} AS BIGINT) AS rows, CAST({bad} AS BIGINT) AS unexpected FROM log"
            + (" LIMIT 1" if rows == "0" else "")
        )
    return "suite AS (" + " UNION ALL ".join(f"({s})" for s in selects) + ")"


RESULT_SQL = f"""SELECT *, unexpected = 0 AS success,
CASE WHEN rows = 0 THEN 0.0::DOUBLE ELSE {r('unexpected * 100.0::DOUBLE / nullif(rows, 0)')} END AS unexpected_percent FROM suite"""


def kind_query(key: str, kind: str, condition: str | None = None, index: int | None = None):
    where = f" WHERE kind = '{kind}'" + (f" AND {condition}" if condition else "")

    @query(key, with_log(RESULT_SQL + where, suite_sql(index)))
    def run(spark, sf_dir):
        results = quality.run_suite(incoming(spark, sf_dir), quality.standard_suite(index), [kind])
        return results.filter(condition) if condition else results


kind_query("dq1_columns_exist", "exists")
kind_query("dq1_columns_exist_in_first_place", "exists", index=0)
kind_query("dq2_event_type_in_set", "in_set")
kind_query("dq3_rows_unique", "unique")
kind_query("dq4_not_null", "not_null")
kind_query("dq5_column_types", "type", "columns <> 'price'")
kind_query("dq6_price_type_in_list", "type", "columns = 'price'")


@query(
    "dq2_unexpected_values",
    with_log(f"SELECT event_type, count(*) AS count FROM log WHERE event_type NOT IN ({ALLOWED}) GROUP BY event_type"),
)
def dq2_values(spark, sf_dir):
    return quality.unexpected_values(incoming(spark, sf_dir), "event_type", EVENT_TYPES)


@query("dq7_suite", with_log(RESULT_SQL, suite_sql()))
def dq7(spark, sf_dir):
    return quality.run_suite(park(incoming(spark, sf_dir), "incoming"))


@query(
    "dq7_suite_totals",
    with_log(
        f"""SELECT count(*) AS evaluated, count(*) FILTER (unexpected = 0) AS successful, count(*) FILTER (unexpected > 0) AS unsuccessful,
{r('count(*) FILTER (unexpected = 0) * 100.0::DOUBLE / count(*)')} AS success_percent, bool_and(unexpected = 0) AS success FROM suite""",
        suite_sql(),
    ),
)
def dq7_totals(spark, sf_dir):
    return quality.suite_totals(quality.run_suite(park(incoming(spark, sf_dir), "incoming")))


@query("dq8_result_document", with_log(RESULT_SQL, suite_sql()))
def dq8(spark, sf_dir):
    folder = new_folder(spark, "checks")
    results = quality.run_suite(park(incoming(spark, sf_dir), "incoming"))
    write_result_json(results, folder)
    return spark.read.schema(results.schema).json(folder).select(*RESULT)


@query(
    "io9_validation_result",
    with_log("SELECT count(*) AS checks, count(*) FILTER (unexpected = 0) AS successful, sum(unexpected)::BIGINT AS unexpected FROM suite", suite_sql()),
)
def io9(spark, sf_dir):
    """The result sink: one JSON line a check, read back with the types that JSON itself has."""
    folder = new_folder(spark, "results")
    write_result_json(quality.run_suite(park(incoming(spark, sf_dir), "incoming")), folder)
    lines = spark.read.json(folder)
    return lines.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("unexpected") == 0).alias("successful"), F.sum("unexpected").cast("long").alias("unexpected")
    )
