"""Registry of queries and the SQL every oracle starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgrain.functions import steady_round
from clickgrain.operators.cleaning import clean, drop_removals
from clickgrain.session import park
from clickgrain.sources.testlog import event_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG_SQL = """
base AS (
  SELECT e.event_id, e.ts AS event_time,
         CASE e.event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart' ELSE e.event_type END AS event_type,
         json_extract_string(e.props, '$.k') AS product_id, p.p_type AS category_id, CAST(NULL AS VARCHAR) AS category_code,
         CASE WHEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 7 = 0 THEN NULL ELSE p.p_brand END AS brand,
         CASE WHEN e.event_id % 50 = 0 THEN -e.value ELSE e.value END AS price,
         CAST(e.user_id AS VARCHAR) AS user_id,
         CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE CAST(e.user_id AS VARCHAR) || '-' || strftime(e.ts, '%Y%m%d') END AS user_session
  FROM events e JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)),
log AS (SELECT * EXCLUDE (event_id) FROM base UNION ALL SELECT * EXCLUDE (event_id) FROM base WHERE event_id % 100 = 0),
clean_all AS (
  SELECT DISTINCT event_time, event_type, product_id, category_id, coalesce(brand, 'UNKNOWN') AS brand, price,
         user_id, user_session, CAST(coalesce(brand, 'UNKNOWN') = 'UNKNOWN' AS INTEGER) AS is_brand_missing
  FROM log WHERE user_session IS NOT NULL),
clean_all_abs AS (SELECT * REPLACE (abs(price) AS price) FROM clean_all),
clean AS (SELECT * FROM clean_all_abs WHERE event_type <> 'remove_from_cart')"""

SECONDS = "(epoch_us({}) // 1000000)"


def seconds(column: str) -> str:
    return SECONDS.format(column)


def r(expression: str, digits: int = 4) -> str:
    """Rounding as ``steady_round`` does it."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)"


def with_log(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LOG_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def query(key: str, sql: str | None = None):
    """Registers a query, with its oracle where SQL can state it."""

    def add(run):
        if key in QUERIES:
            raise ValueError(f"query {key} is there already")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Double columns rounded, so that the order of a sum does not show."""
    return df.select(
        *[
            steady_round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def clean_log(spark: SparkSession, sf_dir: str, removals: bool = False) -> DataFrame:
    log = event_log(spark, sf_dir)
    return clean(log if removals else drop_removals(log))


def parked_clean(spark: SparkSession, sf_dir: str, removals: bool = False) -> DataFrame:
    return park(clean_log(spark, sf_dir, removals), "clean")
