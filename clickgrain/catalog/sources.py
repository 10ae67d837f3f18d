"""IO1-IO14: scans and sinks, on files that Spark writes from the log first."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickgrain import sources
from clickgrain.catalog.base import query, rounded, with_log
from clickgrain.session import new_folder
from clickgrain.sources.testlog import event_log

MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
COLUMNS = [f["name"] for f in sources.LOG_FIELDS]
# The declared price is a 32-bit float; it is compared after rounding to cents.
TYPED = "SELECT * REPLACE (CAST(round(CAST(CAST(price AS FLOAT) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS price) FROM log"


def csv_months(spark, sf_dir, label="csv", nested=False):
    """The log as CSV files with header: one folder per ten days, as the monthly files of a shop."""
    folder = new_folder(spark, label)
    log = event_log(spark, sf_dir)
    writer = log.withColumn("part", F.floor((F.dayofmonth("event_time") - 1) / 10)).write.partitionBy("part")
    writer.option("header", "true").option("timestampFormat", MICROSECONDS).csv(folder)
    return folder


def to_cents(log):
    return rounded(log.withColumn("price", F.col("price").cast("double")), 2)


@query(
    "io1_declared_schema",
    with_log(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{f['name']}' AS name, '{f['type']}' AS type, count({f['name']}) AS values FROM log"
            for i, f in enumerate(sources.LOG_FIELDS)
        )
    ),
)
def io1(spark, sf_dir):
    log = sources.read_csv_log(spark, f"{csv_months(spark, sf_dir)}/*", sources.declared_schema())
    described = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(type(f.dataType).__name__).alias("type"),
            F.count(f.name).alias("values"),
        )
        for i, f in enumerate(log.schema.fields)
    ]
    return log.agg(F.array(*described).alias("fields")).select(F.inline("fields"))


@query("io2_csv_scan", with_log(TYPED))
def io2(spark, sf_dir):
    return to_cents(sources.read_csv_log(spark, f"{csv_months(spark, sf_dir)}/*"))


@query("io3_csv_scan_inferred", with_log("SELECT * REPLACE (CAST(round(CAST(price AS DECIMAL(18, 6)), 2) AS DOUBLE) AS price) FROM log"))
def io3(spark, sf_dir):
    log = to_cents(sources.read_csv_inferred(spark, f"{csv_months(spark, sf_dir)}/*"))
    return log.select(*[c if c in ("event_time", "price") else F.col(c).cast("string").alias(c) for c in COLUMNS])


HAND_WRITTEN = T.StructType(
    [
        T.StructField("event_time", T.TimestampType(), False),
        *[T.StructField(c, T.StringType()) for c in COLUMNS[1:6]],
        T.StructField("price", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in COLUMNS[7:]],
    ]
)


@query("io4_csv_scan_hand_written_schema", with_log("SELECT * FROM log"))
def io4(spark, sf_dir):
    return sources.read_csv_log(spark, f"{csv_months(spark, sf_dir)}/*", HAND_WRITTEN)


@query("io5_normalised_parquet", with_log(f"{TYPED} WHERE event_type <> 'remove_from_cart'"))
def io5(spark, sf_dir):
    target = new_folder(spark, "normalised")
    sources.normalise_to_parquet(spark, f"{csv_months(spark, sf_dir)}/*", target, gather=True)
    return to_cents(sources.read_parquet_log(spark, target).drop("event_date"))


@query("io6_parquet_scan", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'purchase'")
def io6(spark, sf_dir):
    events = sources.read_parquet_log(spark, f"{sf_dir}/events.parquet")
    return events.filter("event_type = 'purchase'").select("event_id", "ts", "user_id", "event_type", "value")


@query("io7_parquet_sink", with_log("SELECT * FROM log"))
def io7(spark, sf_dir):
    target = new_folder(spark, "sink")
    sources.write_parquet(event_log(spark, sf_dir), target)
    return sources.read_parquet_log(spark, target)


@query(
    "io10_ingestion_manifest",
    with_log(
        """SELECT 'part=' || CAST((day(event_time) - 1) // 10 AS VARCHAR) AS folder, count(*) AS rows, min(event_time) AS first_event,
max(event_time) AS last_event, 'interactions' AS target FROM log GROUP BY ALL"""
    ),
)
def io10(spark, sf_dir):
    source = f"{csv_months(spark, sf_dir)}/*"
    target = new_folder(spark, "manifest")
    sources.write_manifest(sources.read_csv_log(spark, source), target, "interactions")
    files = spark.read.json(target).withColumn("folder", F.regexp_extract("file", r"(part=\d+)/[^/]*$", 1))
    bounds = [F.min("first_event").cast("timestamp").alias("first_event"), F.max("last_event").cast("timestamp").alias("last_event")]
    return files.groupBy("folder", "target").agg(F.sum("rows").alias("rows"), *bounds)


TENS = "(day(event_time) - 1) // 10"


@query(
    "io10_run_manifest",
    with_log(
        f"""SELECT run, count(DISTINCT {TENS}) AS files, count(*) AS rows, min(event_time) AS first_event, max(event_time) AS last_event, TRUE AS in_time
FROM (SELECT *, 0 AS run FROM log WHERE {TENS} < 2 UNION ALL SELECT *, 1 AS run FROM log WHERE {TENS} >= 2) GROUP BY run"""
    ),
)
def io10_run(spark, sf_dir):
    """Two runs, one file for each ten days of the month: what they loaded, how long they took."""
    folder, manifest = new_folder(spark, "months"), new_folder(spark, "runs")
    tens = F.floor((F.dayofmonth("event_time") - 1) / 10).cast("int")
    log = event_log(spark, sf_dir).withColumn("part", F.least(tens, F.lit(3)))
    log.repartition("part").write.partitionBy("part").option("header", "true").option("timestampFormat", MICROSECONDS).csv(folder)
    for run, part in enumerate(("[01]", "[23]")):
        sources.ingest(spark, f"{folder}/part={part}", new_folder(spark, f"log-{run}"), manifest)
    runs = spark.read.parquet(manifest)
    timed = (F.col("started") <= F.col("ended")) & (F.col("seconds") >= 0) & (F.col("ended") <= F.current_timestamp())
    run = F.when(F.col("source").contains("[01]"), 0).otherwise(1)
    return runs.select(run.alias("run"), "files", "rows", "first_event", "last_event", timed.alias("in_time"))


@query("io11_landing_zone", with_log(TYPED))
def io11(spark, sf_dir):
    return to_cents(sources.read_landing_zone(spark, csv_months(spark, sf_dir, "landing")).select(*COLUMNS))


@query(
    "io13_stable_sample",
    with_log("SELECT * FROM log WHERE CAST('0x' || substr(md5('42|' || user_id || '|' || product_id), 1, 8) AS BIGINT) % 1000 < 1"),
)
def io13(spark, sf_dir):
    return sources.stable_sample(event_log(spark, sf_dir), ["user_id", "product_id"], per_mille=1)


@query("io14_month_union", with_log(TYPED))
def io14(spark, sf_dir):
    folder = csv_months(spark, sf_dir)
    return to_cents(sources.union_in_order(*[sources.read_csv_log(spark, f"{folder}/part={i}") for i in range(3)]))
