"""FV1-FV6, JN8, JN9: feature views, latest values, point-in-time retrieval."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clickgrain.catalog.base import parked_clean, query, with_log
from clickgrain.catalog.features import feature_ctes, shown
from clickgrain.catalog.visits import split_sql
from clickgrain.functions import PURCHASE, VIEW, is_event
from clickgrain.operators.skew import find_hot
from clickgrain.operators.splits import split_history
from clickgrain.plans import mlprep, store
from clickgrain.plans.features import feature_table_of_log
from clickgrain.session import new_folder, park
from clickgrain.sources.testlog import event_log

ENTITY = ["event_timestamp", "user_id", "product_id", "user_session", "category_id"]
UNKNOWN = {"user_id": "nobody", "product_id": "nothing", "user_session": "never", "category_id": "none"}


def features_of(spark, sf_dir):
    return feature_table_of_log(event_log(spark, sf_dir))


def parked_features(spark, sf_dir):
    return park(features_of(spark, sf_dir), "features")


def field_sql(name: str, kind: str, prefix: str = "") -> str:
    cast = {"float": "FLOAT", "int": "INTEGER", "bigint": "BIGINT"}.get(kind)
    column = f'{prefix}"{name}"'
    return f'CAST({column} AS {cast}) AS "{name}"' if cast else f'{column} AS "{name}"'


def fields_sql(view: store.FeatureView, prefix: str = "") -> str:
    return ", ".join(field_sql(n, k, prefix) for n, k in view.fields)


def short(view: store.FeatureView) -> str:
    return view.name.replace("_features", "").replace("_feature_view", "").replace("_interaction", "")


LATEST = """
newest_{short} AS (SELECT {keys}, event_timestamp, {fields} FROM features
  WHERE event_timestamp >= (SELECT max(event_timestamp) - INTERVAL 2 MONTH FROM features)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY event_timestamp DESC) = 1)"""


def latest_cte(view: store.FeatureView) -> str:
    return LATEST.format(short=short(view), keys=", ".join(view.keys), fields=fields_sql(view))


def view_queries(view: store.FeatureView):
    keys = ", ".join(view.keys)

    @query(
        f"fv1_view_{short(view)}",
        with_log(f"SELECT {keys}, event_timestamp, {fields_sql(view)} FROM features", *feature_ctes()),
    )
    def projected(spark, sf_dir):
        return shown(store.project(view, features_of(spark, sf_dir)))

    @query(
        f"fv3_latest_{short(view)}",
        with_log(f"SELECT * FROM newest_{short(view)}", *feature_ctes(), latest_cte(view)),
    )
    def newest(spark, sf_dir):
        return shown(store.latest(parked_features(spark, sf_dir), view))


for each in store.VIEWS:
    view_queries(each)


REFERENCES = " UNION ALL ".join(
    f"SELECT '{v.name}:{n}' AS feature_ref, count(\"{n}\") AS values FROM features" for v in store.VIEWS for n in v.names
)


@query("fv2_feature_references", with_log(REFERENCES, *feature_ctes()))
def fv2(spark, sf_dir):
    return store.reference_coverage(features_of(spark, sf_dir))


def point_in_time_sql(hours: int) -> tuple[str, str]:
    entity = f"entity AS (SELECT event_timestamp + INTERVAL {hours} HOUR AS event_timestamp, user_id, product_id, user_session, category_id FROM features)"
    joins, fields = [], []
    for view in store.VIEWS:
        name = short(view)
        same = " AND ".join(f"e.{k} = {name}.{k}" for k in view.keys)
        joins.append(f"ASOF LEFT JOIN features {name} ON {same} AND e.event_timestamp >= {name}.event_timestamp")
        fields.append(fields_sql(view, f"{name}."))
    body = f"SELECT {', '.join('e.' + c for c in ENTITY)}, {', '.join(fields)} FROM entity e {' '.join(joins)}"
    return body, entity


def point_in_time_query(key: str, hours: int):
    body, entity = point_in_time_sql(hours)

    @query(key, with_log(body, *feature_ctes(), entity))
    def run(spark, sf_dir):
        table = parked_features(spark, sf_dir)
        later = F.col("event_timestamp") + F.make_dt_interval(F.lit(0), F.lit(hours))
        return shown(store.point_in_time(table.select(*ENTITY).withColumn("event_timestamp", later), table))


point_in_time_query("fv4_point_in_time", 0)
point_in_time_query("fv4_point_in_time_36_hours_later", 36)


LOOKUP = "wanted AS (SELECT user_id, product_id, user_session, category_id FROM features QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1 UNION ALL SELECT 'nobody', 'nothing', 'never', 'none')"
LOOKUP_SQL = "SELECT w.*, {} FROM wanted w {}".format(
    ", ".join(f'{short(v)}."{n}"' for v in store.VIEWS for n in v.names),
    " ".join(f"LEFT JOIN newest_{short(v)} {short(v)} USING ({', '.join(v.keys)})" for v in store.VIEWS),
)


@query("fv5_online_lookup", with_log(LOOKUP_SQL, *feature_ctes(), *[latest_cte(v) for v in store.VIEWS], LOOKUP))
def fv5(spark, sf_dir):
    table = parked_features(spark, sf_dir)
    folders = store.materialise(table, new_folder(spark, "online"))
    tables = {name: spark.read.parquet(path) for name, path in folders.items()}
    keys = [c for c in ENTITY if c != "event_timestamp"]
    last = table.groupBy("user_id").agg(F.max_by(F.struct(*keys[1:]), "event_timestamp").alias("last"))
    unknown = last.agg(*[F.lit(UNKNOWN[k]).alias(k) for k in keys])
    asked = park(last.select("user_id", "last.*").unionByName(unknown), "asked")
    hot = find_hot(asked, {view.name: view.keys for view in store.VIEWS})
    return shown(store.lookup(asked, tables, hot=hot))


FITTED = ("RFM_scaled_features", "RFM_user_cluster")


def indexed_rows(spark, sf_dir):
    """The train part of the feature table with all indexes, scaled values and clusters, written once."""
    table = parked_features(spark, sf_dir)
    train = park(split_history(table, time="event_timestamp").filter("split = 'train'"), "train")
    fitted = mlprep.FeatureTransform.fit(train)
    rows = fitted.transform(train)
    others = [c for c in mlprep.HASHED_COLUMNS if c not in fitted.labels]
    hot = find_hot(train, {c: [c] for c in others})
    for column in others:
        labels = park(mlprep.frequency_index(train, column), "labels")
        rows = mlprep.with_index(rows, labels, column, hot=hot[column])
    return park(rows.withColumn("RFM_scaled_features", vector_to_array("RFM_scaled_features").cast("array<string>")), "indexed")


@query("fv6_indexed_views")
def fv6(spark, sf_dir):
    """The newest row per key of every view on indexed ids; columns of other views are null."""
    rows = indexed_rows(spark, sf_dir)
    found = None
    for view in store.INDEXED_VIEWS:
        newest = shown(store.latest(rows, view)).select(F.lit(view.name).alias("view"), "*")
        found = newest if found is None else found.unionByName(newest, allowMissingColumns=True)
    return found


def indexed_ctes() -> list[str]:
    """``indexed``: the train part with the index of every hashed column."""
    columns = mlprep.HASHED_COLUMNS
    numbered = [
        f"""idx_{c} AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS index
FROM (SELECT "{c}" AS label, count(*) AS n FROM train WHERE "{c}" IS NOT NULL GROUP BY "{c}"))"""
        for c in columns
    ]
    indexes = ", ".join(f'coalesce(idx_{c}.index, (SELECT count(*) FROM idx_{c})::DOUBLE) AS "{c}_index"' for c in columns)
    joins = " ".join(f'LEFT JOIN idx_{c} ON t."{c}" = idx_{c}.label' for c in columns)
    return [
        split_sql("features", [("train", 0.8)], 10, "* EXCLUDE (total, rank)", "event_timestamp"),
        "train AS (SELECT * FROM parts WHERE split = 'train')",
        *numbered,
        f"indexed AS (SELECT t.*, {indexes} FROM train t {joins})",
    ]


def indexed_query(view: store.FeatureView):
    """The latest rows of one view on indexed ids, without what is fitted at random."""
    fields = [(n, t) for n, t in view.fields if n not in FITTED]
    keys, larger = ", ".join(view.keys), ", ".join(f'"{n}" DESC NULLS LAST' for n, _ in fields)
    newest = f"""SELECT {keys}, event_timestamp, {", ".join(field_sql(n, t) for n, t in fields)} FROM indexed
WHERE event_timestamp >= (SELECT max(event_timestamp) - INTERVAL 2 MONTH FROM indexed)
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY event_timestamp DESC, {larger}) = 1"""

    @query(f"fv6_indexed_{short(view)}", with_log(newest, *feature_ctes(), *indexed_ctes()))
    def run(spark, sf_dir):
        return shown(store.latest(indexed_rows(spark, sf_dir), view).drop(*FITTED))


for each in store.INDEXED_VIEWS:
    indexed_query(each)


@query(
    "jn8_as_of_join",
    with_log(
        """SELECT p.user_id, p.event_time, p.product_id, v.product_id AS viewed_product, v.price AS viewed_price
FROM (SELECT * FROM clean WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM clean WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.event_time >= v.event_time"""
    ),
)
def jn8(spark, sf_dir):
    rows = parked_clean(spark, sf_dir)
    bought = rows.filter(is_event(PURCHASE)).select("user_id", "event_time", "product_id")
    seen = rows.filter(is_event(VIEW)).select(
        "user_id", "event_time", F.col("product_id").alias("viewed_product"), F.col("price").alias("viewed_price")
    )
    hot = find_hot(rows, {"user": ["user_id"]})["user"]
    return store.as_of(bought, seen, ["user_id"], ["viewed_product", "viewed_price"], "event_time", hot)


@query(
    "jn9_key_lookup",
    with_log(
        f"""SELECT w.user_id, {", ".join(f'customer."{n}"' for n in store.CUSTOMER_VIEW.names)}
FROM (SELECT DISTINCT user_id FROM log UNION ALL SELECT 'nobody') w LEFT JOIN newest_customer customer USING (user_id)""",
        *feature_ctes(),
        latest_cte(store.CUSTOMER_VIEW),
    ),
)
def jn9(spark, sf_dir):
    view = store.CUSTOMER_VIEW
    newest = park(store.latest(parked_features(spark, sf_dir), view), "latest")
    asked = event_log(spark, sf_dir).select("user_id").distinct()
    asked = asked.unionByName(asked.agg(F.lit("nobody").alias("user_id")))
    return shown(store.lookup(asked, {view.name: newest}, [view]))
