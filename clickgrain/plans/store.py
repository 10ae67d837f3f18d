"""Feature views: latest values per key and point-in-time retrieval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickgrain.operators.ordered import Running, running
from clickgrain.operators.skew import Hot, find_hot, left_join
from clickgrain.session import park

TIME = "event_timestamp"


@dataclass(frozen=True)
class FeatureView:
    name: str
    keys: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]
    time: str = TIME

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.fields]


# The views, their keys, fields and field types.
PRODUCT_VIEW = FeatureView(
    "product_features",
    ("product_id",),
    (
        ("price", "float"),
        ("is_brand_missing", "int"),
        ("normalised_price", "double"),
        ("total_cart_of_product", "bigint"),
        ("total_purchase_of_product", "bigint"),
        ("total_view_of_product", "bigint"),
        ("popularity_percentile", "double"),
        ("product_cart_to_purchase_conversion_ratio", "double"),
        ("view_to_purchase_conversion_rate_for_item", "double"),
        ("view_to_purchase_ratio", "double"),
    ),
)
CATEGORY_VIEW = FeatureView(
    "category_features",
    ("category_id",),
    (
        ("1_most_purchased_category", "string"),
        ("2_most_purchased_category", "string"),
        ("3_most_purchased_category", "string"),
        ("brand", "string"),
    ),
)
CUSTOMER_VIEW = FeatureView(
    "customer_feature_view",
    ("user_id",),
    (
        ("Recency", "double"),
        ("Frequency", "bigint"),
        ("Monetary", "double"),
        ("Num_purchase_per_2day", "bigint"),
        ("total_cart_by_user", "bigint"),
        ("total_purchase_by_user", "bigint"),
        ("total_view_by_user", "bigint"),
        ("Avg_purchase_price", "float"),
        ("total_unique_product_purchases_by_user", "bigint"),
        ("total_unique_product_add_cart_by_user", "bigint"),
        ("view_to_purchase_time", "double"),
        ("day", "bigint"),
        ("month", "bigint"),
        ("week", "bigint"),
        ("hour_sin", "double"),
        ("hour_cos", "double"),
        ("minutes_sin", "double"),
        ("minutes_cos", "double"),
        ("second_sin", "double"),
        ("second_cos", "double"),
    ),
)
SESSION_VIEW = FeatureView(
    "session_feature_view",
    ("user_session",),
    (
        ("session_duration", "bigint"),
        ("Avg_session_prices", "double"),
        ("num_session_views", "bigint"),
        ("num_session_cart", "bigint"),
        ("num_session_purchase", "bigint"),
        ("session_cart_to_purchase_ratio", "double"),
        ("session_cart_abandonment_rate", "double"),
    ),
)
USER_PRODUCT_VIEW = FeatureView("user_product_interaction", ("user_id", "product_id"), (("interaction_score", "double"),))
VIEWS = (PRODUCT_VIEW, CATEGORY_VIEW, CUSTOMER_VIEW, SESSION_VIEW, USER_PRODUCT_VIEW)

# The same views on indexed ids, as kept next to the transformed training data.
INDEXED_PRODUCT_VIEW = FeatureView("product_features", ("product_id_index",), PRODUCT_VIEW.fields)
INDEXED_CATEGORY_VIEW = FeatureView(
    "category_features",
    ("category_id_index",),
    (
        ("1_most_purchased_category_index", "double"),
        ("2_most_purchased_category_index", "double"),
        ("3_most_purchased_category_index", "double"),
        ("brand_index", "double"),
    ),
)
INDEXED_CUSTOMER_VIEW = FeatureView(
    "customer_feature_view",
    ("user_id_index",),
    (
        ("Num_purchase_per_2day", "bigint"),
        ("total_cart_by_user", "bigint"),
        ("total_purchase_by_user", "bigint"),
        ("total_view_by_user", "bigint"),
        ("Avg_purchase_price", "float"),
        ("total_unique_product_purchases_by_user", "bigint"),
        ("total_unique_product_add_cart_by_user", "bigint"),
        ("view_to_purchase_time", "double"),
        ("RFM_scaled_features", "array<string>"),
        ("RFM_user_cluster", "int"),
        ("day", "bigint"),
        ("month", "bigint"),
        ("week", "bigint"),
        ("hour_sin", "double"),
        ("hour_cos", "double"),
        ("minutes_sin", "double"),
        ("minutes_cos", "double"),
        ("second_sin", "double"),
        ("second_cos", "double"),
    ),
)
INDEXED_SESSION_VIEW = FeatureView("session_feature_view", ("user_session_index",), SESSION_VIEW.fields)
INDEXED_USER_PRODUCT_VIEW = FeatureView("user_product_interaction", ("user_id_index", "product_id_index"), USER_PRODUCT_VIEW.fields)
INDEXED_VIEWS = (INDEXED_PRODUCT_VIEW, INDEXED_CATEGORY_VIEW, INDEXED_CUSTOMER_VIEW, INDEXED_SESSION_VIEW, INDEXED_USER_PRODUCT_VIEW)


def project(view: FeatureView, table: DataFrame) -> DataFrame:
    """Keys, time and fields of a view with their declared types."""
    return table.select(*view.keys, view.time, *[F.col(f"`{n}`").cast(t).alias(n) for n, t in view.fields])


def feature_references(views: Sequence[FeatureView] = VIEWS) -> list[str]:
    return [f"{view.name}:{name}" for view in views for name in view.names]


def reference_coverage(table: DataFrame, views: Sequence[FeatureView] = VIEWS) -> DataFrame:
    """One row per feature reference with the number of rows that hold a value."""
    rows = [
        F.struct(F.lit(f"{v.name}:{n}").alias("feature_ref"), F.count(F.col(f"`{n}`")).alias("values"))
        for v in views
        for n in v.names
    ]
    return table.agg(F.array(*rows).alias("refs")).select(F.inline("refs"))


def _has_keys(view: FeatureView) -> Column:
    present = F.lit(True)
    for key in view.keys:
        present = present & F.col(key).isNotNull()
    return present


def latest(table: DataFrame, view: FeatureView, months: int = 2, end: Column | None = None) -> DataFrame:
    """Newest row per key within the last ``months`` up to ``end`` (default: the newest row at all).

    The last instant of every key comes first, from a plain hash aggregate; only its rows are then
    compared as a whole. Rows of one instant go by the larger field values.
    """
    rows = project(view, table)
    last = end if end is not None else table.agg(F.max(view.time)).scalar()
    first = last - F.make_ym_interval(F.lit(0), F.lit(months))
    recent = rows.filter(_has_keys(view) & (F.col(view.time) >= first) & (F.col(view.time) <= last))
    instants = recent.groupBy(*view.keys).agg(F.max(view.time).alias(view.time))
    newest = F.max(F.struct(view.time, *view.names)).alias("newest")
    return (
        recent.join(instants, [*view.keys, view.time], "left_semi")
        .groupBy(*view.keys)
        .agg(newest)
        .select(*view.keys, "newest.*")
    )


def materialise(table: DataFrame, path: str, views: Sequence[FeatureView] = VIEWS, months: int = 2) -> dict[str, str]:
    """The latest tables of all views as Parquet; returns the folder per view."""
    folders = {view.name: f"{path}/{view.name}" for view in views}
    for view in views:
        write_for_lookup(latest(table, view, months), view, folders[view.name])
    return folders


def write_for_lookup(rows: DataFrame, view: FeatureView, path: str) -> None:
    """Writes one row per key so that a lookup of a few keys reads a few row groups.

    Files hold ranges of the first key and are sorted by the keys, so the bounds in the footers rule out
    all row groups but about one a key; Bloom filters do the same for the other keys of a view.
    """
    ordered = rows.repartitionByRange(*view.keys).sortWithinPartitions(*view.keys).write.mode("overwrite")
    for key in view.keys:
        ordered = ordered.option(f"parquet.bloom.filter.enabled#{key}", "true")
    ordered.parquet(path)


def lookup(
    keys: DataFrame,
    tables: Mapping[str, DataFrame],
    views: Sequence[FeatureView] = VIEWS,
    hot: Mapping[str, Hot] | None = None,
) -> DataFrame:
    """Latest features for each row of ``keys``; null where a key is unknown.

    ``hot`` holds, per view, the keys asked for very often.
    """
    found = keys
    for view in views:
        found = left_join(found, tables[view.name].drop(view.time), view.keys, (hot or {}).get(view.name))
    return found


def lookup_rows(
    spark: SparkSession,
    entity_rows: Sequence[Mapping[str, str]],
    tables: Mapping[str, DataFrame],
    views: Sequence[FeatureView] = VIEWS,
) -> DataFrame:
    """Lookup for key dictionaries held by the caller; their values are pushed into the scans."""
    names = list(dict.fromkeys(key for view in views for key in view.keys))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    keys = spark.createDataFrame([tuple(row.get(n) for n in names) for row in entity_rows], schema)
    wanted = {n: sorted({row[n] for row in entity_rows if row.get(n) is not None}) for n in names}
    narrowed = {}
    for view in views:
        table = tables[view.name]
        for key in view.keys:
            table = table.filter(F.col(key).isin(wanted[key]))
        narrowed[view.name] = table
    return lookup(keys, narrowed, views)  # one row per dictionary of the caller: nothing to spread


def as_of(
    entities: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    time: str = TIME,
    hot: Hot | None = None,
) -> DataFrame:
    """Each entity row with the newest feature row of its keys that is not later than the entity.

    Both sides are stacked and scanned once in time order, features before entities at one instant,
    so no pair of rows is formed but the one that counts. Rows of one instant go by the larger
    field values. Keys with very many rows are scanned in slices.
    """
    keys = list(keys)
    carried = [c for c in entities.columns if c not in (*keys, time)]
    found = F.struct(*[F.col(f"`{f}`") for f in fields])
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    offered = features.filter(known).select(
        *keys, time, F.lit(0).alias("side"), found.alias("offer"), F.lit(None).alias("entity")
    )
    asked = entities.select(
        *keys, time, F.lit(1).alias("side"), F.lit(None).alias("offer"), F.struct(*carried, F.lit(1).alias("row")).alias("entity")
    )
    stacked = offered.unionByName(asked)
    order = [F.col(time), F.col("side"), F.col("offer")]
    scanned = running(stacked, keys, order, [Running("match", "last", "offer")], hot)
    return scanned.filter(F.col("side") == 1).select(
        *keys, time, *[F.col(f"entity.{c}").alias(c) for c in carried], *[F.col(f"match.`{f}`").alias(f) for f in fields]
    )


def point_in_time(
    entities: DataFrame, table: DataFrame, views: Sequence[FeatureView] = VIEWS, hot_rows: int | None = None
) -> DataFrame:
    """An entity frame (time and keys) with the features of all views as they were at that time.

    Pass a written table: it is read once per view. Entities are written and numbered; what goes through
    the scan of a view is their number, its keys and the time. The fields that each view found come back
    to the entities by the number, so they are shuffled once, whatever the number of views.
    """
    columns = entities.columns
    keys = list(dict.fromkeys(key for view in views for key in view.keys))
    both = entities.select(*keys).unionByName(table.select(*keys))
    hot = find_hot(both, {view.name: view.keys for view in views}, min_rows=hot_rows)
    # Numbered in a table that is there already: a task that runs again gives the same numbers.
    numbered = park(park(entities, "entities").withColumn("entity_row", F.monotonically_increasing_id()), "entities")
    found = numbered
    for view in views:
        asked = numbered.select("entity_row", *view.keys, view.time)
        fields = as_of(asked, project(view, table), view.keys, view.names, view.time, hot[view.name])
        found = found.join(fields.drop(*view.keys, view.time), "entity_row")
    return found.select(*columns, *[f"`{n}`" for view in views for n in view.names])
