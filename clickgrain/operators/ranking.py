"""Recommendations and their metrics.

Metrics are joins of (user, item) rows: a user with very many true items is many rows, not one
large array. The array forms in ``functions.ranking`` give the same numbers for short lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickgrain.operators.ordered import global_number


def top_items(scored: DataFrame, user: str, item: str, score: str, count: int) -> DataFrame:
    """Per user the ``count`` items with the highest score, ties by item, as (user, item, place)."""
    best = scored.groupBy(user, item).agg(F.max(score).alias(score))
    place = F.row_number().over(W.partitionBy(user).orderBy(F.desc(score), item))
    return best.withColumn("place", place).filter(F.col("place") <= count).select(user, item, score, "place")


def as_lists(places: DataFrame, user: str, item: str, out: str = "pred_items") -> DataFrame:
    """(user, item, place) to one array per user in order of place; as long as the largest place."""
    collected = F.array_sort(F.collect_list(F.struct("place", item)))
    return places.groupBy(user).agg(F.transform(collected, lambda e: e[item]).alias(out))


def as_places(recommendations: DataFrame, user: str, item: str) -> DataFrame:
    """Nested recommendations (array of item and rating) to (user, item, place)."""
    return recommendations.select(user, F.posexplode("recommendations").alias("at", "rec")).select(
        user, F.col(f"rec.{item}").alias(item), (F.col("at") + 1).alias("place")
    )


def recommended_ids(recommendations: DataFrame, user: str, item: str) -> DataFrame:
    return recommendations.select(user, F.transform("recommendations", lambda e: e[item]).alias("pred_items"))


def truth(test: DataFrame, user: str, item: str) -> DataFrame:
    """(user, item, times): the true items, repeats as a number."""
    return test.filter(F.col(item).isNotNull()).groupBy(user, item).agg(F.count(F.lit(1)).alias("times"))


def truth_sets(truth_rows: DataFrame, user: str, item: str) -> DataFrame:
    """True items of a user without repeats as a sorted array, at most one entry per catalogue item."""
    return truth_rows.groupBy(user).agg(F.array_sort(F.collect_set(item)).alias("true_items"))


def list_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int = 1024) -> DataFrame:
    """(keys, chunk, items): the values of each key in order, repeats kept, ``size`` of them a chunk.

    A list as one array would grow with its key. Rows are numbered first (in slices, so no task holds all
    rows of a key), and the number tells chunk and place; an array holds ``size`` values at most. The
    chunks of a key one after the other are its list. Null values are left out, as in ``collect_list``.
    """
    kept = rows.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order, value]))
    placed = global_number(kept, [F.col(c) for c in [*keys, *order, value]], "row_place")
    # A key's first number: the global number runs through the keys in their order.
    first = placed.groupBy(*keys).agg(F.min("row_place").alias("first_place"))
    joined = null_safe_join(placed, first, keys)
    place = F.col("row_place") - F.col("first_place")
    chunked = joined.withColumn("chunk", F.floor(place / size).cast("int"))
    collected = F.array_sort(F.collect_list(F.struct("row_place", F.col(value).alias("item"))))
    return chunked.groupBy(*keys, "chunk").agg(F.transform(collected, lambda e: e["item"]).alias("items"))


def null_safe_join(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins one row per key to ``rows``; a null key meets a null key."""
    renamed = side.withColumnsRenamed({k: f"side_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"side_{k}")) for k in keys]
    return rows.join(renamed, same).drop(*[f"side_{k}" for k in keys])


def truth_lists(truth_rows: DataFrame, user: str, item: str, at_most: int) -> DataFrame:
    """True items with repeats as a sorted array, for users with at most ``at_most`` of them."""
    sizes = truth_rows.groupBy(user).agg(F.sum("times").alias("true_count")).filter(F.col("true_count") <= at_most)
    listed = truth_rows.join(sizes, user).groupBy(user).agg(F.collect_list(F.struct(item, "times")).alias("found"))
    repeated = F.flatten(F.transform("found", lambda e: F.array_repeat(e[item], e["times"].cast("int"))))
    return listed.select(user, F.array_sort(repeated).alias("true_items"))


def ideal_gain(relevant: Column, k: int) -> Column:
    """Gain of a perfect list with ``relevant`` hits, at most ``k``."""
    best = F.least(relevant, F.lit(k)).cast("int")
    gains = F.transform(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0))
    return F.when(best > 0, F.aggregate(gains, F.lit(0.0), lambda total, g: total + g)).otherwise(0.0)


def user_metrics(
    truth_rows: DataFrame, places: DataFrame, user: str, item: str, k: int, repeats: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Per user with both true and recommended items: hits, recall@k, precision@k and NDCG@k.

    ``by`` names columns of ``places`` (the model a list is from, say) to keep apart.

    ``repeats`` counts a true item as often as it occurs in the divisor of recall and in the ideal
    of NDCG (a list of true items); without it true items are a set.
    """
    true_count = F.sum("times") if repeats else F.count(F.lit(1))
    users = truth_rows.groupBy(user).agg(true_count.alias("true_count"))
    in_reach = places.filter(F.col("place") <= k)
    served = places.select(*by, user).distinct()
    hits = (
        truth_rows.join(in_reach, [user, item])
        .groupBy(*by, user)
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.sum(1.0 / F.log2(F.col("place") + 1.0)).alias("gain"),
        )
    )
    joined = users.join(served, user).join(hits, [*by, user], "left").na.fill({"hits": 0, "gain": 0.0})
    return joined.select(
        *by,
        user,
        "true_count",
        "hits",
        (F.col("hits") / F.col("true_count")).alias("recall"),
        (F.col("hits") / F.lit(k)).alias("precision"),
        F.try_divide("gain", ideal_gain(F.col("true_count"), k)).alias("ndcg"),
    )


def user_recall(truth_rows: DataFrame, lists: DataFrame, user: str, item: str) -> DataFrame:
    """(user, recall) of users with a true item and a list; ``lists`` has (user, pred_items), once per user.

    The recall of ``user_metrics`` without repeats, for lists short enough to be arrays: only the true
    rows meet them, one join by user. ``truth_rows`` has a (user, item) once; a null item is no hit.
    """
    hit = F.when(F.array_contains("pred_items", F.col(item)), 1.0).otherwise(0.0)
    return truth_rows.join(lists, user).groupBy(user).agg(F.avg(hit).alias("recall"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.avg("recall").alias("avg_recall_at_k"),
        F.avg("precision").alias("avg_precision_at_k"),
        F.avg("ndcg").alias("avg_ndcg_at_k"),
        F.count(F.lit(1)).alias("users"),
    )


def equal_lists(truth_rows: DataFrame, places: DataFrame, user: str, item: str) -> DataFrame:
    """Rows (user, list) that the true and the recommended lists share, order included.

    A true list longer than the longest recommended one equals none, so it is never built.
    """
    longest = places.agg(F.max("place")).first()[0] or 0
    true_lists = truth_lists(truth_rows, user, item, longest)
    return true_lists.intersect(as_lists(places, user, item, "true_items"))
