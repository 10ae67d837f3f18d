"""Ranking metrics of two array columns, without Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hits(true_items: Column, predicted: Column, k: int) -> Column:
    return F.size(F.array_intersect(true_items, F.slice(predicted, 1, k)))


def recall_at_k(true_items: Column, predicted: Column, k: int) -> Column:
    """Over the length of ``true_items`` as given; pass distinct items for the set form."""
    return F.when(F.size(true_items) > 0, _hits(true_items, predicted, k) / F.size(true_items)).otherwise(0.0)


def precision_at_k(true_items: Column, predicted: Column, k: int) -> Column:
    return _hits(true_items, predicted, k) / F.lit(k)


def ndcg_at_k(true_items: Column, predicted: Column, k: int) -> Column:
    def total(gains: Column) -> Column:
        return F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)

    def discount(i: Column) -> Column:
        return 1.0 / F.log2(i + 2.0)

    gain = total(
        F.transform(
            F.slice(predicted, 1, k), lambda x, i: F.when(F.array_contains(true_items, x), discount(i)).otherwise(0.0)
        )
    )
    best = F.least(F.size(true_items), F.lit(k))
    ideal = total(F.transform(F.slice(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1), best), discount))
    return F.when(best > 0, gain / ideal).otherwise(0.0)
