"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four event types of the log.
VIEW, CART, PURCHASE, REMOVAL = "view", "cart", "purchase", "remove_from_cart"
EVENT_TYPES = (CART, REMOVAL, PURCHASE, VIEW)

# Weights of an interaction, default and the variant that also scores removals.
WEIGHTS = {VIEW: 0.3, CART: 0.5, PURCHASE: 1.0}
WEIGHTS_WITH_REMOVALS = {VIEW: 0.3, CART: 0.7, PURCHASE: 2.0, REMOVAL: -0.3}

DAY_SECONDS = 86400
TWO_DAYS_SECONDS = 2 * DAY_SECONDS


def is_event(kind: str) -> Column:
    return F.col("event_type") == kind


def steady_round(value: Column, digits: int = 2) -> Column:
    """Round half up after removing floating-point noise.

    The result does not depend on the order in which a distributed sum was added up.
    """
    return F.round(F.round(value, 10), digits)


def ratio_or_zero(top: Column, bottom: Column, digits: int = 2) -> Column:
    return steady_round(F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom), digits)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, both ends truncated to the second first."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / DAY_SECONDS


def two_day_bucket(ts: Column) -> Column:
    """Number of the 48-hour stretch since the epoch."""
    return F.floor(F.unix_timestamp(ts) / TWO_DAYS_SECONDS).cast("long")


def weight_of(event_type: Column, weights: dict[str, float] | None = None) -> Column:
    """Weight of an event; null for a type without one."""
    chosen = None
    for kind, weight in (weights or WEIGHTS).items():
        hit = event_type == kind
        chosen = F.when(hit, F.lit(weight)) if chosen is None else chosen.when(hit, F.lit(weight))
    return chosen


def cycle(value: Column, period: int = 24) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)
