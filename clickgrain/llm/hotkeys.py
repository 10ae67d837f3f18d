"""Joining rows with a table of one row per key, where one key may have a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.operators.skew import left_join

#: No more keys than this are dealt over several tasks; a part of a key has at most 1/SLOTS of the rows.
SLOTS = 2048
SMALLEST = 256


def attach(rows: DataFrame, side: DataFrame, keys: Sequence[str], count: str, null_safe: bool = False) -> DataFrame:
    """``rows`` left-joined with ``side``, a written table whose column ``count`` has the rows of each key.

    Keys with more than 1/SLOTS of the counted rows are dealt over tasks by a hash of the row, their
    one row of ``side`` copied to each: a rule that is the same for every size of table.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    limit = max(SMALLEST, -(-total // SLOTS))
    hot = side.filter(F.col(count) > limit).select(F.xxhash64(*keys), F.ceil(F.col(count) / limit))
    return left_join(rows, side.drop(count), keys, {r[0]: r[1] for r in hot.collect()}, null_safe)
