"""Finding keys that hold too many rows for one task, and joining around them.

``find_hot`` counts key hashes in a thinned copy of the table: what it shuffles is bounded by
``SAMPLE_ROWS`` and what it returns by ``slots``, however large the table is. An empty list (the
usual case) leaves every plan as plain Spark would have it. The list only decides where rows go,
never which rows there are, so thinning cannot change a result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# No more keys than this can hold more than 1/HOT_SLOTS of all rows.
HOT_SLOTS = 65_536
# Rows looked at per key set: some 300 of a key that is just hot, in the largest tables.
SAMPLE_ROWS = 20_000_000

Hot = Mapping[int, int]


class HotKeys(dict[int, int]):
    """A ``Hot`` that knows how many rows its keys have together, as far as the thinned copy tells."""

    rows: float = 0.0


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def find_hot(
    df: DataFrame, keysets: Mapping[str, Sequence[str]], min_rows: int | None = None, slots: int = HOT_SLOTS
) -> dict[str, HotKeys]:
    """Per key set: hash of each hot key and the number of tasks its rows should be spread over.

    A key is hot when it holds more than ``min_rows`` rows. The caller says so: without it no key is
    looked for, whatever the size of the table, and Spark's own skew handling is left to work.

    Pass a written table: its rows are counted from the file footers, and a table no larger than one
    key may be ends the search there. All key sets share one narrow scan. At most ``slots`` keys can
    hold more than 1/slots of the rows, so the lists have a fixed bound.
    """
    found = {name: HotKeys() for name in keysets}
    if min_rows is None:
        return found
    rows = df.count()
    limit = max(min_rows, rows / slots)
    if rows <= limit:
        return found
    share = min(1.0, SAMPLE_ROWS / rows)
    names = list(keysets)
    columns = list(dict.fromkeys(k for keys in keysets.values() for k in keys))
    thinned = df.select(*columns) if share == 1.0 else df.select(*columns).sample(share, seed=1)
    hashes = [F.struct(F.lit(i).alias("place"), key_hash(keysets[n]).alias("hash")) for i, n in enumerate(names)]
    counted = (
        thinned.select(F.inline(F.array(*hashes)))
        .groupBy("place", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit * share)
    )
    for place, hashed, n in counted.collect():
        found[names[place]][hashed] = math.ceil(n / share / limit)
        found[names[place]].rows += n / share
    return found


def hot_table(spark: SparkSession, hot: Hot) -> DataFrame:
    """The bounded list as a table of (hash, parts)."""
    return spark.createDataFrame(list(hot.items()), "hot_hash long, hot_parts int")


def mark_hot(df: DataFrame, keys: Sequence[str], hot: Hot) -> DataFrame:
    """Adds ``hot_parts``: the number of parts for rows of hot keys, null for all others."""
    listed = F.broadcast(hot_table(df.sparkSession, hot))
    return df.withColumn("hot_hash", key_hash(keys)).join(listed, "hot_hash", "left").drop("hot_hash")


def left_join(
    facts: DataFrame, side: DataFrame, keys: Sequence[str], hot: Hot | None = None, null_safe: bool = False
) -> DataFrame:
    """Left equi join of facts with a table that has one row per key.

    Rows of a hot key are dealt out over several tasks by a hash of the whole row (not by a random
    number: a recomputed task must place its rows as before), and the one matching row of ``side``
    is copied to each of them. ``null_safe`` lets a null key meet a null key, as a window would.
    """
    keys = list(keys)
    columns = [*facts.columns, *[c for c in side.columns if c not in keys]]
    if hot:
        side = mark_hot(side, keys, hot)
        side = side.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("hot_parts", F.lit(1)) - 1)))
        side = side.drop("hot_parts")
        whole_row = F.xxhash64(*facts.columns)
        facts = mark_hot(facts, keys, hot)
        dealt = F.when(F.col("hot_parts").isNull(), 0).otherwise(F.pmod(whole_row, F.col("hot_parts")))
        facts = facts.withColumn("deal", dealt.cast("int")).drop("hot_parts")
    on = [*keys, "deal"] if hot else keys
    if not null_safe:
        joined = facts.join(side, on, "left")
    else:
        renamed = side.withColumnsRenamed({k: f"side_{k}" for k in on})
        same = [F.col(k).eqNullSafe(F.col(f"side_{k}")) for k in on]
        joined = facts.join(renamed, same, "left").drop(*[f"side_{k}" for k in on])
    return joined.select(*columns)
