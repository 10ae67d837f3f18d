"""Shards of near equal bytes by k-d tree partitioning over document metadata.

All rows start in one node. A node that is to become several shards is cut across its widest
metadata dimension at a weighted median (or the weighted quantile that fits an odd number of
shards), found by histograms in a few rounds (``thresholds.cut_points``), for all nodes of a level
at once. Nothing is sorted or collected; the driver sees one row per node and level.

Dimensions are language, source and size, each spread over 20 bits (names by their CRC, sizes by
their logarithm). The other 40 bits of a key are a hash of the text, so a cut inside one value is
still exact, and equal texts stay in one shard. Only a group of equal texts that is heavier than a
shard, which no shard can hold whole, is dealt over parts of ``1/SPLIT`` of a shard by doc_id. Sizes
are equal up to the heaviest group near a cut.

Nulls: a null text has no bytes (size 1), a null language or source is a value of its own. Rows
repeated exactly are kept. Without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickgrain.llm.thresholds import cut_points
from clickgrain.session import park

SPLIT = 32
DIMENSIONS = ("lang", "source", "size")
VALUE_BITS, HASH_BITS = 20, 40


def _named(column: str) -> Column:
    return F.coalesce(F.shiftright(F.crc32(column), 32 - VALUE_BITS), F.lit(0))


def shard_table(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source) with size, text_crc32, shard and slot.

    Give the number of shards or the bytes of one. Slots number the rows of a shard from 0.
    """
    base = park(
        docs.select(
            "doc_id",
            "lang",
            "source",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("h1"),
            F.xxhash64(F.lit("second"), "text").alias("h2"),
            F.spark_partition_id().alias("chunk"),
        ),
        "sizes",
    )
    total = base.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // (target_bytes or 1 << 30)))
    whole = max(1, -(-total // shards))
    groups = base.groupBy("h1", "h2").agg(F.sum("size").alias("weight"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source"))
    joined = base.join(groups, ["h1", "h2"])
    parts = F.ceil(F.col("weight") * SPLIT / F.lit(whole))
    part = F.when(F.col("weight") > whole, F.pmod(F.xxhash64("doc_id"), parts)).otherwise(0)
    unit = F.shiftrightunsigned(F.xxhash64("h1", "h2", part), 64 - HASH_BITS)
    values = {
        "lang": _named("g_lang"),
        "source": _named("g_source"),
        "size": F.floor(F.log2(F.col("size")) * F.lit((1 << VALUE_BITS) / 64)),
    }
    keys = {f"k_{d}": (F.shiftleft(v.cast("long"), HASH_BITS) + unit).cast("long") for d, v in values.items()}
    rows = park(
        joined.select("doc_id", "size", "text_crc32", "chunk", "h1", *[v.alias(k) for k, v in keys.items()], F.lit(0).alias("first"), F.lit(shards).alias("leaves")),
        "points",
    )
    for _ in range((shards - 1).bit_length()):  # Every cut leaves half of the leaves, rounded up, at most.
        rows = park(_cut_level(rows, rows.filter(F.col("leaves") > 1)), "level")
    return number_slots(rows.withColumn("shard", F.col("first").cast("int")))


def _cut_level(rows: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Cuts every node that has more than one leaf to come."""
    span = [F.max(f"k_{d}").alias(f"high_{d}") for d in DIMENSIONS] + [F.min(f"k_{d}").alias(f"low_{d}") for d in DIMENSIONS]
    nodes = open_rows.groupBy("first", "leaves").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), *span)
    widths = [F.col(f"high_{d}") - F.col(f"low_{d}") for d in DIMENSIONS]
    widest = F.array_position(F.array(*widths), F.greatest(*widths)).cast("int")
    left = F.floor(F.col("leaves") / 2)
    budget = (F.col("weight") * left / F.col("leaves")).alias("budget")
    low, high, key = (F.element_at(F.array(*[F.col(f"{c}_{d}") for d in DIMENSIONS]), F.col("dimension")) for c in ("low", "high", "k"))
    nodes = nodes.withColumn("dimension", widest)
    nodes = park(
        nodes.select(F.col("first").alias("grp"), "dimension", budget, left.cast("int").alias("left"), low.alias("low"), high.alias("high"), "n"),
        "nodes",
    )
    placed = open_rows.join(nodes.select(F.col("grp"), "dimension"), F.col("first") == F.col("grp"))
    cuts = cut_points(placed.select("grp", key.alias("key"), F.col("size").alias("weight")), nodes.select("grp", "budget", "low", "high", "n"))
    tree = nodes.join(cuts.select("grp", "cut"), "grp")
    joined = rows.join(tree, F.col("first") == F.col("grp"), "left")
    below, open_node = key < F.col("cut"), F.col("cut").isNotNull()
    first = F.when(open_node & ~below, F.col("first") + F.col("left")).otherwise(F.col("first"))
    leaves = F.when(open_node, F.when(below, F.col("left")).otherwise(F.col("leaves") - F.col("left"))).otherwise(1)
    return joined.withColumns({"first": first.cast("int"), "leaves": leaves.cast("int")}).select(*rows.columns)


def number_slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of every shard from 0 without bringing a shard to one task.

    ``chunk`` is the task that read the row, kept in the written table: rows are numbered in their
    chunk, and the counts of earlier chunks are added.
    """
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("chunk").alias("o_chunk"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "h1"))
    numbered = rows.withColumn("place", inside).join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("chunk") == F.col("o_chunk")))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - 1 + F.col("offset")).cast("long").alias("slot"))
