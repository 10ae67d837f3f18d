"""Mixing sources to target weights by hash thresholds.

Every source gets a target number of words. Whole passes over a source are taken as often as they
fit into its target; of the last, partial pass those documents are taken whose hash lies below a
threshold, found by histograms of words over hash buckets (``thresholds.cut_points``). No sort, and
no rows but sums are shuffled to find the thresholds. The hash covers doc_id and text, so reruns
agree and a larger target takes all that a smaller one takes.

Nulls: a null text has no words; a null source is a source of its own, last in order. Rows repeated
exactly share one hash and are taken together. Without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.samples import aside
from clickgrain.llm.thresholds import cut_points, hash_key
from clickgrain.operators.ordered import global_number
from clickgrain.session import park

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``sid`` and ``target``.

    Sources in order of code points take the weights in turn. Targets share ``share`` of all sizes by
    weight; none is above ``most`` times its source's size, and what is above is shared again by
    weight among the others until none is above.
    """
    sources = park(global_number(sizes, [F.col("source").asc_nulls_last()], "number"), "sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    sources = sources.select("source", "source_size", F.col("number").alias("sid"), turn.alias("weight"), (F.col("source_size") * F.lit(most)).alias("limit"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = float("-inf")
    while True:
        full = F.col("limit") <= F.col("weight") * F.lit(level)
        held, open_weight = sources.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (share * total - (held or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    return sources.select("source", "source_size", "sid", F.least(F.col("weight") * F.lit(level), F.col("limit")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): size, source_size, target, taken, times."""
    base = park(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            hash_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).alias("key"),
        ),
        "sizes",
    )
    targets = park(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    passes = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    targets = targets.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    known = targets.select(F.col("source").alias("named"), "sid", "source_size", "target", "passes")
    rows = base.join(known, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    cuts = cut_points(
        rows.select(F.col("sid").alias("grp"), "key", F.col("size").alias("weight")),
        targets.filter(F.col("budget") > 0).select(F.col("sid").alias("grp"), "budget"),
    )
    times = F.col("passes") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0)
    return (
        rows.join(cuts.select(F.col("grp").alias("sid"), "cut"), "sid", "left")
        .withColumn("times", times.cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "key")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    own_key = hash_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    named = aside(docs, source=F.col("source"), key=own_key)
    taken = mix_sources(docs, **options).filter(F.col("times") > 0).groupBy("source", "key").agg(F.max("times").alias("times"))
    taken = taken.select(F.col("source").alias("of_source"), F.col("key").alias("of_key"), "times")
    joined = named.join(taken, (F.col("key") == F.col("of_key")) & F.col("source").eqNullSafe(F.col("of_source")))
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("kept_row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS raised
  FROM sources
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lifted AS (SELECT arg_min(raised, most / weight) FILTER (most / weight >= raised) AS lift FROM filling),
targets AS (SELECT source, source_size, least(weight * lift, most) AS target FROM filling, lifted),
passes AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS whole FROM targets),
running AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached,
         sum(s.size) OVER (PARTITION BY s.source, s.key) AS own
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN budget > 0 AND (reached <= budget OR (reached - own <= budget AND reached - budget < budget - (reached - own)))
                                 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
