"""Bounded labelled samples for fitting, the folds of the queries, and rows put aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as empty text, fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def share_of_values(rows: DataFrame, value: str, keys: tuple[str, ...], per_value: int) -> DataFrame:
    """About ``per_value`` rows of every ``value`` (all, where there are fewer), chosen by a hash of ``keys``.

    Values are classes or languages: their counts, one short row each, are sent to every task, so no
    text but the sample's leaves the scan. ``n_value`` is the number of rows the value has. Rows with
    equal keys are drawn together: callers take one of them before they bring a sample to the driver.
    """
    counts = rows.groupBy(F.col(value).alias("counted")).agg(F.count(F.lit(1)).alias("n_value"))
    drawn = F.pmod(F.xxhash64(F.lit("draw"), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(counts), F.col(value) == F.col("counted")).filter(drawn * F.col("n_value") < per_value).drop("counted")


def aside(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row of ``docs`` as one column ``kept_row``, with ``columns`` beside it that no name of ``docs`` can clash with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row"), *[c.alias(n) for n, c in columns.items()])
