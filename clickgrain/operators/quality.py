"""Declarative checks of a log: one result row per check, all row-level checks in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.functions import EVENT_TYPES, steady_round


@dataclass(frozen=True)
class Check:
    """``kind``: exists, in_set, unique, not_null, type. ``values`` holds the set or the type names."""

    kind: str
    columns: tuple[str, ...]
    values: tuple[str, ...] = ()
    index: int | None = None

    @property
    def subject(self) -> str:
        return ",".join(self.columns)


# The columns each check of the standard suite covers, in its order.
ALL_COLUMNS = (
    "price", "product_id", "user_id", "category_id", "event_time",
    "event_type", "category_code", "brand", "user_session",
)
NEVER_NULL = ("user_id", "event_time", "product_id", "category_id", "event_type", "user_session")
TEXT_COLUMNS = ("user_id", "product_id", "category_id", "user_session", "event_type")


SCHEMA_KINDS = ("exists", "type")


def standard_suite(index: int | None = None) -> list[Check]:
    """The 24 checks. ``index=0`` demands every column in first place, as the original suite does."""
    return [
        *[Check("exists", (c,), index=index) for c in ALL_COLUMNS],
        Check("in_set", ("event_type",), EVENT_TYPES),
        Check("unique", ALL_COLUMNS),
        *[Check("not_null", (c,)) for c in NEVER_NULL],
        *[Check("type", (c,), ("StringType",)) for c in TEXT_COLUMNS],
        Check("type", ("price",), ("DoubleType", "FloatType", "IntegerType")),
        Check("type", ("event_time",), ("TimestampType",)),
    ]


def _type_name(df: DataFrame, column: str) -> str:
    return type(df.schema[column].dataType).__name__


def _schema_failure(df: DataFrame, check: Check) -> int:
    """1 if the schema fails the check, else 0."""
    (column,) = check.columns
    if column not in df.columns:
        return 1
    if check.kind == "type":
        return int(_type_name(df, column) not in check.values)
    return int(check.index is not None and df.columns.index(column) != check.index)


def run_suite(df: DataFrame, checks: Sequence[Check] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """Per check: position, kind, columns, success, rows looked at, unexpected rows and their share.

    ``kinds`` runs only those checks of the suite, in their positions; one that asks for the schema
    alone reads no row. A row check of a column that is not there has failed: its rows and unexpected
    rows are null. Nulls are not looked at by ``in_set``; every member of a group of copies is unexpected to
    ``unique``. A schema check looks at no row and fails or passes as a whole.
    """
    checks = list(standard_suite() if checks is None else checks)
    rows = F.count(F.lit(1))
    results = []
    copies = {}
    chosen = [(place, check) for place, check in enumerate(checks) if kinds is None or check.kind in kinds]
    for place, check in chosen:
        missing = [c for c in check.columns if c not in df.columns]
        if check.kind in SCHEMA_KINDS:
            looked_at, bad = F.lit(0), F.lit(_schema_failure(df, check))
        elif missing:
            looked_at, bad = F.lit(None), F.lit(None)
        elif check.kind == "not_null":
            looked_at, bad = rows, F.count_if(F.col(check.columns[0]).isNull())
        elif check.kind == "in_set":
            column = F.col(check.columns[0])
            looked_at, bad = F.count(column), F.count_if(~column.isin(*check.values))
        elif check.kind == "unique":
            # Equal rows are folded before the shuffle; the one-row total meets the others below.
            groups = df.groupBy(*check.columns).agg(F.count(F.lit(1)).alias("members"))
            copies[place] = groups.agg(
                F.coalesce(F.sum(F.when(F.col("members") > 1, F.col("members"))), F.lit(0)).alias("bad")
            )
            looked_at, bad = rows, F.lit(0)
        else:
            raise ValueError(f"unknown check {check.kind}")
        results.append(
            F.struct(
                F.lit(place).alias("position"),
                F.lit(check.kind).alias("kind"),
                F.lit(check.subject).alias("columns"),
                looked_at.cast("long").alias("rows"),
                bad.cast("long").alias("unexpected"),
            )
        )
    if all(check.kind in SCHEMA_KINDS for _, check in chosen):
        one = df.sparkSession.range(1)
    else:
        one = df
    table = one.agg(F.array(*results).alias("results")).select(F.inline("results"))
    for place, total in copies.items():
        counted = F.when(F.col("position") == place, total.scalar()).otherwise(F.col("unexpected"))
        table = table.withColumn("unexpected", counted)
    share = steady_round(F.coalesce(F.try_divide(F.col("unexpected") * 100.0, F.col("rows")), F.lit(0.0)), 4)
    return table.withColumns({"success": F.coalesce(F.col("unexpected") == 0, F.lit(False)), "unexpected_percent": share})


def suite_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("unsuccessful"),
        steady_round(F.try_divide(F.count_if("success") * 100.0, F.count(F.lit(1))), 4).alias("success_percent"),
        F.bool_and("success").alias("success"),
    )


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the set, with their rows."""
    return (
        df.filter(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    )


class ChecksFailed(ValueError):
    pass


def raise_on_failure(results: DataFrame) -> DataFrame:
    """Stops the job when a check failed. The result table has one row per check, so it fits the driver."""
    failed = [f"{r['kind']}({r['columns']})" for r in results.filter(~F.col("success")).collect()]
    if failed:
        raise ChecksFailed("failed checks: " + "; ".join(failed))
    return results
