"""Schema of the interaction log and schemas declared in configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

# Columns and Spark types of the raw log.
LOG_FIELDS = (
    {"name": "event_time", "type": "TimestampType"},
    {"name": "event_type", "type": "StringType"},
    {"name": "product_id", "type": "StringType"},
    {"name": "category_id", "type": "StringType"},
    {"name": "category_code", "type": "StringType"},
    {"name": "brand", "type": "StringType"},
    {"name": "price", "type": "FloatType"},
    {"name": "user_id", "type": "StringType"},
    {"name": "user_session", "type": "StringType"},
)


def declared_schema(fields: Iterable[Mapping[str, str]] = LOG_FIELDS) -> T.StructType:
    """``{name, type}`` pairs to a schema in which every column may be null."""
    schema = T.StructType()
    for field in fields:
        kind = getattr(T, field["type"], None)
        if not (isinstance(kind, type) and issubclass(kind, T.DataType)):
            raise ValueError(f"column {field['name']}: {field['type']} is not a Spark type")
        schema = schema.add(field["name"], kind(), True)
    return schema


def log_schema() -> T.StructType:
    return declared_schema()
