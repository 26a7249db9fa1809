"""Declared schemas of the tables the operators exchange, and the checks on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the metadata standard's name of the title field.
TITLE_FIELD = "dcterms:title"

MEDIA = T.StructType(
    [
        T.StructField("accessuri", T.StringType()),
        T.StructField("data", T.StructType([T.StructField(TITLE_FIELD, T.StringType())])),
    ]
)

TAGGED = T.StructType(
    [
        T.StructField("accessuri", T.StringType()),
        T.StructField(TITLE_FIELD, T.StringType()),
        T.StructField("contaminated", T.IntegerType(), False),
    ]
)

IMAGES = T.StructType(
    [
        T.StructField("accessuri", T.StringType()),
        T.StructField("contaminated", T.IntegerType()),
        T.StructField("imgnpa", T.ArrayType(T.FloatType())),
    ]
)

LABEL_LIST = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("label", T.IntegerType(), False),
    ]
)


class SchemaError(ValueError):
    """A table lacks a column or has it in another type than the operator needs."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing}; the table has {df.columns}")
    return df


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check that every declared field is there with its declared type (nullability aside)."""
    require_columns(df, schema.fieldNames())
    for field in schema.fields:
        found = df.schema[field.name].dataType
        if found.simpleString() != field.dataType.simpleString():
            raise SchemaError(
                f"column {field.name} is {found.simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df
