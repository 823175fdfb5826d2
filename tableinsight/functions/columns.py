"""Which columns play which role, decided from types and names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name patterns that decide which columns are used.
ID_PATTERN = re.compile(r"(^id$)|(_id$)|(^id_)", re.IGNORECASE)
DATE_WORD = "date"

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Reported SQL type names.
TYPE_NAMES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}


def type_name(data_type: T.DataType) -> str:
    spark_name = data_type.simpleString()
    return TYPE_NAMES.get(spark_name, spark_name.upper())


def is_date(data_type: T.DataType) -> bool:
    return isinstance(data_type, DATE_TYPES)


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_date(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def id_column(df: DataFrame, choice: str | None = "auto") -> str | None:
    """``"auto"`` looks for an id-like name; a name is taken as given; ``None`` means no entity."""
    if choice != "auto":
        return choice
    return next(
        (f.name for f in df.schema if not is_date(f.dataType) and ID_PATTERN.search(f.name)), None
    )


def first_date_column(df: DataFrame, choice: str | None = "auto") -> str | None:
    if choice != "auto":
        return choice
    return next(iter(date_columns(df)), None)


def dimension_columns(df: DataFrame, id_col: str | None) -> list[str]:
    """All columns but the entity and dates."""
    return [
        f.name
        for f in df.schema
        if f.name != id_col and not is_date(f.dataType) and DATE_WORD not in f.name.lower()
    ]


def type_family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if is_date(data_type):
        return "date"
    return data_type.simpleString()
