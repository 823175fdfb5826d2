"""What the session knows: version, tables, columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tableinsight.names import quote
from tableinsight.operators.inspection import schema_frame


# Rows of a preview and of a sample.
PREVIEW_ROWS = 10


@dataclass(frozen=True)
class Health:
    status: str
    version: str
    tables: list[str]


def health_check(spark: SparkSession) -> Health:
    tables = [t.name for t in spark.catalog.listTables()]
    return Health("healthy", spark.version, tables)


def table_schema(spark: SparkSession, table: str) -> DataFrame:
    """``(column_name, column_type)`` of a registered table."""
    return schema_frame(spark.table(quote(table)))


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows; the limit is part of the plan, so only as much as needed is read."""
    return df.limit(rows)
