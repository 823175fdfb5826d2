"""The business metric: distinct entities (or rows), per week where the table has a date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import first_date_column, id_column
from tableinsight.functions.keys import compact_key
from tableinsight.names import col

# Metric labels.
ENTITY_LABEL = "entités distinctes"
ROW_LABEL = "lignes"
WEEKLY_LABEL = "Évolution hebdomadaire ({count}, sur {date})"
TOTAL_LABEL = "Total ({count}), aucune colonne date détectée"


@dataclass(frozen=True)
class Metric:
    frame: DataFrame
    label: str


def entity_count(df: DataFrame, id_col: str | None, approximate: bool = False) -> Column:
    """Distinct entities, or rows without an entity; long text ids are compared by digest."""
    if not id_col:
        return F.count(F.lit(1))
    key = compact_key(col(id_col), df.schema[id_col].dataType)
    return F.approx_count_distinct(key) if approximate else F.count_distinct(key)


def week_of(name: str) -> Column:
    """Monday of the ISO week as a DATE; independent of the session time zone."""
    return F.trunc(col(name).cast("date"), "week")


def entity_metric(
    df: DataFrame,
    id_col: str | None = "auto",
    date_col: str | None = "auto",
    approximate: bool = False,
) -> Metric:
    """Weekly ``(week, value)`` when a date column exists, else a single ``(value)`` row.

    A distinct count aggregates on (week, id) first and on week second, so neither a busy week
    nor a busy entity ends up whole in one task. ``approximate`` replaces it by a mergeable sketch.
    """
    entity = id_column(df, id_col)
    date = first_date_column(df, date_col)
    count = ENTITY_LABEL if entity else ROW_LABEL
    value = entity_count(df, entity, approximate).alias("value")
    if date is None:
        total = df.agg(value)
        return Metric(total, TOTAL_LABEL.format(count=count))
    weekly = (
        df.groupBy(week_of(date).alias("week"))
        .agg(value)
        .orderBy(F.asc_nulls_last("week"))
    )
    return Metric(weekly, WEEKLY_LABEL.format(count=count, date=date))


def top_entities(df: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """The k most active entities; ties go to the smaller key."""
    return (
        df.groupBy(col(id_col).alias("entity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("entity"))
        .limit(k)
    )
