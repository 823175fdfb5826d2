"""Table inspection: rows, NULLs, date ranges, duplicate groups and the checks built on them.

Everything derives from the distinct rows and their multiplicities, so a full inspection is one
scan and one shuffle of narrow keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import date_columns, first_date_column, id_column, type_name
from tableinsight.functions.keys import null_in, row_digest, row_groups
from tableinsight.names import col

# Large-table limit and check names.
LARGE_TABLE_ROWS = 10_000
CHECK_ENTITIES = "total_entites"
CHECK_ROWS = "total_lignes"
CHECK_DATES = "plage_dates"
CHECK_DUPLICATES = "doublons"
SQL_ERROR = "Erreur SQL: "


@dataclass(frozen=True)
class TableProfile:
    schema: list[tuple[str, str]]
    row_count: int
    date_range: dict[str, tuple[str | None, str | None]]
    null_counts: dict[str, int]
    duplicate_count: int
    id_column: str | None
    needs_aggregation: bool


def _total(n: Column) -> Column:
    return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def table_totals(df: DataFrame, entity: str | None = None) -> DataFrame:
    """One row: row and duplicate counts, distinct entities, ``null_i`` per column and
    ``min_i``/``max_i`` per date column. Inspection and validation both read from it."""
    dates = date_columns(df)
    keep = dates + ([entity] if entity in df.columns and entity not in dates else [])
    groups, key = row_groups(df, keep), {name: f"k{i}" for i, name in enumerate(keep)}
    n = F.col("n")
    aggregates = [
        _total(n).alias("row_count"),
        F.count_if(n > 1).alias("duplicate_groups"),
        _total(n - 1).alias("excess_rows"),
    ]
    if entity in key:
        aggregates.append(F.count_distinct(F.col(key[entity])).alias("entities"))
    for i, name in enumerate(df.columns):
        aggregates.append(_total(F.when(null_in(i), n)).alias(f"null_{i}"))
        if name in dates:
            k = F.col(key[name])
            aggregates += [F.min(k).alias(f"min_{i}"), F.max(k).alias(f"max_{i}")]
    return groups.agg(*aggregates)


def inspect_table(df: DataFrame, id_col: str | None = "auto") -> TableProfile:
    row = table_totals(df).first()
    dates = set(date_columns(df))
    as_text = {True: str, False: lambda _: None}
    return TableProfile(
        schema=[(f.name, type_name(f.dataType)) for f in df.schema],
        row_count=row.row_count,
        date_range={
            name: tuple(as_text[v is not None](v) for v in (row[f"min_{i}"], row[f"max_{i}"]))
            for i, name in enumerate(df.columns)
            if name in dates
        },
        null_counts={
            name: row[f"null_{i}"] for i, name in enumerate(df.columns) if row[f"null_{i}"] > 0
        },
        duplicate_count=row.duplicate_groups,
        id_column=id_column(df, id_col),
        needs_aggregation=row.row_count > LARGE_TABLE_ROWS,
    )


def inspection_summary(
    df: DataFrame, id_col: str | None = "auto", totals: DataFrame | None = None
) -> DataFrame:
    """The inspection as one row; ``totals`` are the table's, if already computed."""
    with_nulls = sum(
        (F.col(f"null_{i}") > 0).cast("int") for i in range(len(df.columns))
    )
    return (totals or table_totals(df)).select(
        "row_count",
        F.lit(len(df.columns)).alias("n_columns"),
        "duplicate_groups",
        with_nulls.alias("n_columns_with_nulls"),
        F.lit(id_column(df, id_col)).cast("string").alias("id_column"),
        F.lit(", ".join(date_columns(df))).alias("date_columns"),
        (F.col("row_count") > LARGE_TABLE_ROWS).alias("needs_aggregation"),
    )


def _one_row_per_column(row: DataFrame, structs: list[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_nulls)`` for the columns that have any: one map-side aggregate."""
    counts = df.agg(
        *[F.count_if(col(name).isNull()).alias(f"c{i}") for i, name in enumerate(df.columns)]
    )
    structs = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"c{i}").alias("n_nulls"))
        for i, name in enumerate(df.columns)
    ]
    return _one_row_per_column(counts, structs).where("n_nulls > 0")


def date_ranges(df: DataFrame) -> DataFrame:
    """``(column_name, min, max)`` as text; NULL bounds for an empty table."""
    names = date_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, min string, max string")
    bounds = df.agg(
        *[f(col(name)).cast("string").alias(f"{a}{i}")
          for i, name in enumerate(names)
          for a, f in (("min", F.min), ("max", F.max))]
    )
    structs = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
        )
        for i, name in enumerate(names)
    ]
    return _one_row_per_column(bounds, structs)


def duplicate_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, distinct rows that repeat (groups), and rows beyond the first copy (excess)."""
    named = df.columns if columns is None else [c for c in df.columns if c in columns]
    groups = df.groupBy(row_digest(df, named).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        _total(F.col("n")).alias("row_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        _total(F.col("n") - 1).alias("excess_rows"),
    )


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def schema_frame(df: DataFrame) -> DataFrame:
    rows = [(f.name, type_name(f.dataType)) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")


def validation_checks(
    df: DataFrame,
    id_col: str | None = "auto",
    date_col: str | None = "auto",
    totals: DataFrame | None = None,
) -> DataFrame:
    """``(check, result, passed)``; a check that names a missing column fails, the others still run."""
    entity, date = id_column(df, id_col), first_date_column(df, date_col)
    missing = {c for c in (entity, date) if c and c not in df.columns}
    totals = totals or table_totals(df, entity)

    def check(name: str, column: str | None, result: Column, passed: Column = F.lit(True)) -> Column:
        if column in missing:
            result, passed = F.lit(f"{SQL_ERROR}column {column} not found"), F.lit(False)
        return F.struct(
            F.lit(name).alias("check"),
            result.cast("string").alias("result"),
            passed.alias("passed"),
        )

    checks = []
    if entity:
        checks.append(check(CHECK_ENTITIES, entity, F.col("entities")))
    else:
        checks.append(check(CHECK_ROWS, None, F.col("row_count")))
    if date:
        bounds = []
        if date not in missing:
            i = df.columns.index(date)
            bounds = [F.col(f"min_{i}").cast("string"), F.col(f"max_{i}").cast("string")]
        checks.append(check(CHECK_DATES, date, F.concat_ws(" .. ", *bounds)))
    duplicates = F.col("duplicate_groups")
    checks.append(check(CHECK_DUPLICATES, None, duplicates, duplicates == 0))
    return _one_row_per_column(totals, checks)
