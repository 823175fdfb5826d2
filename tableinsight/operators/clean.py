"""Clean and type a table of raw text.

Two passes: one aggregate measures every rule on every column at once, the driver decides from
that single row, and one projection of native casts applies the decisions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import text_columns
from tableinsight.functions.keys import null_in, row_groups
from tableinsight.functions.parsing import (
    DATE_KEYWORDS,
    comma_to_point,
    has_comma,
    is_decimal_comma,
    is_number_or_comma,
    is_zero_led,
    stripped,
    to_date_time,
    to_integer,
    to_number,
)
from tableinsight.names import col, strip_headers

# Shares of a column's values that a conversion needs.
DECIMAL_SHARE = 0.7
LEADING_ZERO_SHARE = 0.3
NUMERIC_SHARE = 0.9
DATE_SHARE = 0.7


@dataclass
class Decisions:
    original_rows: int
    original_columns: int
    kept_rows: int
    kept_columns: list[str]
    decimal: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    integral: set[str] = field(default_factory=set)
    date: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Cleaned:
    frame: DataFrame
    report: DataFrame
    decisions: Decisions


def _named_like_date(name: str) -> bool:
    return any(word in name.lower() for word in DATE_KEYWORDS)


def _measure(df: DataFrame) -> tuple[DataFrame, Decisions]:
    """Pass 1. Rows that are NULL throughout do not count towards any share."""
    text = set(text_columns(df))
    any_value = F.lit(False)
    values, aggregates = [], []
    for i, name in enumerate(df.columns):
        any_value = any_value | col(name).isNotNull()
        values.append(col(name).isNotNull().alias(f"p{i}"))
        aggregates.append(F.count_if(f"p{i}").alias(f"present{i}"))
        if name not in text:
            continue
        value = F.col(f"v{i}")
        number = is_number_or_comma(value)
        values.append(stripped(col(name)).alias(f"v{i}"))
        aggregates += [
            F.count(value).alias(f"values{i}"),
            F.count_if(is_decimal_comma(value)).alias(f"decimal{i}"),
            F.count_if(is_zero_led(value)).alias(f"zero{i}"),
            F.count_if(number).alias(f"pointed{i}"),
            F.count_if(has_comma(value) & number).alias(f"comma{i}"),
            F.count(to_integer(value)).alias(f"integer{i}"),
        ]
        if _named_like_date(name):
            aggregates.append(F.count(to_date_time(value)).alias(f"date{i}"))
    values.append(any_value.alias("any_value"))
    row = (
        df.select(*values)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("any_value").alias("kept"), *aggregates)
        .first()
    )
    kept = [c for i, c in enumerate(df.columns) if row[f"present{i}"]]
    decisions = Decisions(row["rows"], len(df.columns), row["kept"], kept)
    for i, name in enumerate(df.columns):
        if name not in text or not row[f"present{i}"] or not row[f"values{i}"]:
            continue
        _decide(decisions, name, {k: row[f"{k}{i}"] for k in
                                  ("values", "decimal", "zero", "pointed", "comma", "integer")},
                row[f"date{i}"] if _named_like_date(name) else None)
    return df.where(any_value), decisions


def _decide(decisions: Decisions, name: str, counts: dict[str, int], dates: int | None) -> None:
    values = counts["values"]
    decimal = counts["decimal"] / values > DECIMAL_SHARE
    if decimal:
        decisions.decimal.append(name)
    if counts["zero"] / values <= LEADING_ZERO_SHARE:
        numbers = counts["pointed"] - (0 if decimal else counts["comma"])
        if numbers / values > NUMERIC_SHARE:
            decisions.numeric.append(name)
            # Whole numbers without a gap stay integers; a gap or a fraction makes them doubles.
            if not decimal and counts["integer"] == decisions.kept_rows:
                decisions.integral.add(name)
            return
    # A decimal comma that became a point is no date.
    if dates is not None and not decimal and dates / values > DATE_SHARE:
        decisions.date.append(name)


def _converted(name: str, decisions: Decisions) -> Column:
    value = col(name)
    if name in decisions.decimal:
        value = comma_to_point(value)
    if name in decisions.integral:
        value = to_integer(value)
    elif name in decisions.numeric:
        value = to_number(value)
    elif name in decisions.date:
        value = to_date_time(value)
    return value.alias(name)


def _report(converted: DataFrame, decisions: Decisions) -> DataFrame:
    counts = row_groups(converted, []).agg(
        F.count(F.lit(1)).alias("final_rows"),
        *[F.count_if(null_in(i)).alias(f"missing{i}") for i in range(len(converted.columns))],
    )
    missing = [
        F.struct(F.lit(c).alias("name"), F.col(f"missing{i}").alias("n")) for i, c in enumerate(converted.columns)
    ]
    per_column = F.map_from_entries(F.array(*missing)) if missing else F.create_map()

    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return counts.select(
        F.lit(decisions.original_rows).cast("bigint").alias("original_rows"),
        F.lit(decisions.original_columns).alias("original_cols"),
        "final_rows",
        F.lit(len(converted.columns)).alias("final_cols"),
        F.lit(decisions.original_rows - decisions.kept_rows)
        .cast("bigint")
        .alias("empty_rows_removed"),
        (F.lit(decisions.kept_rows) - F.col("final_rows"))
        .cast("bigint")
        .alias("duplicates_removed"),
        names(decisions.decimal).alias("columns_converted_decimal"),
        names(decisions.numeric).alias("columns_converted_numeric"),
        names(decisions.date).alias("columns_converted_date"),
        F.map_filter(per_column, lambda _, n: n > 0).alias("missing_values"),
    )


def clean(df: DataFrame, deduplicate: bool = True) -> Cleaned:
    """Strip headers, drop empty rows and columns, trim, convert decimals, numbers and dates,
    drop duplicate rows, and report what was done."""
    rows, decisions = _measure(strip_headers(df))
    text = set(text_columns(rows))
    # Stripped in a projection of its own: the conversions look at a value several times.
    kept = [
        (stripped(col(c)) if c in text else col(c)).alias(c) for c in decisions.kept_columns
    ]
    converted = rows.select(*kept).select(
        *[_converted(c, decisions) for c in decisions.kept_columns]
    )
    frame = converted.dropDuplicates() if deduplicate else converted
    return Cleaned(frame, _report(converted, decisions), decisions)
