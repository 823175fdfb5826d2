"""Column profiles and descriptive statistics with exact quantiles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import (
    date_columns,
    numeric_columns,
    text_columns,
    type_name,
)
from tableinsight.functions.quantiles import (
    DIRECT_VALUES,
    as_doubles,
    interpolate,
    order_statistics,
    wanted_ranks,
)
from tableinsight.names import col
from tableinsight.operators.inspection import duplicate_stats

# Keys of the JSON profile and the profile columns behind them.
REPORT_COLUMN = {
    "colonne": "column_name",
    "type": "column_type",
    "valeurs_manquantes": "n_nulls",
}
REPORT_NUMBERS = {
    "min": "min",
    "max": "max",
    "moyenne": "mean",
    "mediane": "median",
    "ecart_type": "stddev",
}

_WHOLE = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT")
_STATS = ("n", "lo", "hi", "mean", "std", "exact_lo", "exact_hi")
_QUARTILES = (0.25, 0.5, 0.75)
_TEXT_SCHEMA = "column_name string, count bigint, unique bigint, top string, freq bigint"


def _column_stats(
    df: DataFrame,
    numbers: list[Column],
    flags: list[Column],
    probabilities: tuple[float, ...],
    direct_values: int,
) -> tuple[list[dict], list[int]]:
    """Statistics and exact quantiles per number, and how often each flag holds.

    First-order statistics and flags come from one fully code-generated scan. The quantiles need
    at least two more, a sketching and a ranking one, which read only the number columns. (Sketches
    in the first scan would move all its aggregates to the slower object-based aggregation.)
    """
    values = df.select(
        *as_doubles(numbers), *[x.alias(f"x{i}") for i, x in enumerate(numbers)],
        *[f.alias(f"f{j}") for j, f in enumerate(flags)],
    )
    aggregates = [F.count_if(F.col(f"f{j}")).alias(f"f{j}") for j in range(len(flags))]
    for i in range(len(numbers)):
        v = F.col(f"c{i}")
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            # In the column's own type: a DOUBLE does not hold every BIGINT or DECIMAL.
            F.min(F.col(f"x{i}")).cast("string").alias(f"exact_lo{i}"),
            F.max(F.col(f"x{i}")).cast("string").alias(f"exact_hi{i}"),
        ]
    row = values.agg(*aggregates).first()
    bounds = {
        i: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"])
        for i in range(len(numbers))
        if row[f"n{i}"]
    }
    ranks = {
        i: {r for p in probabilities for r in wanted_ranks(n, p)[:2]}
        for i, (n, _, _) in bounds.items()
    }
    found = order_statistics(values, ranks, bounds, direct_values)
    stats = []
    for i in range(len(numbers)):
        first_order = {s: row[f"{s}{i}"] for s in _STATS}
        quantiles = {p: interpolate(found, i, row[f"n{i}"], p) for p in probabilities}
        stats.append(first_order | quantiles)
    return stats, [row[f"f{j}"] for j in range(len(flags))]


def profile_table(df: DataFrame, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """One row per column: type, NULLs and, for numbers, min, max, mean, exact median, stddev.

    There is one row per column of the table, so the result passes through the driver by design.
    """
    numeric = numeric_columns(df)
    stats, nulls = _column_stats(
        df,
        [col(name) for name in numeric],
        [col(name).isNull() for name in df.columns],
        (0.5,),
        direct_values,
    )
    by_name = dict(zip(numeric, stats))
    rows = []
    for field, n_nulls in zip(df.schema, nulls):
        s = by_name.get(field.name, {})
        numbers = [s.get(k) for k in ("lo", "hi", "mean", 0.5, "std", "exact_lo", "exact_hi")]
        rows.append((field.name, type_name(field.dataType), n_nulls, *numbers))
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, column_type string, n_nulls bigint, min double, max double, "
        "mean double, median double, stddev double, min_exact string, max_exact string",
    )


def profile_report(df: DataFrame, direct_values: int = DIRECT_VALUES) -> dict:
    """The profile with row and duplicate-group totals, in the form of a JSON document."""
    totals = duplicate_stats(df).first()
    columns = []
    for row in profile_table(df, direct_values).collect():  # one row per column
        entry = {name: row[source] for name, source in REPORT_COLUMN.items()}
        if row["min"] is not None:
            entry |= {name: row[source] for name, source in REPORT_NUMBERS.items()}
            if row["column_type"] in _WHOLE:
                entry |= {"min": int(row["min_exact"]), "max": int(row["max_exact"])}
        columns.append(entry)
    return {
        "total_lignes": totals.row_count,
        "doublons": totals.duplicate_groups,
        "profiling": columns,
    }


def describe_numbers(df: DataFrame, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    names = numeric_columns(df)
    stats, _ = _column_stats(df, [col(c) for c in names], [], _QUARTILES, direct_values)
    keys = ("n", "mean", "std", "lo", *_QUARTILES, "hi")
    return df.sparkSession.createDataFrame(
        [(name, *[s[k] for k in keys]) for name, s in zip(names, stats)],
        "column_name string, count bigint, mean double, std double, min double, p25 double, "
        "p50 double, p75 double, max double",
    )


def describe_dates(df: DataFrame, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """count, mean, min, quartiles and max per date column, to the microsecond."""
    names = date_columns(df)
    micros = [F.unix_micros(col(c).cast("timestamp")) for c in names]
    stats, _ = _column_stats(df, micros, [], _QUARTILES, direct_values)
    keys = ("mean", "lo", *_QUARTILES, "hi")
    whole = [
        (name, s["n"], *[None if s[k] is None else int(s[k]) for k in keys])
        for name, s in zip(names, stats)
    ]
    columns = ("mean", "min", "p25", "p50", "p75", "max")
    frame = df.sparkSession.createDataFrame(
        whole,
        "column_name string, count bigint, " + ", ".join(f"{c} bigint" for c in columns),
    )
    return frame.withColumns({c: F.timestamp_micros(c) for c in columns})


# Characters of a text that travel; what is longer is told apart by a digest.
_PREFIX = 64


def describe_text(df: DataFrame) -> DataFrame:
    """count, distinct values, most frequent value (smallest on a tie) and its frequency.

    All columns are counted in one shuffle of prefixes and digests, collapsed before it; no text
    travels. A winner longer than its prefix is looked up among the values that begin with it.
    """
    names = text_columns(df)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], _TEXT_SCHEMA)
    values = df.select(*[col(c) for c in names]).unpivot([], [col(c) for c in names], "column_name", "value")
    values = values.where(F.col("value").isNotNull()).select(
        "column_name", "value", F.substring("value", 1, _PREFIX).alias("prefix"),
        F.when(F.length("value") > _PREFIX, F.sha2("value", 256)).alias("digest"),
    )
    counts = values.groupBy("column_name", "prefix", "digest").agg(F.count(F.lit(1)).alias("n"))
    longer = F.col("digest").isNotNull().alias("longer")
    best = F.min(F.struct((-F.col("n")).alias("rank"), "prefix", longer)).alias("best")
    found = counts.groupBy("column_name").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best)
    rows = found.collect()  # one row a column
    tops = {r.column_name: r.best.prefix for r in rows}
    cut = [(r.column_name, r.best.prefix, -r.best.rank) for r in rows if r.best.longer]
    if cut:
        begins = reduce(or_, [(F.col("column_name") == c) & (F.col("prefix") == p) for c, p, _ in cut])
        alike = values.where(F.col("digest").isNotNull() & begins).groupBy("column_name", "digest").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("value")
        )
        most = reduce(or_, [(F.col("column_name") == c) & (F.col("n") == n) for c, _, n in cut])
        tops |= dict(alike.where(most).groupBy("column_name").agg(F.min("value").alias("value")).collect())
    return spark.createDataFrame(
        [(r.column_name, r["count"], r.unique, tops[r.column_name], -r.best.rank) for r in rows], _TEXT_SCHEMA
    )


def describe(df: DataFrame, direct_values: int = DIRECT_VALUES) -> dict[str, DataFrame]:
    """Numbers and dates where the table has them, the text columns where it has neither."""
    result = {}
    if numeric_columns(df):
        result["numbers"] = describe_numbers(df, direct_values)
    if date_columns(df):
        result["dates"] = describe_dates(df, direct_values)
    return result or {"text": describe_text(df)}
