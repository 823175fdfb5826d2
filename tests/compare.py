"""Compare a Spark result with the same query run by another engine."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from tableinsight.plans.catalog import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows(columns: list[str], records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in records)


_FAMILIES = {
    "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float",
    "string": "text", "boolean": "bool", "date": "date", "timestamp_ntz": "time", "timestamp": "time",
    "INTEGER": "int", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text",
    "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "time", "TIMESTAMP WITH TIME ZONE": "time",
}


def compare(frame, con, sql: str) -> list[str]:
    """Differences between the two results, empty when they agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: _FAMILIES.get(str(d[1]), str(d[1])) for d in result.description}
    expected = rows(names, result.fetchall())
    actual = rows(frame.columns, frame.collect())
    problems = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} but expected {sorted(names)}"]
    for name, spark_type in frame.dtypes:
        if _FAMILIES.get(spark_type, spark_type) != types[name]:
            problems.append(f"type of {name}: {spark_type} but expected {types[name]}")
    if expected != actual:
        missing, extra = expected - actual, actual - expected
        problems.append(
            f"{sum(expected.values())} rows expected, {sum(actual.values())} found; "
            f"missing {list(missing)[:3]}, extra {list(extra)[:3]}"
        )
    return problems
