"""Join trees over named tables: validation, prefixed output, and a health check before joining."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.functions.columns import type_family
from tableinsight.names import col

# Supported join kinds and the growth that counts as an explosion.
JOIN_KINDS = ("inner", "left")
EXPLOSION_FACTOR = 3

EMPTY, EXPLOSION, HEALTHY = "empty", "explosion", "ok"


class JoinConfigurationError(ValueError):
    """The chosen columns cannot be joined; ``detail`` says why in technical terms."""

    def __init__(self, message: str, detail: str):
        super().__init__(message)
        self.detail = detail


@dataclass(frozen=True)
class JoinStep:
    file: str
    on_file: str
    file_column: str
    on_column: str
    how: str = "inner"


# What a spec can be told about, one word a fault.
SPEC_ERROR_SCHEMA = "position int, fault string, subject string, message string, detail string"
UNKNOWN_ROOT, UNKNOWN_TABLE, JOINED_TWICE, NOT_YET_JOINED = "unknown_root", "unknown_table", "joined_twice", "not_yet_joined"
JOIN_KIND, NO_COLUMN, KEY_TYPES, OUTSIDE = "join_kind", "no_column", "key_types", "outside_tree"


@dataclass(frozen=True)
class SpecFault:
    position: int  # of the step, from 0; -1 for the spec as a whole
    fault: str
    subject: str
    message: str
    detail: str | None = None


def _steps(spec: dict) -> list[JoinStep]:
    return [
        JoinStep(raw["file"], raw["on_file"], raw["file_column"], raw["on_column"], raw.get("how", "inner").lower())
        for raw in spec.get("joins", [])
    ]


def spec_faults(tables: dict[str, DataFrame], spec: dict) -> Iterator[SpecFault]:
    """Every fault of the tree, from its schemas alone: not connected, not complete, unknown names,
    keys that cannot be compared. A step at fault counts as joined for those after it."""
    root = spec["root"]
    if root not in tables:
        yield SpecFault(-1, UNKNOWN_ROOT, root, f"root table {root!r} is not among the tables")
    included = [root]
    for i, step in enumerate(_steps(spec)):
        if step.file not in tables:
            yield SpecFault(i, UNKNOWN_TABLE, step.file, f"table {step.file!r} is not among the tables")
        if step.file in included:
            yield SpecFault(i, JOINED_TWICE, step.file, f"table {step.file!r} is joined twice")
        if step.on_file not in included:
            yield SpecFault(i, NOT_YET_JOINED, step.on_file, f"{step.on_file!r} must be added before {step.file!r}")
        if step.how not in JOIN_KINDS:
            yield SpecFault(i, JOIN_KIND, step.how, f"unsupported join kind: {step.how}")
        if step.file in tables and step.on_file in tables:
            yield from _key_faults(tables, i, step)
        included.append(step.file)
    for name in tables:
        if name not in included:
            yield SpecFault(-1, OUTSIDE, name, f"tables outside the join tree: {name}")


def _key_faults(tables: dict[str, DataFrame], position: int, step: JoinStep) -> Iterator[SpecFault]:
    families = []
    for table, column in ((step.file, step.file_column), (step.on_file, step.on_column)):
        field = next((f for f in tables[table].schema if f.name == column), None)
        name = f"{table}.{column}"
        if field is None:
            yield SpecFault(position, NO_COLUMN, name, "A join column does not exist.", f"{name} not found")
        else:
            families.append((name, field.dataType))
    if len(families) == 2 and type_family(families[0][1]) != type_family(families[1][1]):
        (left, left_type), (right, right_type) = families
        yield SpecFault(
            position, KEY_TYPES, f"{left} = {right}",
            "The chosen join columns do not have comparable types. Choose columns of one kind.",
            f"{left} is {left_type.simpleString()}, {right} is {right_type.simpleString()}",
        )


def spec_errors(spark: SparkSession, tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """All faults of a spec as rows; none if it can be joined."""
    return spark.createDataFrame([astuple(f) for f in spec_faults(tables, spec)], SPEC_ERROR_SCHEMA)


def parse_spec(tables: dict[str, DataFrame], spec: dict) -> tuple[str, list[JoinStep]]:
    """The root and steps of a tree without faults; the first fault is raised."""
    for fault in spec_faults(tables, spec):
        if fault.detail is not None:
            raise JoinConfigurationError(fault.message, fault.detail)
        raise ValueError(fault.message)
    return spec["root"], _steps(spec)


def prefixed(name: str, df: DataFrame) -> DataFrame:
    return df.select(*[col(c).alias(f"{name}__{c}") for c in df.columns])


def join_tables(tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """All tables of the tree as one wide table, columns ``table__column`` in table order.

    Prefixing comes before joining, so equal headers never meet. Join sides are left to adaptive
    execution, which broadcasts by measured size and splits hot keys.
    """
    root, steps = parse_spec(tables, spec)
    sides = {name: prefixed(name, df) for name, df in tables.items()}

    def attach(joined: DataFrame, step: JoinStep) -> DataFrame:
        left = col(f"{step.on_file}__{step.on_column}")
        right = col(f"{step.file}__{step.file_column}")
        return joined.join(sides[step.file], left == right, step.how)

    joined = reduce(attach, steps, sides[root])
    return joined.select(*[col(c) for side in sides.values() for c in side.columns])


# Joined rows are counted in 38 digits.
_WEIGHT = "decimal(38,0)"
_MOST = "9" * 38


def _missing_weight(name: str, children: dict[str, list[JoinStep]]) -> int:
    """Rows a left-joined, unmatched table stands for: none if an inner join hangs below it."""
    below = [0 if s.how == "inner" else _missing_weight(s.file, children) for s in children[name]]
    return min(below, default=1)


def _key_counts(tables: dict[str, DataFrame], root: str, steps: list[JoinStep]) -> dict:
    """Per table one row for each combination of its join keys, with its number of rows ``w``.

    Equal combinations collapse before any join, so a hot key is one row, not a third of all.
    """
    upward = {s.file: [col(s.file_column).alias("key")] for s in steps} | {root: []}
    counts = {}
    for name, df in tables.items():
        below = [s for s in steps if s.on_file == name]
        keys = [col(s.on_column).alias(f"c{i}") for i, s in enumerate(below)]
        counts[name] = df.groupBy(*upward[name], *keys).agg(F.count(F.lit(1)).cast(_WEIGHT).alias("w"))
    return counts


def _weights(name: str, counts: dict[str, DataFrame], children: dict) -> DataFrame:
    """``(key, w)``: joined rows the subtree of ``name`` yields per value of its own join column."""
    rows = counts[name]
    for i, step in enumerate(children[name]):
        side = _weights(step.file, counts, children).select(
            F.col("key").alias(f"k{i}"), F.col("w").alias(f"w{i}")
        )
        rows = rows.join(side, F.col(f"c{i}") == F.col(f"k{i}"), step.how)
        missing = _missing_weight(step.file, children) if step.how == "left" else 0
        factor = F.coalesce(F.col(f"w{i}"), F.lit(missing))
        # Hot keys multiply beyond 64 bits; beyond 38 digits the count stays at the largest.
        product = F.coalesce(F.try_multiply(F.col("w"), factor).cast(_WEIGHT), F.lit(_MOST).cast(_WEIGHT))
        rows = rows.withColumn("w", product).drop(f"k{i}", f"w{i}")
    total = F.when(F.count("w") > 0, F.coalesce(F.try_sum("w").cast(_WEIGHT), F.lit(_MOST).cast(_WEIGHT)))
    total = F.coalesce(total, F.lit(0).cast(_WEIGHT)).alias("w")
    return rows.groupBy(*[c for c in rows.columns if c == "key"]).agg(total)


def joined_row_count(tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """Number of rows of the join tree, from key counts alone; no joined row is ever built."""
    root, steps = parse_spec(tables, spec)
    children = {name: [s for s in steps if s.on_file == name] for name in tables}
    counts = _key_counts(tables, root, steps)
    rows = F.least("w", F.lit(2**63 - 1).cast(_WEIGHT)).cast("bigint")
    return _weights(root, counts, children).select(rows.alias("row_count"))


def source_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def join_status(row_count: Column, largest_source: Column) -> Column:
    return (
        F.when(row_count == 0, EMPTY)
        .when(
            (largest_source > 0) & (row_count > EXPLOSION_FACTOR * largest_source), EXPLOSION
        )
        .otherwise(HEALTHY)
    )


def diagnose_join(tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """One row ``(row_count, largest_source, status, warning)``, computed before the join is run."""
    joined = joined_row_count(tables, spec).select(
        F.lit(None).cast("string").alias("source"), F.col("row_count").alias("n")
    )
    # Counting a source reads no column, only the row counts of its Parquet footers.
    sizes = source_row_counts(tables).unionByName(joined).agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("row_count"),
        F.max(F.when(F.col("source").isNotNull(), F.col("n"))).alias("largest_source"),
    )
    warning = F.when(F.col("status") == EMPTY, "No key value occurs on both sides.").when(
        F.col("status") == EXPLOSION,
        F.concat(
            F.lit("The join key repeats: "), F.col("row_count").cast("string"),
            F.lit(" rows from at most "), F.col("largest_source").cast("string"),
        ),
    )
    return sizes.withColumn(
        "status", join_status(F.col("row_count"), F.col("largest_source"))
    ).withColumn("warning", warning)
