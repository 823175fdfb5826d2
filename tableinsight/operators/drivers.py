"""Which categories drive the metric: breakdown per dimension and a test against equal shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.chisq import SIGNIFICANCE_LEVEL, uniform_statistic, upper_tail
from tableinsight.functions.columns import dimension_columns, id_column
from tableinsight.functions.keys import compact_key
from tableinsight.names import col

# Finding texts.
SIGNIFICANT_TEXT = "significatif"
NOT_SIGNIFICANT_TEXT = "non significatif"
NO_FINDING_TEXT = "Aucune observation disponible."

# Rows of an entity up to which they are brought together in one task.
LARGE_ENTITY_ROWS = 100_000

_COUNT_SCHEMA = "dimension string, category string, n bigint"
_TEST_SCHEMA = (
    "dimension string, status string, n_categories bigint, chi2 double, p_value double, "
    "significant boolean, error string"
)


@dataclass(frozen=True)
class DriverAnalysis:
    breakdown: DataFrame
    tests: DataFrame


def _category_counts(df: DataFrame, dimensions: list[str], entity: str | None) -> DataFrame:
    """``(dimension, category, n)`` for all dimensions.

    The rows of an entity meet first, narrow as they are, so its categories are told apart where it
    is and only counts move on. Rows without an entity, and those of an entity that has very many,
    are not brought together: there (dimension, category, entity) is pre-aggregated and shuffled, so
    no category or entity is ever whole in one task.
    """
    # Positional names: a header may contain anything, the dimension column carries the real name.
    slots = [f"d{i}" for i in range(len(dimensions))]
    categories = [col(d).cast("string").alias(s) for d, s in zip(dimensions, slots)]
    if entity:
        rows = df.select(compact_key(col(entity), df.schema[entity].dataType).alias("entity"), *categories)
        large = F.broadcast(
            rows.where("entity IS NOT NULL").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > LARGE_ENTITY_ROWS).select("entity")
        )
        # As many tasks as a shuffle has: each row becomes one a dimension there, which sizes do not tell.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = rows.where("entity IS NOT NULL").join(large, "entity", "left_anti").repartition(parts, "entity")
        apart = rows.where("entity IS NULL").unionByName(rows.join(large, "entity", "left_semi"))
        each = [_pairs(part, slots).distinct() for part in (met, apart)]
        value = F.count("entity")
        counted = [part.groupBy("slot", "category").agg(value.alias("n")) for part in each]
        counts = counted[0].unionByName(counted[1]).groupBy("slot", "category").agg(F.sum("n").alias("n"))
    else:
        long = df.select(*categories).unpivot([], slots, "slot", "category")
        counts = long.groupBy("slot", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(_real_name(dimensions), "category", "n")


def _pairs(rows: DataFrame, slots: list[str]) -> DataFrame:
    """``slot, category, entity``. Unlike an unpivot, rows stay known to be where their entity is."""
    each = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("category")) for s in slots])
    return rows.select("entity", F.inline(each)).select("slot", "category", "entity")


def _real_name(dimensions: list[str]):
    names = F.array(*[F.lit(d) for d in dimensions])
    index = F.substring("slot", 2, 10).cast("int")
    return F.get(names, index).alias("dimension")


def _tests(counts: DataFrame, max_categories: int | None) -> DataFrame:
    n = F.col("n").cast("decimal(19,0)")
    per_dimension = counts.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum("n").alias("total"),
        F.sum((n * n).cast("decimal(38,0)")).alias("squares"),
    )
    status = (
        F.when(F.lit(max_categories is not None) & (F.col("n_categories") > (max_categories or 0)), "skipped")
        .when((F.col("n_categories") < 2) | (F.col("total") <= 0), "untested")
        .otherwise("tested")
    )
    k = F.col("n_categories")
    statistic = F.when(
        F.col("status") == "tested", uniform_statistic(k, F.col("total"), F.col("squares"))
    )
    tail = F.when(F.col("status") == "tested", upper_tail(F.col("statistic"), k - 1))
    return (
        per_dimension.withColumn("status", status)
        .withColumn("statistic", statistic)
        .withColumn("tail", tail)
        .select(
            "dimension",
            "status",
            "n_categories",
            F.round("statistic", 3).alias("chi2"),
            F.round("tail", 4).alias("p_value"),
            (F.col("tail") < SIGNIFICANCE_LEVEL).alias("significant"),
            F.lit(None).cast("string").alias("error"),
        )
    )


def driver_analysis(
    df: DataFrame,
    id_col: str | None = "auto",
    dimensions: list[str] | None = None,
    max_dimensions: int | None = None,
    max_categories: int | None = None,
) -> DriverAnalysis:
    """Break the metric down by each dimension and test it.

    All dimensions and categories are counted unless the caller sets a limit. ``breakdown`` holds
    ``(dimension, category, n)`` of the dimensions within the category limit. ``tests`` holds one
    row per dimension with status tested, untested, skipped (too many categories), left_out (more
    dimensions than asked for) or error. Both are lazy; nothing is counted on the driver.
    """
    spark = df.sparkSession
    entity = id_column(df, id_col)
    asked = dimensions or dimension_columns(df, entity)
    chosen, left_out = asked[:max_dimensions], asked[max_dimensions:] if max_dimensions is not None else []
    entity_missing = entity is not None and entity not in df.columns
    failing = chosen if entity_missing else [d for d in chosen if d not in df.columns]
    usable = [] if entity_missing else [d for d in chosen if d in df.columns]

    other = [(d, "left_out", None, None, None, None, None) for d in left_out]
    missing = entity if entity_missing else None
    other += [
        (d, "error", None, None, None, None, f"column {missing or d} not found") for d in failing
    ]
    tests = spark.createDataFrame(other, _TEST_SCHEMA)
    breakdown = spark.createDataFrame([], _COUNT_SCHEMA)
    if usable:
        counts = _category_counts(df, usable, entity)
        tests = _tests(counts, max_categories).unionByName(tests)
        if max_categories is not None:
            sizes = counts.groupBy(F.col("dimension").alias("__d")).agg(F.count(F.lit(1)).alias("__k"))
            within = sizes.where(F.col("__k") <= max_categories)
            counts = counts.join(within, F.col("dimension") == F.col("__d"), "left_semi")
        breakdown = counts.orderBy("dimension", F.desc("n"), F.asc_nulls_last("category"))
    return DriverAnalysis(breakdown, tests)


def significant_drivers(tests: DataFrame) -> DataFrame:
    return tests.where("significant")


def _plain_decimal(p: Column) -> Column:
    """Up to four decimals without an exponent, at least one."""
    return F.regexp_replace(p.cast("decimal(6,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def findings(tests: DataFrame) -> DataFrame:
    """``(dimension, finding)`` sentences for the tested dimensions."""
    marker = F.when(F.col("significant"), SIGNIFICANT_TEXT).otherwise(NOT_SIGNIFICANT_TEXT)
    sentence = F.concat(
        F.col("dimension"), F.lit(" : p="), _plain_decimal(F.col("p_value")),
        F.lit(" ("), marker, F.lit(")"),
    )
    return tests.where("status = 'tested'").select("dimension", sentence.alias("finding"))
