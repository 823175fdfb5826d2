"""Trailing z-score over the latest values of a series, and the decision to run an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableinsight.names import col

# Window, thresholds and result words.
WINDOW_SIZE = 12
THRESHOLD = 2.0
MIN_VALUES = 3
HIGH_SEVERITY = 3
MEDIUM_SEVERITY = 2
NOT_ENOUGH_DATA = "pas_assez_de_donnees"
NO_VARIANCE = "pas_de_variance"
UP, DOWN = "hausse", "baisse"
HIGH, MEDIUM, LOW = "elevee", "moyenne", "faible"
DECIMALS = 4

# Values drawn to find the borders of the ranges a text-ordered series is cut into.
_DRAWN = 2000


def score(df: DataFrame, window: str, threshold: float = THRESHOLD) -> DataFrame:
    """Add the score of the last value of ``window``, an array of doubles that ends with it.

    The only place where scores are computed: batch and stream differ in how they get the window.
    """
    values = F.filter(col(window), lambda x: x.isNotNull())
    n = F.size("__values")
    mean = F.aggregate("__values", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(
        F.transform("__values", lambda x: F.pow(x - F.col("__mean"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x
    )
    last = F.element_at(col(window), -1)
    enough = n >= MIN_VALUES
    reason = F.when(~enough, NOT_ENOUGH_DATA).when(F.col("__std") == 0, NO_VARIANCE)
    z = F.when(F.col("reason").isNull(), (last - F.col("__mean")) / F.col("__std"))
    defined, size = F.col("__z").isNotNull(), F.abs("__z")
    return (
        df.withColumn("__values", values)
        .withColumn("__mean", F.when(enough, mean))
        .withColumn("__std", F.when(enough, F.sqrt(spread / n)))
        .withColumn("reason", reason)
        .withColumn("__z", z)
        .withColumns(
            {
                "anomaly": F.coalesce(size > threshold, F.lit(False)),
                "moyenne": F.when(defined, F.round("__mean", DECIMALS)),
                "ecart_type": F.when(defined, F.round("__std", DECIMALS)),
                "z_score": F.round("__z", DECIMALS),
                "direction": F.when(F.col("__z") > 0, UP).when(defined, DOWN),
                "severite": F.when(size > HIGH_SEVERITY, HIGH)
                .when(size > MEDIUM_SEVERITY, MEDIUM)
                .when(defined, LOW),
            }
        )
        .drop("__values", "__mean", "__std", "__z")
    )


def _borders(df: DataFrame, first: str, ranges: int) -> list:
    """Values of the first order column between which rows are dealt, in order, each once.

    Numbers and times come from one mergeable quantile sketch, a row a task; other values from a
    fixed draw by hash.
    """
    if ranges < 2:
        return []
    kind = df.schema[first].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        shares = [i / ranges for i in range(1, ranges)]
        found = df.agg(F.percentile_approx(col(first), shares, max(10_000, 10 * ranges))).first()[0]
        return sorted(set(found or []))
    drawn = df.select(col(first).alias("v")).where("v IS NOT NULL").distinct()
    rows = drawn.orderBy(F.xxhash64("v")).limit(_DRAWN).collect()
    values = sorted(r.v for r in rows)
    step = max(1, len(values) // ranges)
    return values[step::step][: ranges - 1]


def _range_of(value: Column, borders: list) -> Column:
    """How many borders are below a value, by bisection: as many comparisons as their number has bits."""
    if not borders:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(borders).bit_length() - 1, -1, -1)])
    known = F.array(*[F.lit(b) for b in borders])

    def ahead(state: Column, step: Column) -> Column:
        at, v = state["at"], state["v"]
        return F.struct(F.when(F.get(known, at + step - 1) < v, at + step).otherwise(at).alias("at"), v.alias("v"))

    # The value is part of the state: a lambda over a column would be lost where the optimiser moves it.
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), value.alias("v")), ahead, lambda state: state["at"])


def trailing_zscore(
    df: DataFrame,
    value: str,
    order: list[str],
    series: list[str] | None = None,
    window_size: int = WINDOW_SIZE,
    threshold: float = THRESHOLD,
    ranges: int | None = None,
) -> DataFrame:
    """Score each value against the window that ends with it; ``order`` must be unique per series.

    Every series is cut into ranges of its first order column, so no task has to walk a whole
    series; the borders are literals of the plan, so a lost executor cannot move them. The last
    values of each range lead into those after it: as each range that has rows has at least one, a
    window looks back over at most as many ranges as it has values.
    """
    series = series or []
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = _range_of(col(order[0]), _borders(df, order[0], ranges))
    keys = [col(c) for c in series]
    back = window_size - 1
    names = [f"__s{i}" for i in range(len(series))]

    placed = df.withColumn("__part", part).withColumn("__v", col(value).cast("double"))
    in_range = Window.partitionBy(*keys, "__part").orderBy(*[col(c) for c in order])
    boxed = F.struct("__v")  # a list of plain values would lose the missing ones
    own = placed.withColumn("__own", F.collect_list(boxed).over(in_range.rowsBetween(-back, 0)))
    tails = placed.withColumn("__place", F.row_number().over(
        Window.partitionBy(*keys, "__part").orderBy(*[col(c).desc() for c in order])
    )).where(F.col("__place") <= back)
    tails = tails.groupBy(*[k.alias(n) for k, n in zip(keys, names)], F.col("__part").alias("__p")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("__place")).alias("i"), "__v"))),
            lambda x: F.struct(x["__v"].alias("__v")),
        ).alias("__tail")
    )
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(-back, -1)
    carried = tails.withColumn("__carried", F.flatten(F.collect_list("__tail").over(before))).drop("__tail")

    same = F.col("__part") == F.col("__p")
    for key, name in zip(keys, names):
        same = same & key.eqNullSafe(F.col(name))
    whole = F.concat("__carried", "__own")
    length = F.least(F.size(whole), F.lit(window_size))
    window = F.transform(F.slice(whole, -length, length), lambda x: x["__v"])
    joined = own.join(carried, same).withColumn("__window", window)
    return score(joined, "__window", threshold).drop(
        "__part", "__p", "__v", "__own", "__carried", "__window", *names
    )


def should_run() -> Column:
    """Run on an anomaly or while there is too little history; constant volume does not run."""
    return F.col("anomaly") | F.coalesce(F.col("reason") == NOT_ENOUGH_DATA, F.lit(False))


def arrival_decisions(arrivals: DataFrame, value: str, order: list[str], **options) -> DataFrame:
    """Batch form of the arrival gate: one row per arrival with its score and ``should_run``."""
    scored = trailing_zscore(arrivals, value, order, **options)
    return scored.withColumn("should_run", should_run())
