"""Do the figures of one output occur in another? Compared as sets of numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import numeric_columns, text_columns
from tableinsight.functions.parsing import comma_to_point, stripped, to_number
from tableinsight.names import col

# Compared decimals, size of trivial numbers.
DECIMALS = 2
TRIVIAL = 0.01


@dataclass(frozen=True)
class Reconciliation:
    summary: DataFrame
    inconsistencies: DataFrame


def numbers_in(df: DataFrame, read_text: bool = False) -> DataFrame:
    """Every number of the table, rounded; optionally also text such as ``12,5 %``."""
    values = [col(c).cast("double") for c in numeric_columns(df)]
    if read_text:
        values += [
            to_number(stripped(F.replace(comma_to_point(col(c)), F.lit("%"), F.lit(""))))
            for c in text_columns(df)
        ]
    slots = [v.alias(f"v{i}") for i, v in enumerate(values)]
    long = df.select(*slots).unpivot([], [f"v{i}" for i in range(len(slots))], "slot", "value")
    return long.where(F.col("value").isNotNull()).select(
        F.round("value", DECIMALS).alias("value")
    )


def reconcile_numbers(
    trusted: DataFrame, checked: DataFrame, limit: int | None = None
) -> Reconciliation:
    """Numbers of ``checked`` that ``trusted`` does not contain.

    Both sides meet in one aggregate on the value: repeated numbers collapse before the shuffle
    and nothing is joined.
    """
    tagged = numbers_in(trusted).select("value", F.lit(True).alias("is_trusted")).unionByName(
        numbers_in(checked, read_text=True).select("value", F.lit(False).alias("is_trusted"))
    )
    seen = tagged.groupBy("value").agg(
        F.max("is_trusted").alias("in_trusted"), F.max(~F.col("is_trusted")).alias("in_checked")
    )
    unknown = F.col("in_checked") & ~F.col("in_trusted") & (F.abs("value") > TRIVIAL)
    summary = seen.agg(
        F.count_if("in_trusted").alias("trusted_count"),
        F.count_if("in_checked").alias("checked_count"),
        F.count_if(unknown).alias("inconsistency_count"),
    ).withColumn("passed", F.col("inconsistency_count") == 0)
    values = seen.where(unknown).select("value").orderBy("value")
    return Reconciliation(summary, values if limit is None else values.limit(limit))
