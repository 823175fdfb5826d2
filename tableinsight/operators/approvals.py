"""Runs waiting for a decision, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"


def resolve(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Give each run its decided status; a run decided twice keeps the first decision."""
    first = decisions.groupBy("run_id").agg(F.min_by("decision", "decided_at").alias("decision"))
    return runs.join(first, "run_id", "left").select(
        *[c for c in runs.columns if c != "status"],
        F.when(F.col("status") == PENDING, F.coalesce("decision", "status"))
        .otherwise(F.col("status"))
        .alias("status"),
    )


def unknown_decisions(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(runs, "run_id", "left_anti")
