"""The whole analysis of one table or one join tree, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import first_date_column, id_column
from tableinsight.operators.drivers import NO_FINDING_TEXT, DriverAnalysis, driver_analysis
from tableinsight.operators.drivers import findings as driver_findings
from tableinsight.operators.inspection import (
    inspection_summary,
    table_totals,
    validation_checks,
)
from tableinsight.operators.joins import diagnose_join, join_tables, source_row_counts
from tableinsight.operators.metric import Metric, entity_metric
from tableinsight.sources.export import markdown_report, write_markdown, write_tables


@dataclass(frozen=True)
class Analysis:
    inspection: DataFrame
    metric: Metric
    drivers: DriverAnalysis
    validation: DataFrame
    join_diagnosis: DataFrame | None = None
    join_sources: DataFrame | None = None
    held: DataFrame | None = None  # the joined rows, kept until release()

    def release(self) -> None:
        """Let go of the joined rows once the results have been used."""
        if self.held is not None:
            self.held.unpersist()

    def tables(self) -> dict[str, DataFrame]:
        tables = {
            "inspection": self.inspection,
            "metric": self.metric.frame,
            "drivers": self.drivers.breakdown,
            "driver_tests": self.drivers.tests,
            "validation": self.validation,
        }
        if self.join_diagnosis is not None:
            tables["join_diagnosis"] = self.join_diagnosis
        if self.join_sources is not None:
            tables["join_sources"] = self.join_sources
        return tables


def analyze(
    df: DataFrame,
    id_col: str | None = "auto",
    date_col: str | None = "auto",
    dimensions: list[str] | None = None,
    join_diagnosis: DataFrame | None = None,
) -> Analysis:
    """Inspect, build the metric, test the drivers, validate. Each part scans only its columns.

    Finding duplicates groups by the whole row, the one expensive shuffle here; it is run once and
    its single row of totals serves inspection and validation.
    """
    entity, date = id_column(df, id_col), first_date_column(df, date_col)
    totals = table_totals(df, entity)
    totals = df.sparkSession.createDataFrame(totals.collect(), totals.schema)
    return Analysis(
        inspection_summary(df, entity, totals),
        entity_metric(df, entity, date),
        driver_analysis(df, entity, dimensions),
        validation_checks(df, entity, date, totals),
        join_diagnosis,
    )


def analyze_joined(tables: dict[str, DataFrame], spec: dict, **options) -> Analysis:
    """Analyze the joined tables; the join diagnosis is computed from key counts alone.

    Every part of the analysis reads the joined rows, so the join runs once and its rows are kept
    on the executors' memory and disks until ``release()``; lost ones are joined again.
    """
    joined = join_tables(tables, spec).persist(StorageLevel.MEMORY_AND_DISK)
    analysis = analyze(joined, join_diagnosis=diagnose_join(tables, spec), **options)
    return replace(analysis, join_sources=source_row_counts(tables), held=joined)


def write_report(
    analysis: Analysis,
    folder: str,
    question: str,
    sources: dict[str, int],
    timestamp: str,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Write every table once, then a short text report read back from the small test table."""
    paths = write_tables(analysis.tables(), folder, fmt)
    spark = analysis.inspection.sparkSession
    reader = spark.read.option("header", True).option("inferSchema", True)
    # One row per tested dimension.
    tests = reader.format(fmt).load(paths["driver_tests"]).orderBy("dimension")
    sentences = [r.finding for r in driver_findings(tests.withColumn(
        "significant", F.col("significant").cast("boolean"))).collect()]
    lines = [analysis.metric.label, *sentences] or [NO_FINDING_TEXT]
    paths["report"] = f"{folder}/report"
    write_markdown(spark, markdown_report(question, sources, lines, timestamp), paths["report"])
    return paths
