"""Output: spreadsheet-safe CSV per source file, and the tables of a report."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tableinsight.names import unique
from tableinsight.operators.neutralize import neutralize_formulas
from tableinsight.operators.profile import describe
from tableinsight.sources.csv import CSV_WRITE

# Suffix of cleaned files and texts of the report.
CLEANED_SUFFIX = "_nettoye"
REPORT_TITLE = "# Rapport d'analyse : {timestamp}"
REPORT_QUESTION = "**Question :** {question}"
REPORT_SOURCE = "- {name} : {rows} lignes"
REPORT_SECTION = "## Analyse"


def export_names(files: Iterable[str]) -> list[str]:
    """``name_nettoye`` per source file: no path parts, no clash whatever the letter case."""
    stems = [
        re.sub(r"\.csv$", "", posixpath.basename(f.replace("\\", "/")), flags=re.IGNORECASE)
        for f in files
    ]
    return unique(stem + CLEANED_SUFFIX for stem in stems)


def write_cleaned(files: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV dataset per source file under ``folder``; returns the dataset paths."""
    paths = [f"{folder}/{name}" for name in export_names(files)]
    for path, frame in zip(paths, files.values()):
        neutralize_formulas(frame).write.options(**CSV_WRITE).csv(path)
    return paths


def write_described(files: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Per source file its data and its descriptive statistics, as datasets side by side."""
    paths = []
    for name, frame in zip(export_names(files), files.values()):
        tables = {"data": frame} | {f"stats_{k}": t for k, t in describe(frame).items()}
        paths += write_tables(tables, f"{folder}/{name}", fmt).values()
    return paths


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Each report table as a dataset; tables with a dimension are partitioned by it."""
    paths = {}
    for name, frame in tables.items():
        paths[name] = f"{folder}/{name}"
        # Only a spreadsheet reads formulas; other formats keep the values as they are.
        safe = neutralize_formulas(frame) if fmt == "csv" else frame
        writer = safe.write.mode("overwrite").format(fmt)
        if name == "drivers":
            writer = writer.partitionBy("dimension")
        if fmt == "csv":
            writer = writer.options(**CSV_WRITE)
        writer.save(paths[name])
    return paths


def markdown_report(
    question: str, sources: dict[str, int], findings: Iterable[str], timestamp: str
) -> str:
    """Question, source sizes and findings; all of it already aggregated."""
    lines = [
        REPORT_TITLE.format(timestamp=timestamp),
        "",
        REPORT_QUESTION.format(question=question),
        "",
        *[REPORT_SOURCE.format(name=name, rows=n) for name, n in sources.items()],
        "",
        REPORT_SECTION,
        "",
        *[f"- {finding}" for finding in findings],
    ]
    return "\n".join(lines)


def write_markdown(spark: SparkSession, text: str, path: str) -> None:
    """A small text through Spark's own writer, so any file system Spark reaches will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
