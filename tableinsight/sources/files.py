"""Row counts per file or folder of files, without loading the rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.names import readable_path
from tableinsight.sources.records import filled, record_counts, text_lines, with_quotes

# File kinds the arrival folder accepts.
EXTENSIONS = [".csv", ".parquet", ".json"]
# Delimiters looked for, in order of preference.
DELIMITERS = [",", ";", "\t", "|"]

COUNT_SCHEMA = "path string, n bigint"


def extension(path: str) -> str:
    dot = path.rfind(".")
    return path[dot:].lower() if dot > path.rfind("/") else ""


def _per_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _by_quotes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per CSV file its filled lines and how many of them leave a field open that they opened."""
    lines = with_quotes(text_lines(spark, paths), DELIMITERS)
    return lines.where(filled()).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("to_closed").alias("open_quotes")
    )


def files_with_open_quotes(spark: SparkSession, paths: list[str]) -> list[str]:
    """The CSV files in which some field holds a line break; a list of files, as the driver has."""
    found = _by_quotes(spark, paths).where("open_quotes > 0").select("path")
    return [readable_path(r.path) for r in found.collect()]


def csv_row_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records per CSV file, header excluded, so a file with only a header counts 0.

    All scans are splittable. Only files where some line leaves a quote open can have line breaks
    inside a field; those alone are scanned again with the quotes followed from line to line.
    """
    lines = _by_quotes(spark, paths)
    quoted = [readable_path(r.path) for r in lines.where("open_quotes > 0").select("path").collect()]
    counts = lines.where("open_quotes = 0").select("path", "n")
    if quoted:
        counts = counts.unionByName(record_counts(with_quotes(text_lines(spark, quoted), DELIMITERS)))
    return counts.select("path", (F.col("n") - 1).alias("n"))


def _with_empty(spark: SparkSession, paths: list[str], counts: DataFrame) -> DataFrame:
    """Readable files without a row count 0; the listing reads no content."""
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))
    return listed.join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def _spelled(spark: SparkSession, path: str) -> str:
    """A path as a whole URI, percent-encoded as in file metadata."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return re.sub("^file:/+", "file:///", whole.toUri().toString())


def _per_path(spark: SparkSession, paths: list[str], counts: DataFrame) -> DataFrame:
    """The files of a folder that was asked for count as one; a file found by a pattern stays on its own."""
    asked = spark.createDataFrame([(p,) for p in {_spelled(spark, p) for p in paths}], "above string")
    # Local paths begin with one slash or three, by who spells them.
    local = F.regexp_replace("path", "^file:/+", "file:///")
    parts = F.split(local, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    # All that match begin the same path, so the largest is the longest.
    owned = counts.select("path", "n", F.explode(above).alias("above")).join(
        asked.withColumn("asked", F.col("above")), "above", "left"
    ).groupBy("path").agg(F.max("asked").alias("asked"), F.first("n").alias("n"))
    folder = F.when(F.col("asked") != local, F.col("asked"))  # a file keeps its path to the letter
    return owned.groupBy(F.coalesce(folder, "path").alias("path")).agg(F.sum("n").alias("n"))


def file_row_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, n)`` for CSV, Parquet and JSON-lines files, each read as what it is; one row for a folder."""
    by_kind: dict[str, list[str]] = {}
    for path in paths:
        by_kind.setdefault(extension(path.rstrip("/")), []).append(path)
    frames = []
    if csv := by_kind.get(".csv"):
        frames.append(csv_row_counts(spark, csv))
    if parquet := by_kind.get(".parquet"):
        # No column is read, only the row counts in the footers, so the schemas may differ.
        counts = _per_file(spark.read.schema("unread int").parquet(*parquet))
        frames.append(_with_empty(spark, parquet, counts))
    if json := by_kind.get(".json"):
        filled = spark.read.text(json).where(F.length(F.trim("value")) > 0)
        frames.append(_with_empty(spark, json, _per_file(filled)))
    if not frames:
        return spark.createDataFrame([], COUNT_SCHEMA)
    return _per_path(spark, paths, reduce(DataFrame.unionByName, frames))
