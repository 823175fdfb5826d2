"""Many files in one go: read robustly, clean, describe, export; a bad file does not stop the others."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.operators.clean import clean
from tableinsight.sources.csv import read_csv_robust
from tableinsight.sources.export import export_names, write_cleaned, write_described

# Outcomes of a file.
DONE, FAILED = "ok", "erreur"
_SCHEMA = "file string, status string, n_rows bigint, n_columns int, encoding string, error string"


def process_files(
    spark: SparkSession, files: list[str], folder: str,
    read: Callable[[SparkSession, str], tuple[DataFrame, str]] = read_csv_robust, width: int = 4,
) -> DataFrame:
    """One row per file with its outcome. Cleaned CSV goes to ``folder/csv``, data and statistics as
    Parquet to ``folder/tables``. ``width`` files are worked on at a time. A file's cleaned rows are
    kept on the executors' memory and disks while its outputs are written, so cleaning runs once.
    """

    def one(file: str, name: str) -> tuple:
        try:
            raw, encoding = read(spark, file)
            cleaned = clean(raw).frame.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                # The name is unique among all files, so it stands for the file.
                write_cleaned({name: cleaned}, f"{folder}/csv")
                write_described({name: cleaned}, f"{folder}/tables")
                n = cleaned.agg(F.count(F.lit(1))).first()[0]
            finally:
                cleaned.unpersist()
            return file, DONE, n, len(cleaned.columns), encoding, None
        except (PySparkException, Py4JJavaError) as error:
            return file, FAILED, None, None, None, str(error).split("\n", 1)[0]

    with ThreadPoolExecutor(max(1, width)) as threads:
        rows = list(threads.map(one, files, export_names(files)))
    return spark.createDataFrame(rows, _SCHEMA)
