"""CSV input: inferred types, or raw text with encoding and delimiter found per file."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableinsight.names import readable_path, table_name
from tableinsight.sources.files import DELIMITERS, files_with_open_quotes
from tableinsight.sources.records import filled, in_records, records, text_lines, with_quotes

# The delimiter where none is found, and encoding names reported.
DEFAULT_DELIMITER = ","
UTF8, LATIN1 = "utf-8-sig", "latin-1"

_CONSISTENT_SHARE = 0.9
# One dialect for all readers and writers: quotes are doubled inside quotes, spaces are data.
CSV_READ = {
    "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
CSV_WRITE = CSV_READ
_SPARK_ENCODING = {UTF8: "UTF-8", LATIN1: "ISO-8859-1"}


@dataclass(frozen=True)
class LoadedTable:
    name: str
    frame: DataFrame
    row_count: int
    n_columns: int


@dataclass(frozen=True)
class Dialect:
    encoding: str
    delimiter: str
    broken: bool = field(default=False, compare=False)  # whether line breaks are inside quotes


def _types(*schemas: T.StructType) -> T.StructType:
    """One schema for files inferred apart: equal types stay, numbers widen, the rest is text."""
    found: dict[str, T.DataType] = {}
    for field in (f for schema in schemas for f in schema):
        kind = T.LongType() if field.dataType == T.IntegerType() else field.dataType
        other = found.setdefault(field.name, kind)
        if other != kind:
            numbers = isinstance(kind, T.NumericType) and isinstance(other, T.NumericType)
            found[field.name] = T.DoubleType() if numbers else T.StringType()
    return T.StructType([T.StructField(name, kind) for name, kind in found.items()])


def _by_line_breaks(spark: SparkSession, paths: list[str]) -> list[tuple[bool, list[str]]]:
    """The files apart that hold a line break inside quotes: their lines are not their records."""
    broken = files_with_open_quotes(spark, paths)
    if not broken:
        return [(False, paths)]
    listed = spark.read.format("binaryFile").load(paths).select("_metadata.file_path").distinct()
    others = [f for f in (readable_path(r[0]) for r in listed.collect()) if f not in set(broken)]
    return [(True, broken)] + ([(False, others)] if others else [])


class _Files:
    """CSV files of one dialect, all with line breaks inside quotes or all without."""

    def __init__(self, spark: SparkSession, broken: bool, files: list[str], dialect: Dialect) -> None:
        self.spark, self.broken, self.files = spark, broken, files
        self.options = CSV_READ | {
            "sep": dialect.delimiter, "encoding": _SPARK_ENCODING[dialect.encoding], "multiLine": broken,
        }
        self.reader = spark.read.options(**self.options)
        if broken:
            found = records(spark, files, [dialect.delimiter], _SPARK_ENCODING[dialect.encoding])
            self.texts = found.filter("record > 0").select("text")

    def schema(self, infer: bool) -> T.StructType:
        """Names from the first header; types from all records, or all text."""
        if not self.broken:
            return self.reader.option("inferSchema", infer).csv(self.files).schema
        named = self.reader.option("inferSchema", False).csv(self.files[0]).schema  # reads one record
        if not infer:
            return named
        header = self.options["sep"].join('"' + n.replace('"', '""') + '"' for n in named.names)
        texts = self.spark.createDataFrame([(header,)], "text string").unionByName(self.texts)
        strings = getattr(texts._jdf, "as")(self.spark._jvm.org.apache.spark.sql.Encoders.STRING())
        inferring = self.spark.read.options(**self.options).option("inferSchema", True)
        return inferring._df(inferring._jreader.csv(strings)).schema

    def read(self, schema: T.StructType) -> DataFrame:
        if not self.broken:
            return self.spark.read.options(**self.options).schema(schema).csv(self.files)
        kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
        options = {k: str(v) for k, v in self.options.items() if k not in ("header", "encoding")}
        row = F.from_csv("text", kinds, options).alias("row")
        return self.texts.select(row).select(*[F.col("row")[f"c{i}"].alias(f.name) for i, f in enumerate(schema)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row. Without a schema one inference scan finds it; integers become BIGINT
    and times of day stay text. All files are read in splits, line breaks in fields or not."""
    dialect = Dialect(UTF8, DEFAULT_DELIMITER)
    parts = [_Files(spark, broken, files, dialect) for broken, files in _by_line_breaks(spark, [path])]
    if schema is None:
        schema = _types(*[p.schema(infer=True) for p in parts])
    return reduce(DataFrame.unionByName, [p.read(schema) for p in parts])


def load_csv(spark: SparkSession, path: str, name: str | None = None) -> LoadedTable:
    """Register the file as a view named after it and report its size."""
    name = name or table_name(path)
    frame = read_csv(spark, path)
    frame.createOrReplaceTempView(name)
    return LoadedTable(name, frame, frame.count(), len(frame.columns))


def _delimiter_counts(text: Column) -> Column:
    """How often each delimiter occurs; a single byte in either encoding, so bytes are counted."""
    return F.array(*[F.octet_length(text) - F.octet_length(F.replace(text, F.lit(d), F.lit(""))) for d in DELIMITERS])


def _best(records: DataFrame) -> DataFrame:
    """``path, i``: the delimiter that occurs equally often in (nearly) all records, from ``path, counts, lines``."""
    counted = records.select("path", "lines", F.posexplode("counts").alias("i", "n")).groupBy("path", "i", "n").agg(
        F.sum("lines").alias("count")
    )
    per_delimiter = counted.groupBy("path", "i").agg(
        F.max_by("n", F.struct("count", "n")).alias("n"), (F.max("count") / F.sum("count")).alias("share")
    )
    fits = (F.col("n") > 0) & (F.col("share") >= _CONSISTENT_SHARE)
    best = F.max(F.when(fits, F.struct("share", (-F.col("i")).alias("i"))))
    return per_delimiter.groupBy("path").agg((-best["i"]).alias("i"))


def detect_dialects(spark: SparkSession, paths: list[str]) -> dict[str, Dialect]:
    """Encoding and delimiter of each file, from splittable scans of all its lines.

    A file is UTF-8 when all its lines are. Delimiters are counted outside quotes: by line, and in
    files where some line leaves a field open, by record. A file is told by its distribution of
    occurrences: a few rows per delimiter.
    """
    lines = with_quotes(text_lines(spark, paths), DELIMITERS).where(filled())
    # One scan for all: lines that are alike in what is asked of them are one row.
    alike = lines.select(
        "path", _delimiter_counts(F.col("out_closed")).alias("counts"), F.is_valid_utf8("value").alias("utf8"),
        (F.col("to_closed") > 0).alias("broken"),
    ).groupBy("path", "counts", "utf8", "broken").agg(F.count(F.lit(1)).alias("lines"))
    kinds = alike.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("broken").alias("broken"))
    found = kinds.join(_best(alike.select("path", "counts", "lines")), "path", "left")
    rows = found.collect()  # one row per file; the file listing itself is already held by the driver
    delimiters = {r.path: r.i for r in rows}
    if broken := [readable_path(r.path) for r in rows if r.broken]:
        # Counted before lines are put in order, so that no text is moved for it.
        counted = with_quotes(text_lines(spark, broken), DELIMITERS).select(
            "path", "block", "line", "to_closed", "to_open", F.when(filled(), F.lit("x")).otherwise(F.lit("")).alias("value"),
            _delimiter_counts(F.col("out_closed")).alias("closed"), _delimiter_counts(F.col("out_open")).alias("opened"),
        )
        each = in_records(counted).select(
            "path", "record", F.when(F.col("open"), F.col("opened")).otherwise(F.col("closed")).alias("c")
        )
        sums = F.array(*[F.sum(F.col("c")[i]) for i in range(len(DELIMITERS))])
        by_record = each.groupBy("path", "record").agg(sums.alias("counts"), F.lit(1).alias("lines"))
        delimiters |= {r.path: r.i for r in _best(by_record).collect()}
    return {
        readable_path(r.path): Dialect(
            UTF8 if r.utf8 else LATIN1, DEFAULT_DELIMITER if delimiters[r.path] is None else DELIMITERS[delimiters[r.path]],
            r.broken,
        )
        for r in rows
    }


def read_csv_robust(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """One CSV table as text columns, and its encoding; each file of a folder is read in its own."""
    found = detect_dialects(spark, [path])
    encodings = {d.encoding for d in found.values()} or {UTF8}
    frame = _read_dialects(spark, found) if found else _read_text(
        spark, _by_line_breaks(spark, [path]), Dialect(UTF8, DEFAULT_DELIMITER)
    )
    return frame, LATIN1 if LATIN1 in encodings else UTF8


def read_many_robust(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one table in mixed dialects: one scan per dialect, whatever the number of files."""
    return _read_dialects(spark, detect_dialects(spark, paths))


def _read_dialects(spark: SparkSession, found: dict[str, Dialect]) -> DataFrame:
    groups: dict[Dialect, dict[bool, list[str]]] = {}
    for file, dialect in found.items():
        groups.setdefault(dialect, {True: [], False: []})[dialect.broken].append(file)
    frames = [
        _read_text(spark, [(broken, some) for broken, some in files.items() if some], dialect)
        for dialect, files in groups.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _read_text(spark: SparkSession, files: list[tuple[bool, list[str]]], dialect: Dialect) -> DataFrame:
    parts = [_Files(spark, broken, some, dialect) for broken, some in files]
    frames = [p.read(p.schema(infer=False)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
