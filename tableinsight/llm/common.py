"""Helpers the operators share: reading tables, durable intermediates, fold numbers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableinsight.llm import bytetext
from tableinsight.session import fresh_path

_shipped: set[str] = set()
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH_BYTES = 4 << 20  # an Arrow batch is whole several times, in the JVM and in the worker
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    Cuts the lineage: what is read no longer depends on any executor, and what was shuffled for it
    goes once it is written.
    """
    path = fresh_path(frame.sparkSession, label)
    conf = frame.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    for paths in _scopes.get():
        paths.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, label: str) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """Rows stored with ``_part`` and ``_row``, the first row number of each part, and the number of rows.

    Parts and rows are those of the partitions as they were written, so they hold for all readers.
    The driver gets one count a partition.
    """
    at = F.monotonically_increasing_id()
    written = stored(frame.withColumn("_at", at), label)
    kept = written.select(
        *frame.columns, F.shiftright("_at", 33).cast("int").alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    counts = sorted(tuple(r) for r in kept.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    return kept, starts, total


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at the end what ``stored`` wrote meanwhile, but for the paths taken off the list given."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in map(hadoop, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def in_arrow(
    frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object
) -> DataFrame:
    """``mapInArrow`` after the package's source was sent to the executors, once per application.

    Batches end at ``BATCH_BYTES``, a row at least, unless the session has a limit of its own.
    """
    context, conf = frame.sparkSession.sparkContext, frame.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, BATCH_BYTES)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return frame.mapInArrow(whole, schema)


def give_back() -> None:
    """Free memory to the system: workers are kept for later tasks, and so would be what they freed."""
    bytetext.forget_long()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns, and all others out of the way in ``_row``, whatever their names."""
    others = [c for c in docs.columns if c not in own]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*own, row.alias("_row"))


def unpacked(frame: DataFrame, docs: DataFrame, own: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` again, those in ``own`` as given."""
    return frame.select(*[(own[c] if c in own else F.col("_row")[c]).alias(c) for c in docs.columns])


def with_length(docs: DataFrame, changed: Column, text: Column) -> dict[str, Column]:
    """``n_chars``, where documents have one, after their text has changed."""
    kinds = dict(docs.dtypes)
    if "n_chars" not in kinds:
        return {}
    old = F.col("_row")["n_chars"]
    return {"n_chars": F.when(changed, F.length(text)).otherwise(old).cast(kinds["n_chars"])}
