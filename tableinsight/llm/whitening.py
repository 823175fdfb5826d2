"""Whiten embedding vectors: distributed block matrices for scatter and projection, a local eigensolver.

Method. Entries become whole numbers, so equal vectors are equal and sums are exact. The fit list
holds each distinct vector once. Its centred rows get row numbers and are cut into the blocks of a
Spark ``BlockMatrix`` A; the scatter matrix is A transposed times A, one small local matrix.
``numpy.linalg.eigh`` gives its components, and A times the whitening matrix projects rows. The
covariance of the projected fit list, again a block product, says how far it is from the identity.

Blocks of one product are dealt over many middle ranges, so no task multiplies more than a few of
them. Rows are taken in bands: the driver keeps one key a block while it plans a product, and a
band bounds how many. Otherwise the driver sees d x d numbers, d the number of dimensions, and one
row count a partition. Centred rows come from n * x - S, which is exact, divided once.

Defined results. A null vector, one with a null or non-finite entry, or with an entry beyond
``MOST`` either way is left out, and so is one whose length is not the commonest (of lengths equally
common, the smallest) or is nothing. Repeated vectors and ids keep their rows; in the fit list a
vector counts once. Components without variance (below ``FLAT`` of the largest) are left out: with
one distinct vector nothing is returned. A deviation beyond a long is null. Null ids are kept. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseVector, VectorUDT
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tableinsight.llm.common import in_arrow, numbered

SCALE, SHIFT = 64, 1_000_000
MOST = float(1 << 30)  # entries beyond it have no exact sums
COMPONENTS = 16
FLAT = 1e-12
BLOCK_BYTES = 1 << 21
BLOCK_COLUMNS = 1024
BAND_BLOCKS = 1 << 16  # blocks of one product, which the driver has keys of
BLOCKS_PER_TASK = 4

_OUT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: vectors of the commonest length as arrays of whole numbers."""
    c = F.col(vector)
    fine = F.forall(c, lambda e: F.coalesce(F.abs(e.cast("double")) <= MOST, F.lit(False)))
    usable = table.filter((F.size(c) > 0) & fine)  # a NaN compares above all numbers
    lengths = usable.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    common = lengths.collect()
    d = common[0].d if common else 0
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE) + SHIFT)
    return usable.filter(F.size(c) == d).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _sums(fit: DataFrame) -> np.ndarray:
    """Exact sums of the entries, by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            if len(batch):
                total = total + _matrix(batch, "x").sum(axis=0)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"s": [total]}, schema=pa.schema([("s", pa.list_(pa.int64()))]))

    parts = in_arrow(fit.select("x"), add, "s array<long>")
    rows = parts.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return np.array([r.s for r in sorted(rows)], dtype=np.int64)


def _squares(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond a long."""
    rough = (apart.astype(np.float64) ** 2).sum(axis=1)
    if rough.max(initial=0.0) < 2.0**62:
        return (apart**2).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    return [v if v < 1 << 63 else None for v in exact]


def _centred(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """All columns but x, with ``centred`` (x - S/n) and ``deviation`` (the sum of (n * x - S)^2)."""
    kept = [c for c in rows.columns if c != "x"]

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = n * _matrix(batch, "x") - sums if len(batch) else np.zeros((0, len(sums)), dtype=np.int64)
            ends = np.arange(len(apart) + 1, dtype=np.int32) * len(sums)
            centred = pa.ListArray.from_arrays(pa.array(ends), pa.array((apart / n).reshape(-1)))
            squares = pa.array(_squares(apart), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), centred, squares], names=[*kept, "centred", "deviation"]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", centred array<double>, deviation long"
    return in_arrow(rows, centre, schema)


def _blocks(rows: DataFrame, n: int, d: int, row_block: int) -> BlockMatrix:
    """Centred rows as a block matrix; ``_index`` counts them from 0."""
    dense = rows.select(F.col("_index").alias("index"), array_to_vector("centred").alias("v"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(dense, "v"), n, d)
    return matrix.toBlockMatrix(row_block, BLOCK_COLUMNS)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, its middle dimension dealt over so many ranges."""
    model = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def _gram(matrix: BlockMatrix, splits: int) -> np.ndarray:
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


class Bands:
    """Numbered rows in runs of at most so many blocks."""

    def __init__(self, rows: DataFrame, starts: list[tuple[int, int]], total: int, d: int, most: int) -> None:
        self.rows, self.starts, self.total = rows, starts, total
        self.row_block = max(16, BLOCK_BYTES // (8 * d))
        self.size = self.row_block * most
        spark = rows.sparkSession
        self.ahead = spark.createDataFrame(starts, "_part int, _ahead long")

    def __iter__(self) -> Iterator[tuple[DataFrame, int]]:
        """Rows of each band with ``_index`` in the band, and how many there are."""
        for low in range(0, self.total, self.size):
            high = min(low + self.size, self.total)
            parts = [p for p, start in self.starts if start < high]
            first = max((p for p, start in self.starts if start <= low), default=0)
            near = self.rows.filter(F.col("_part").between(first, max(parts)))
            at = F.col("_ahead") + F.col("_row") - low
            placed = near.join(F.broadcast(self.ahead), "_part").withColumn("_index", at)  # one row a partition
            yield placed.filter(F.col("_index").between(0, high - low - 1)).drop("_part", "_row", "_ahead"), high - low

    def splits(self, n: int) -> int:
        return max(1, -(-n // (self.row_block * BLOCKS_PER_TASK)))


def _whitening(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, list[float]]:
    """Columns that project to unit variance, and each one's share of the whole variance."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = [i for i in order if values[i] > FLAT * values[-1]]
    scale = np.sqrt(values[order]) if order else np.zeros(0)
    return vectors[:, order] / scale, (values[order] / np.trace(covariance)).tolist()


def _projection(spark: SparkSession, w: np.ndarray) -> BlockMatrix:
    """The d x k matrix; its rows are dealt like the columns of the blocks."""
    schema = StructType([StructField("index", LongType()), StructField("v", VectorUDT())])
    rows = spark.createDataFrame([(i, DenseVector(r)) for i, r in enumerate(w)], schema)
    return IndexedRowMatrix(rows, *w.shape).toBlockMatrix(BLOCK_COLUMNS, BLOCK_COLUMNS)


def whiten(
    table: DataFrame, vector: str = "embedding", components: int = COMPONENTS, band_blocks: int = BAND_BLOCKS
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row."""
    spark = table.sparkSession
    rows = whole_vectors(table, vector)
    empty = spark.createDataFrame([], _OUT.format(dict(table.dtypes)["vec_id"]))
    fit, starts, n = numbered(rows.select("x").groupBy("x").agg(F.lit(1).alias("_one")).select("x"), "whitening-fit")
    if n == 0:
        return empty
    sums = _sums(fit)
    bands = Bands(_centred(fit, n, sums), starts, n, len(sums), band_blocks)

    def matrices(of: Bands) -> Iterator[tuple[DataFrame, BlockMatrix, int]]:
        for band, size in of:
            yield band, _blocks(band, size, len(sums), of.row_block), of.splits(size)

    w, explained = _whitening(sum(_gram(a, splits) for _, a, splits in matrices(bands)), n, components)
    if not explained:
        return empty
    projection = _projection(spark, w)
    covariance = sum(_gram(_product(a, projection, 1), splits) for _, a, splits in matrices(bands)) / n
    error = float(np.abs(covariance - np.eye(len(explained))).max())

    kept, starts, total = numbered(rows, "whitening-rows")
    every = Bands(_centred(kept, n, sums), starts, total, len(sums), band_blocks)
    out = [_rows_of(band, _product(a, projection, 1)) for band, a, _ in matrices(every)]
    whole = reduce(DataFrame.unionByName, out)
    shares = F.array(*[F.lit(e) for e in explained])
    return whole.select(
        "vec_id", (F.col("_pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("_pos")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def _rows_of(band: DataFrame, projected: BlockMatrix) -> DataFrame:
    """Rows of a band beside what they were projected to, one row a component."""
    model = projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    vectors = callMLlibFunc("getIndexedRows", model).toDF("_index", "_v")
    found = band.select("vec_id", "deviation", "_index").join(vectors, "_index")
    return found.select("vec_id", "deviation", F.posexplode(vector_to_array("_v")).alias("_pos", "whitened"))
