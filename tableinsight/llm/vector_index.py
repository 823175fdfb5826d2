"""Nearest vectors by an inverted multi-index.

Method. Vectors are cut in two halves, each half quantised by a codebook of its own; a pair of
centroids is a cell. A query visits cells in the order of two sums, one a half: the inner product with
the centroid and, in part, what the vectors around it may add (length of the query's half times their
root mean square distance from it), so long vectors are met whatever their direction. A heap over the
two sorted centroid lists gives that order, until the cells seen hold a given share of all vectors;
what they hold is reranked by the exact inner product in double precision.

The codebooks are fitted on at most ``train_rows`` vectors, chosen by a hash of the id; every vector
is indexed. Cell sizes, at most 1024^2 numbers, are the only other thing the driver sees. For the
stopping rule a crowded cell counts at most four times the mean, so copies of one vector do not use
up a query's share; all its vectors are still compared.

Queries go in packs, vectors in blocks that share a centroid of the first codebook, both of bounded
size. They are joined on that centroid; a task multiplies pack by block as they stream by and keeps
only the nearest of each query of one pack, so its memory does not depend on the table.

Defined results. Vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor do vectors of another length than the commonest (of two, the greater). Rows without an id
take no part; rows that repeat an id are vectors of their own, and a query skips all with its id.
With fewer candidates than asked, all found are returned. No rows in, no rows out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableinsight.llm.common import in_arrow, stored

NEAREST = 20
SHARE = 0.65  # of the vectors, by visited cells
TRAIN_ROWS = 16_384
MOST_CENTROIDS = 1024
QUERY_BLOCK = 1024
GROUP_ROWS = 16_384
VECTOR_BLOCK = 1024
CROWDED = 4
SPREAD = 0.5  # of the greatest addition of vectors at their mean distance from a centroid


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id is not null and v is not null"
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")
    ).first()
    return rows.filter(F.size("v") == (width["d"] if width else -1))


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray
    spreads: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))  # by centroid, root mean squares

    def farness(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries and the centroids of each half what is summed to order cells, nearest smallest."""
        parts = zip((v[:, : self.half], v[:, self.half :]), (self.first, self.second), self.spreads, strict=True)
        return tuple(
            -(q @ c.T) - SPREAD * np.sqrt((q**2).sum(axis=1))[:, None] * spread for q, c, spread in parts
        )

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(v[:, : self.half], self.first), _nearest(v[:, self.half :], self.second)


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, up to a constant of each vector."""
    return (centroids**2).sum(axis=1) - 2 * v @ centroids.T


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return _distances(v, centroids).argmin(axis=1)


def _cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centroids = np.unique(v, axis=0)
    centroids = centroids[np.random.default_rng(0).permutation(len(centroids))[:k]]
    for _ in range(rounds):
        own = _nearest(v, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, x, minlength=len(centroids)) for x in v.T], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def fit(rows: DataFrame, count: int, train_rows: int = TRAIN_ROWS) -> Codebooks:
    """Codebooks of about 5 N^(1/4) centroids each."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(train_rows).select("v").toArrow()
    v = np.array(sample.column("v").to_pylist(), dtype=np.float64)
    k = int(min(MOST_CENTROIDS, max(1, np.ceil(5 * count**0.25)), len(v)))
    half = v.shape[1] // 2 if v.shape[1] > 1 else 1
    return Codebooks(_cluster(v[:, :half], k), _cluster(v[:, half:], k) if v.shape[1] > half else np.zeros((1, 0)))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy().reshape(len(column), -1)


def _placer(books: object) -> object:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v, own = _matrix(batch.column("v")), books.value
            i, j = own.cells(v)
            apart = [((x - c[at]) ** 2).sum(axis=1) for x, c, at in
                     ((v[:, : own.half], own.first, i), (v[:, own.half :], own.second, j))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 *map(pa.array, apart)],
                names=["vec_id", "v", "i", "j", "apart_i", "apart_j"],
            )

    return place


def visit(d1: np.ndarray, d2: np.ndarray, weights: np.ndarray, wanted: float) -> list[int]:
    """Cells (i * columns + j) by the sum of both halves, smallest first, until their weights reach ``wanted``."""
    order1, order2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = np.sort(d1).tolist(), np.sort(d2).tolist()
    reached = [0] * len(a)  # of each row, how many columns are done
    heap = [(a[0] + b[0], 0, 0)]
    cells, seen = [], 0.0
    columns = len(b)
    while heap and seen < wanted:
        _, x, y = heapq.heappop(heap)
        cell = order1[x] * columns + order2[y]
        weight = weights[cell]
        if weight:
            cells.append(cell)
            seen += weight
        reached[x] = y + 1
        # A cell may enter once both its neighbours towards the origin have left.
        if y + 1 < columns and (x == 0 or reached[x - 1] > y + 1):
            heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
        if x + 1 < len(a) and reached[x + 1] == y and (y == 0 or reached[x + 1] > y - 1):
            heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
    return cells


def _router(shared: object) -> object:
    """Queries to packs: (pack, i, vectors, ids, marks) per pack of queries and row of cells they visit."""

    def pack(number: int, queries: list[tuple[int, np.ndarray]], state: tuple) -> Iterator[pa.RecordBatch]:
        books, weights, wanted = state
        rows, columns = len(books.first), len(books.second)
        v = np.stack([x for _, x in queries])
        d1, d2 = books.farness(v)
        visited = np.zeros((len(queries), rows * columns), dtype=bool)
        for q in range(len(queries)):
            visited[q, visit(d1[q], d2[q], weights, wanted)] = True
        ids = np.array([x for x, _ in queries], dtype=np.int64)
        visited = visited.reshape(len(queries), rows, columns)
        for i in np.flatnonzero(visited.any(axis=(0, 2))).tolist():
            who = np.flatnonzero(visited[:, i].any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([i], pa.int32()), pa.array([who.astype(np.int32).tobytes()]),
                 pa.array([ids[who].tobytes()]), pa.array([v[who].tobytes()]),
                 pa.array([np.packbits(visited[who, i], axis=1).tobytes()])],
                names=["pack", "i", "q_rows", "q_ids", "q", "marks"],
            )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, weights, wanted = shared.value
        state = books, weights.tolist(), wanted
        held: list[tuple[int, np.ndarray]] = []
        task, done = 0, 0
        for batch in batches:
            v = _matrix(batch.column("v"))
            for n, query in enumerate(batch.column("vec_id").to_pylist()):
                task = batch.column("task")[n].as_py()
                held.append((query, v[n]))
                if len(held) == QUERY_BLOCK:
                    yield from pack((task << 32) + done, held, state)
                    held, done = [], done + 1
        if held:
            yield from pack((task << 32) + done, held, state)

    return route


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors sorted by (i, salt) to (i, ids, vectors, columns) of at most VECTOR_BLOCK."""
    held: dict[str, list[np.ndarray]] = {"ids": [], "v": [], "j": []}
    row, size = None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        if size:
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()),
                 *(pa.array([np.concatenate(held[c]).tobytes()], pa.binary()) for c in ("ids", "v", "j"))],
                names=["i", "ids", "v", "j"],
            )

    for batch in batches:
        i = batch.column("i").to_numpy()
        parts = {"ids": batch.column("vec_id").to_numpy(), "v": _matrix(batch.column("v")), "j": batch.column("j").to_numpy()}
        at = 0
        while at < len(i):
            if row != i[at] or size == VECTOR_BLOCK:
                yield from flush()
                held, row, size = {"ids": [], "v": [], "j": []}, int(i[at]), 0
            end = min(int(np.searchsorted(i[at:] != row, True)) + at, at + VECTOR_BLOCK - size)
            for c, x in parts.items():
                held[c].append(x[at:end])
            size, at = size + end - at, end
    yield from flush()


def _ranker(columns: int, nearest: int) -> object:
    """Packs joined to vectors, sorted by pack: the nearest of each query among a task's vectors.

    A matrix product finds which pairs can still enter; those are scored again term by term, so
    equal vectors have equal scores wherever they stand.
    """

    def entering(q: np.ndarray, v: np.ndarray, allowed: np.ndarray, least: np.ndarray) -> tuple:
        rough = np.where(allowed, q @ v.T, -np.inf)
        if v.shape[0] > nearest:
            least = np.maximum(least, -np.partition(-rough, nearest - 1, axis=1)[:, nearest - 1])
        slack = 1e-9 * np.sqrt((q**2).sum(axis=1)) * np.sqrt((v**2).sum(axis=1).max())
        row, column = np.nonzero(allowed & (rough >= (least - slack)[:, None]))
        score = np.concatenate(
            [np.zeros(0)] + [(q[row[a : a + 65536]] * v[column[a : a + 65536]]).sum(axis=1)
                             for a in range(0, len(row), 65536)]
        )
        return row, column, score

    def keep(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        row, score, vec = found
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return tuple(x[place < nearest] for x in (row, score, vec))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, best = None, (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))
        names: dict[int, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            row, score, vec = best
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), pack)), pa.array(row),
                     pa.array(np.array([names[r] for r in row.tolist()], dtype=np.int64)), pa.array(vec), pa.array(score)],
                    names=["pack", "q_row", "query_id", "vec_id", "score"],
                )

        for batch in batches:
            for n in range(len(batch)):
                x = {c: batch.column(c)[n] for c in batch.schema.names}
                if x["pack"].as_py() != pack:
                    yield from flush()
                    pack, best, names = x["pack"].as_py(), tuple(y[:0] for y in best), {}
                who = np.frombuffer(x["q_rows"].as_buffer(), np.int32)
                q_ids = np.frombuffer(x["q_ids"].as_buffer(), np.int64)
                ids = np.frombuffer(x["ids"].as_buffer(), np.int64)
                q = np.frombuffer(x["q"].as_buffer()).reshape(len(who), -1)
                v = np.frombuffer(x["v"].as_buffer()).reshape(len(ids), -1)
                marks = np.frombuffer(x["marks"].as_buffer(), np.uint8).reshape(len(who), -1)
                marks = np.unpackbits(marks, axis=1, count=columns).astype(bool)
                allowed = marks[:, np.frombuffer(x["j"].as_buffer(), np.int32)] & (q_ids[:, None] != ids[None, :])
                names.update(zip(who.tolist(), q_ids.tolist(), strict=True))
                least = np.full(max(int(who.max()) + 1, QUERY_BLOCK), -np.inf)
                full = np.bincount(best[0], minlength=len(least)) >= nearest
                worst = np.full(len(least), np.inf)
                np.minimum.at(worst, best[0], best[1])
                least[full] = worst[full]
                row, column, score = entering(q, v, allowed, least[who])
                best = keep(tuple(map(np.concatenate, zip(best, (who[row], score, ids[column]), strict=True))))
        yield from flush()

    return rank


def _spreads(index: DataFrame, side: str, centroids: int) -> np.ndarray:
    """Root mean square distance of vectors from their centroid of one half; a number a centroid."""
    out = np.zeros(centroids)
    for r in index.groupBy(side).agg(F.sqrt(F.avg(f"apart_{side}")).alias("spread")).collect():
        out[r[side]] = r.spread
    return out


def search(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, share: float = SHARE,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The nearest found of each query: query_id, rank, vec_id, score. ``is_query`` is over vec_id."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    result = "pack long, q_row int, query_id long, vec_id long, score double"
    rows = stored(usable(vectors), "vectors")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(rows, count, train_rows)
    placed = "vec_id long, v array<double>, i int, j int, apart_i double, apart_j double"
    index = stored(in_arrow(rows, _placer(context.broadcast(books)), placed), "vector-index")
    books = replace(books, spreads=tuple(
        _spreads(index, side, len(c)) for side, c in (("i", books.first), ("j", books.second))
    ))
    columns = len(books.second)
    sizes = np.zeros(len(books.first) * columns)
    for r in index.groupBy("i", "j").count().toLocalIterator():
        sizes[r["i"] * columns + r["j"]] = r["count"]
    weights = np.minimum(sizes, CROWDED * sizes[sizes > 0].mean())
    queries = rows.filter(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packs = in_arrow(
        queries.repartition(blocks).withColumn("task", F.spark_partition_id().cast("long")),
        _router(context.broadcast((books, weights, share * weights.sum()))),
        "pack long, i int, q_rows binary, q_ids binary, q binary, marks binary",
    )
    # Rows of many vectors are packed by several tasks.
    per_row = sizes.reshape(-1, columns).sum(axis=1)
    salts = F.element_at(F.array(*[F.lit(int(-(-n // GROUP_ROWS) or 1)) for n in per_row]), F.col("i") + 1)
    salted = index.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts))
    packed = in_arrow(
        salted.repartition("i", "salt").sortWithinPartitions("i", "salt").select("vec_id", "v", "i", "j"),
        _packer, "i int, ids binary, v binary, j binary",
    )
    met = stored(packs, "query-packs").join(stored(packed, "vector-packs"), "i").sortWithinPartitions("pack")
    found = in_arrow(met.drop("i"), _ranker(columns, nearest), result)
    in_order = W.partitionBy("pack", "q_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score"
    )
