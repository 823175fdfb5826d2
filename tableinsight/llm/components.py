"""Connected components of a graph of links, without gathering any component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.llm.common import in_arrow, stored

FOREST_EDGES = 1 << 18  # edges a task holds at a time


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    low = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge has u > v here."""
    low = _minima(edges)
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def _least_of_each(edges: dict[tuple, None]) -> dict:
    """The smallest node that each node is joined with by these edges."""
    above = {}

    def root(node):
        path = []
        while (up := above.setdefault(node, node)) != node:
            path.append(node)
            node = up
        above.update(dict.fromkeys(path, node))
        return node

    for u, v in edges:
        low, high = sorted((root(u), root(v)))
        above[high] = low
    return {node: root(node) for node in above}


def _forester(batches: Iterator[pa.RecordBatch], most: int, roots: bool) -> Iterator[pa.RecordBatch]:
    """Edges to the smallest node of what a run of ``most`` edges joins, never more than came in; and
    with ``roots`` one from that node to itself."""

    def out(edges: dict[tuple, None]) -> pa.RecordBatch:
        stars = [(u, v) for u, v in _least_of_each(edges).items() if roots or u != v]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in stars], kind) for k in (0, 1)], names=["u", "v"])

    held: dict[tuple, None] = {}
    for batch in batches:
        kind = batch.column("u").type
        held.update(dict.fromkeys(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)))
        if len(held) >= most:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def _forests(edges: DataFrame, roots: bool = False) -> DataFrame:
    work = partial(_forester, most=FOREST_EDGES, roots=roots)
    return in_arrow(edges.select("u", "v"), work, edges.select("u", "v").schema)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down at most, and none where another ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter(
        "down + up > 1"
    ).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes of (a, b) links.

    What the edges of a task join is joined in it. If fewer than ``FOREST_EDGES`` edges are left by
    that, one more forest has them all and is the result. Else large-star and small-star rounds
    until all components are stars: a few shuffles of the links each, their number grows with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    edges = stored(_forests(links.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    if edges.count() < FOREST_EDGES:
        return _forests(edges.coalesce(1), roots=True).select(F.col("u").alias("node"), F.col("v").alias("root"))
    while not _stars(edges):
        edges = stored(_forests(_small_star(_large_star(edges))), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
