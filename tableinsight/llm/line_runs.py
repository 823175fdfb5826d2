"""Line dedup on levelled sorted runs of line hashes.

Method. The corpus arrives in batches. Each batch is reduced to one entry per line key and merged
with the sorted runs before it: keys the runs already hold are marked as seen, the others are first
seen here, and the batch is added as a run of its own, sorted by key. Whenever a level holds
``fanout`` runs they are compacted into one run of the next level, so an entry is rewritten once per
level and a batch meets only logarithmically many runs. Batches go from the largest ids to the
smallest, so the first run that holds a key names the document that keeps it.

Defined results. A null or empty text is one empty line. Documents are rows: two rows with one
doc_id count as two, and a line stays in every row that has the keeping doc_id. A null doc_id sorts
below all others. No rows in, no rows out. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.llm.common import ascii_lower, in_arrow, stored

SPACE = " \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
FANOUT = 3


class LineRuns:
    """Sorted runs of (key, n, first, owner) by level; all runs are files in the shared folder."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, entries: DataFrame) -> DataFrame:
        """Merge a batch of (key, n, owner), one row a key, with the runs; returns its own run.

        ``first`` is true for keys that no earlier run holds.
        """
        if runs := self.runs():
            seen = reduce(DataFrame.union, runs).filter("first").select(F.col("key").alias("seen"))
            entries = entries.join(seen, F.col("key") == F.col("seen"), "left")
            entries = entries.select("key", "n", F.col("seen").isNull().alias("first"), "owner")
        else:
            entries = entries.select("key", "n", F.lit(True).alias("first"), "owner")
        run = stored(entries.sort("key"), "line-run")
        self._push(run, 0)
        return run

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        return _merge(self.runs())

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            whole = stored(_merge(self.levels[level]).sort("key"), f"line-run-{level + 1}")
            self.levels[level] = []
            self._push(whole, level + 1)


def _merge(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, runs).groupBy("key").agg(
        F.sum("n").alias("n"),
        F.max("first").alias("first"),
        F.max(F.when(F.col("first"), F.col("owner"))).alias("owner"),
    )


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, key): the distinct keys of each document, as MD5 of the normalised line."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(SPACE))))
    long = F.filter(keys, lambda k: F.char_length(k) >= least_chars)
    digests = F.array_distinct(F.transform(long, lambda k: F.md5(k.cast("binary"))))
    return docs.select("doc_id", F.explode(digests).alias("key")).select(
        "doc_id", F.unhex("key").alias("key")
    )


def _batches(keys: DataFrame, batches: int) -> Iterator[DataFrame]:
    """The rows in ranges of doc_id, largest ids first, null ids with the smallest."""
    cuts = keys.select(
        F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("cuts")
    ).first()["cuts"]
    bounds = sorted(set(cuts or []), reverse=True)
    doc = F.col("doc_id")
    for i, low in enumerate(bounds):
        yield keys.filter((doc > low) if i == 0 else (doc > low) & (doc <= bounds[i - 1]))
    yield keys.filter(doc.isNull() | (doc <= bounds[-1])) if bounds else keys


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the lines whose key is listed; (doc_id, text, drop) to (doc_id, n_lines, n_dropped, kept)."""
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for text, drop in zip(batch.column("text"), batch.column("drop"), strict=True):
            lines = (text.as_py() or "").split("\n")
            gone = set(drop.as_py() or ())
            kept = lines
            if gone:
                kept = [
                    x for x in lines
                    if hashlib.md5(x.encode().strip(SPACE.encode()).lower()).digest() not in gone
                ]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, columns, (pa.int64(), pa.int64(), pa.string()))],
            names=["doc_id", "n_lines", "n_dropped", "kept"],
        )


def dedup_lines(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    least_chars: int = LEAST_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (the text without the dropped lines)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = stored(line_keys(docs, least_chars), "line-keys")
    runs = LineRuns(fanout)
    for batch in _batches(keys, batches):
        runs.add(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner")))
    common = stored(runs.merged().filter(F.col("n") >= least_docs).select("key", "owner"), "line-common")
    drops = (
        keys.join(common, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.collect_set("key").alias("drop"))
    )
    marked = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "drop")
    return in_arrow(marked, _without, "doc_id long, n_lines long, n_dropped long, kept string")

