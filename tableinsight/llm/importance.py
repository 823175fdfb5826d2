"""Draw documents that look like a target text: importance resampling on hashed word n-grams.

Method. Texts are worked on as UTF-8 bytes. One 256-byte table lower-cases A to Z and blanks every
separator, ``bytes.split`` gives the words, and a chain of ``zlib.crc32`` calls, each started with
the sum of the run before it, gives the checksum of every run of words: one call adds one word. A
run's bucket is its checksum modulo the number of buckets. Each task counts buckets in a Counter
and gives one row a bucket; Spark adds them up. So both texts become one number a bucket, and a
bucket's gain is the logarithm of how much likelier the target has it, both smoothed by one. A
second pass adds the gains of each document's runs and a Gumbel draw that depends on seed and id
alone, so the highest scores are a sample without replacement in proportion to exp(weight).

Ranks come from a sort by range of narrow rows: ranges are written to the shared folder, counted,
and each starts where those before it end. No window and no task sees all documents.

What reaches the driver has a bound: one count a bucket and one a range. A long text is worked on
in windows of about a megabyte that end between words.

Defined results. A null or wordless text has no runs, weight 0 and no rank. A null id draws as an
empty text and comes after all others among equal scores. Repeated rows are scored and ranked each
for itself; rows alike in score, id and number of runs share consecutive ranks in any order. With
an empty target every gain comes from the documents alone; with no documents there are no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.llm.common import in_arrow, numbered, stored

MOST_WORDS = 3  # words in the longest run
BUCKETS = 10_000
LEAST_WORDS = 20  # documents of fewer words are not drawn
PERCENT = 5
SEED = 42
WINDOW_BYTES = 1 << 20

TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def windows(data: bytes, most: int = WINDOW_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in order, in lists of about ``most`` bytes of text."""
    blanked, at = data.translate(TABLE), 0
    while at < len(blanked):
        end = blanked.find(b" ", at + most)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end


def run_checksums(before: list[bytes], words: list[bytes], most: int = MOST_WORDS) -> list[int]:
    """Checksums of all runs of up to ``most`` words that end in ``words``; ``before`` precedes them."""
    run, skip = before + words, len(before)
    spaced = [b" " + w for w in run]
    chain = list(map(crc32, run))
    out = chain[skip:]
    for n in range(1, most):
        chain = list(map(crc32, spaced[n:], chain))
        out += chain[max(skip - n, 0) :]
    return out


def _buckets(data: bytes, most: int, buckets: int, window: int) -> Iterator[tuple[int, list[int]]]:
    """Words and buckets of each window of a text."""
    before: list[bytes] = []
    for words in windows(data, window):
        yield len(words), [c % buckets for c in run_checksums(before, words, most)]
        before = (before + words)[-(most - 1) :] if most > 1 else []


def bucket_counts(
    texts: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, window: int = WINDOW_BYTES
) -> DataFrame:
    """``bucket, n``: how many runs of words of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for data in batch.column(0):
                for _, places in _buckets(data.as_py() or b"", most, buckets, window):
                    found.update(places)
        yield pa.RecordBatch.from_pydict({"bucket": list(found.keys()), "n": list(found.values())}, schema=_COUNTS)

    counted = in_arrow(texts.select(F.col("text").cast("binary")), count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])


def gains(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> list[int]:
    """Per bucket, thousandths of the log ratio of its smoothed shares in the target and in the documents."""

    def whole(frame: DataFrame) -> list[int]:
        out = [0] * buckets
        for row in bucket_counts(frame, most, buckets).collect():  # one row a bucket
            out[row.bucket] = row.n
        return out

    s, t = whole(docs), whole(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [
        math.floor(1000 * math.log(float(y + 1) * all_s / (float(x + 1) * all_t))) for x, y in zip(s, t, strict=True)
    ]


def weighed(
    docs: DataFrame, gain: list[int], most: int = MOST_WORDS, window: int = WINDOW_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""
    schema = pa.schema([(n, pa.int64()) for n in ("n_words", "n_features", "weight")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[int], list[int], list[int]] = ([], [], [])
            for data in batch.column(1):
                n_words = n_features = weight = 0
                for n, places in _buckets(data.as_py() or b"", most, len(gain), window):
                    n_words += n
                    n_features += len(places)
                    weight += sum(map(gain.__getitem__, places))
                for column, value in zip(out, (n_words, n_features, weight), strict=True):
                    column.append(value)
            found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *found.columns], names=["doc_id", *schema.names]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return in_arrow(
        docs.select("doc_id", F.col("text").cast("binary")), weigh,
        f"doc_id {kind}, n_words long, n_features long, weight long",
    )


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel draw, fixed by seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; only drawn ones have a rank."""
    spark = docs.sparkSession
    scored = stored(
        weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)),
        "importance",
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    fit = scored.filter(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged, starts, n_fit = numbered(fit, "importance-order")
    n_drawn = percent * n_fit // 100
    ahead = spark.createDataFrame([s for s in starts if s[1] < n_drawn], "_part int, _ahead long")
    place = F.col("_ahead") + F.col("_row") + 1
    rank = F.when(place <= n_drawn, place).alias("rank")
    placed = ranged.join(ahead, "_part", "left").select(*scored.columns, rank)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest)


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The documents whose id has a rank, with all their columns."""
    ids = ranked.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")
