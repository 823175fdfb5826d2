"""What the operators hold at once in a task and keep in a Python worker."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableinsight.llm import bytetext, catalog, common, toxicity
from tableinsight.llm.token_store import Encoder


def sizes(docs):
    def work(batches):  # a closure travels whole, a function of this file by name only
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], names=["n", "held"])

    return common.in_arrow(docs, work, "n long, held long").collect()


def test_a_batch_of_long_texts_is_bounded(spark):
    docs = spark.range(6000, numPartitions=1).select(F.repeat(F.lit("abcdefgh"), 500).alias("text"))
    found = sizes(docs)
    assert sum(r.n for r in found) == 6000
    assert max(r.held for r in found) <= common.BATCH_BYTES + 100_000


def test_a_limit_of_the_session_stays(spark):
    other = spark.newSession()
    other.conf.set(common._BATCH, 1 << 20)
    docs = other.range(1000, numPartitions=1).select(F.repeat(F.lit("abcdefgh"), 500).alias("text"))
    assert max(r.held for r in sizes(docs)) <= (1 << 20) + 100_000
    assert other.conf.get(common._BATCH) == str(1 << 20)


def test_learning_words_copies_one_array_at_a_time():
    encode, n = Encoder(catalog.tokenizer_path()), 500_000
    tracemalloc.start()
    encode.keys = np.arange(n, dtype=np.uint64) * np.uint64(2)
    encode.second = encode.keys.copy()
    encode.at, encode.size = np.zeros(n, dtype=encode.at.dtype), np.ones(n, dtype=encode.size.dtype)
    try:
        before, _ = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        encode._learn(np.array([5], dtype=np.uint64), np.array([7], dtype=np.uint64), [b" plain"])
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most - before <= 2 * 8 * n
    at = encode._find(np.array([5], dtype=np.uint64), np.array([7], dtype=np.uint64))
    ids = encode.ids[encode.at[at[0]] :][: encode.size[at[0]]]
    assert ids.tolist() == encode._ids(" plain").tolist()


def test_long_tables_do_not_stay_with_the_worker():
    data = np.full(bytetext.SLICE_BYTES + 10, 97, dtype=np.uint8)
    starts, ends = np.array([0, 20]), np.array([5, 25])
    first = bytetext.exact_hashes(data, starts, ends)
    common.give_back()
    assert all(len(table) <= bytetext.SLICE_BYTES + 1 for table in bytetext._tables.values())
    again = bytetext.exact_hashes(data, starts, ends)
    assert [x.tolist() for x in first] == [x.tolist() for x in again]


@pytest.mark.parametrize("held", [1, 8, 10_000])
def test_terms_are_counted_by_kind(monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD_TERMS", held)
    batches = [
        pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array(marks, pa.int32())})
        for texts, marks in (
            (["foul foul word", "plain word"], [1, 0]), (["foul word", None, ""], [1, 0, 1]), (["plain"], [0]), ([], []),
        )
    ]
    sums = {}
    for batch in toxicity._counter(iter(batches)):
        assert batch.column("term").to_numpy().view(np.uint64).tolist() == sorted(
            set(batch.column("term").to_numpy().view(np.uint64).tolist())
        )
        for term, *kinds in zip(*(batch.column(c).to_pylist() for c in ("term", "toxic", "clean")), strict=True):
            old = sums.get(term, (0, 0))
            sums[term] = (old[0] + kinds[0], old[1] + kinds[1])
    assert sorted(sums.values()) == sorted([(2, 0), (2, 1), (0, 2), (0, 2)])  # foul, word, plain and its beginning
