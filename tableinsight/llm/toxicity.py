"""Toxic documents and the sentences that make them so, learned from document labels alone.

Method. Multiple-instance learning: a document is a bag of sentences, only bags have labels. A
sentence is toxic with a logistic chance of its terms, a document by noisy-or of its sentences and a
leak, for documents labelled toxic without any term to show for it. Weights maximise the likelihood
of the bag labels. The sentences whose own chance reaches one half are located.

Terms are words and beginnings of words of five to seven bytes. How many labelled documents of
either kind hold each term is counted by Spark over all training documents; all terms with a
significant excess form the vocabulary. Weights are fitted on a sample of about ``train_rows``
labelled documents, of which only the sentences with terms come to the driver. A term that the
sample does not hold has weight 0.

Defined results. Sentences end at ``.``, ``!``, ``?`` or a line break. A text without terms, also a
null or empty one, scores the leak. A doc_id labelled more than once is toxic if any label says so;
null labels are ignored. If nothing is learned, or one kind of label is missing, all scores are 0.
Repeated documents keep their rows. Other columns are ignored, or kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.llm import bytetext
from tableinsight.llm.common import in_arrow, packed, stored, unpacked

PREFIX_BYTES = (5, 6, 7)
THRESHOLD = 0.7
LEAST_DOCS = 4
LEAST_Z = 5.0
TRAIN_ROWS = 20_000
STEPS = 400
HELD_TERMS = 2_000_000  # terms a task holds before it sums them
LEAST_SURE = 0.5  # the leak stays below: no document is rejected without evidence

_ENDS = np.isin(np.arange(256), list(b".!?\n"))


def _terms(texts: bytetext.Texts) -> tuple[np.ndarray, np.ndarray, bytetext.Words]:
    """(term, word) pairs of a slice: each word and its beginnings, as hashes."""
    found = bytetext.words(texts)
    length = found.ends - found.starts
    hashes, places = [found.hashes], [np.arange(len(found.hashes))]
    for n in PREFIX_BYTES:
        long = np.flatnonzero(length >= n)
        begin = bytetext.run_hashes(texts.data, found.starts[long], found.starts[long] + n)
        hashes.append(bytetext.mixed(begin + np.uint64(n)))
        places.append(long)
    return np.concatenate(hashes), np.concatenate(places), found


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents of either label that hold each term, summed as they come."""
    def summed(kinds: list[list[np.ndarray]]) -> pa.RecordBatch:
        empty = np.zeros(0, dtype=np.uint64)
        # Each kind is sorted by itself: no order and no places of all terms are held beside them.
        found = [np.unique(np.concatenate([empty, *k]), return_counts=True) for k in kinds]
        terms = np.sort(np.concatenate([held for held, _ in found]))
        terms = terms[np.concatenate(([True], terms[1:] != terms[:-1]))[: len(terms)]]
        counts = np.zeros((2, len(terms)), dtype=np.int64)
        for own, (held, n) in zip(counts, found, strict=True):
            own[np.searchsorted(terms, held)] = n
        return pa.RecordBatch.from_arrays(
            [pa.array(terms.view(np.int64)), pa.array(counts[0]), pa.array(counts[1])],
            names=["term", "toxic", "clean"],
        )

    kinds: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        labels = batch.column("toxic").to_numpy(zero_copy_only=False)
        for texts in bytetext.slices(batch.column("text")):
            term, word, found = _terms(texts)
            doc = np.searchsorted(found.bounds, word, side="right") - 1
            order = np.lexsort((term, doc))
            term, doc = term[order], doc[order]
            once = np.concatenate(([True], (np.diff(doc) != 0) | (term[1:] != term[:-1])))[: len(term)]
            toxic = labels[texts.first + doc] == 1
            kinds[0].append(term[once & toxic])
            kinds[1].append(term[once & ~toxic])
            if sum(len(x) for k in kinds for x in k) >= HELD_TERMS:
                yield summed(kinds)
                kinds = [[], []]
    yield summed(kinds)


def _evidence(texts: bytetext.Texts, vocabulary: np.ndarray) -> list[dict[int, np.ndarray]]:
    """For each text, the places in the vocabulary of the terms in each sentence that has any."""
    out: list[dict[int, np.ndarray]] = [{} for _ in range(len(texts))]
    if not len(vocabulary):
        return out
    term, word, found = _terms(texts)
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == term)
    at, word = at[hit], word[hit]
    doc = np.searchsorted(found.bounds, word, side="right") - 1
    ends = np.cumsum(_ENDS[texts.data])
    closed = np.concatenate(([0], ends))
    sentence = closed[found.starts[word]] - closed[texts.offsets[doc]]
    for d, s, v in zip(doc.tolist(), sentence.tolist(), at.tolist(), strict=True):
        out[d].setdefault(s, []).append(v)
    return [{s: np.unique(v) for s, v in own.items()} for own in out]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted term hashes
    weights: np.ndarray
    bias: float
    leak: float

    def chances(self, sentences: dict[int, np.ndarray]) -> dict[int, float]:
        return {
            s: float(1 / (1 + np.exp(-(self.bias + self.weights[v].sum())))) for s, v in sorted(sentences.items())
        }

    def score(self, chances: dict[int, float]) -> float:
        return float(1 - (1 - self.leak) * np.prod([1 - p for p in chances.values()]))


def _bags(vocabulary: object) -> object:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [v.tolist() for _, v in sorted(own.items())]
                for texts in bytetext.slices(batch.column("text"))
                for own in _evidence(texts, vocabulary.value)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["toxic", "bag"]
            )

    return collect


def fit(bags: list[tuple[int, list[list[int]]]], n_terms: int, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the likelihood of the bag labels, by Adam ascent."""
    label = np.array([y for y, _ in bags], dtype=np.float64)
    flat = [(b, s) for b, (_, bag) in enumerate(bags) for s in bag]
    bag = np.array([b for b, _ in flat], dtype=np.int64)
    sentence = np.array([i for i, (_, s) in enumerate(flat) for _ in s], dtype=np.int64)
    term = np.array([v for _, s in flat for v in s], dtype=np.int64)
    share = max(label.mean(), 1e-6)
    parameters = np.concatenate((np.zeros(n_terms), [-1.0, np.log(share / 2)]))
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        weights, bias, leak = parameters[:-2], parameters[-2], parameters[-1]
        odds = 1 / (1 + np.exp(-leak))
        p_leak = LEAST_SURE * odds
        z = bias + np.bincount(sentence, weights[term], minlength=len(flat))
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags)) + np.log1p(-p_leak)
        chance = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d likelihood / d ln(1 - p of the bag)
        pull = label * (1 - chance) / chance - (1 - label)
        d_z = pull[bag] * p
        gradient = np.concatenate((
            np.bincount(term, d_z[sentence], minlength=n_terms) - 0.5 * weights,
            [d_z.sum() - 0.5 * bias, (pull * p_leak * (1 - odds) / (1 - p_leak)).sum()],
        )) / len(bags)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.05 / (1 + step / steps)
        parameters = parameters + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return parameters[:-2], float(parameters[-2]), float(LEAST_SURE / (1 + np.exp(-parameters[-1])))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """From documents and (doc_id, toxic) labels; joins them by doc_id."""
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    train = stored(
        # One way to join at every size: both sides are shuffled and merged.
        docs.select("doc_id", F.col("text").cast("string").alias("text")).join(marks.hint("merge"), "doc_id"),
        "toxic-train",
    )
    totals = train.agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") != 1).alias("clean")
    ).first()
    nothing = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, 0.0)
    if not totals["toxic"] or not totals["clean"]:
        return nothing
    n = totals["toxic"] + totals["clean"]
    share = totals["toxic"] / n
    held = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - held * share) / F.sqrt(held * (share * (1 - share)) * (1 - held / (n + 1)))
    strong = (
        in_arrow(train.select("text", "toxic"), _counter, "term long, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= LEAST_DOCS)
        .withColumn("z", z)
        .filter(F.col("z") >= LEAST_Z)
    )
    vocabulary = np.sort(strong.select("term").toArrow().column("term").to_numpy().view(np.uint64))
    # A share of the labelled documents by their hash: train_rows of them, give or take its square root.
    chance = F.pmod(F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(1 << 30))
    sample = train.filter(chance < int(min(1.0, train_rows / n) * (1 << 30))).select("text", "toxic")
    shared = spark.sparkContext.broadcast(vocabulary)
    bags = in_arrow(sample, _bags(shared), "toxic int, bag array<array<int>>").toArrow()
    # Sorted: sums do not depend on the order in which tasks end.
    rows = sorted(zip(bags.column("toxic").to_pylist(), bags.column("bag").to_pylist(), strict=True))
    weights, bias, leak = fit(rows, len(vocabulary))
    return Model(vocabulary, weights, bias, leak)


def _scorer(model: object, keep_text: bool) -> object:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in batches:
            scores, found = [], []
            for texts in bytetext.slices(batch.column("_text")):
                for own in _evidence(texts, known.vocabulary):
                    chances = known.chances(own)
                    scores.append(known.score(chances))
                    found.append([s for s, p in chances.items() if p >= 0.5])
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["_score"] = pa.array(scores, pa.float64())
            columns["_sentences"] = pa.array(found, pa.list_(pa.int32()))
            if not keep_text:
                columns.pop("_text")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return score


def scored(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``_score`` and ``_sentences``, the numbers of the offending ones; the text only if
    it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.withColumns({
        "_text": F.col("text").cast("string"), "_score": F.lit(0.0),
        "_sentences": F.array().cast("array<int>"),
    }).drop("text")
    schema = (frame if keep_text else frame.drop("_text")).schema
    return in_arrow(frame, _scorer(shared, keep_text), schema).withColumnRenamed("_text", "text")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    kept = scored(packed(docs, "text"), model).filter(F.col("_score") < threshold)
    return unpacked(kept, docs, {"text": F.col("text")})
