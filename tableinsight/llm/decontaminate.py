"""Find benchmark passages in documents with an FM-index per shard of documents.

Method. A shard is what one task has read, up to a bound on its words. Words that no benchmark item
holds can never be part of a passage, so a shard's text is its runs of benchmark words, each run
ended by a separator; runs shorter than the shortest phrase are left out. Over that text a suffix
array gives the Burrows-Wheeler transform, held in a wavelet matrix with rank directories. All test
phrases are searched backwards together; occurrences are located by walking to sampled suffix
positions. Every word of a run is compared with the benchmark word byte by byte, so hash
collisions cannot make a hit. Hits are merged to spans of words per document.

The benchmark is a stated query set: it is split into blocks of bounded size, and each block is a
pass over the documents that adds to the spans found before. Nothing else leaves the tasks.

Defined results. A null or wordless text has no words and no hits; a null or wordless item has no
phrases; an item with a null id has phrases that hit but is not counted. Items that repeat a phrase
or an id count once each by id. Repeated documents keep their rows. With no benchmark nothing is
hit. Other columns are ignored, or kept by ``cut_passages``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableinsight.llm import bytetext
from tableinsight.llm.common import in_arrow, packed, unpacked, with_length

PHRASE_WORDS = 10
SHARD_WORDS = 1 << 20  # words of indexed runs in one index
BLOCK_CHARS = 8 << 20  # characters of benchmark text in one block, about
HELD_BYTES = 24 << 20  # texts held back for one index
SAMPLE = 16  # every so many text positions one suffix position is kept


class WaveletMatrix:
    """Rank over a sequence of small integers, one bit vector with a rank directory per level."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(values)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            ones = (values >> level) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            directory = np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))
            zeros = self.n - int(ones.sum())
            self.levels.append((packed, directory, zeros))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    @staticmethod
    def _ones(packed: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return directory[block] + np.bitwise_count(packed[block] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low, at = np.zeros_like(at), at.copy()
        for i, (packed, directory, zeros) in enumerate(self.levels):
            bit = (symbols >> (self.bits - 1 - i)) & 1
            a, b = self._ones(packed, directory, low), self._ones(packed, directory, at)
            low = np.where(bit == 1, zeros + a, low - a)
            at = np.where(bit == 1, zeros + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        value, at = np.zeros_like(at), at.copy()
        for packed, directory, zeros in self.levels:
            bit = ((packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(packed, directory, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            value = value * 2 + bit
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; separators (0) are all different and sort by place."""
    n = len(text)
    separators = text == 0
    key = np.where(separators, np.cumsum(separators) - 1, text + int(separators.sum()))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        """``text`` has symbols from 1 to ``symbols`` in runs that each end in 0."""
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        run_start = np.concatenate(([True], text[:-1] == 0))
        sampled = (order % sample == 0) | run_start[order]  # no walk passes the start of a run
        self.marks = WaveletMatrix(sampled.astype(np.int64), 1)
        self.is_sampled = sampled
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each phrase (rows are right-aligned)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((back < lengths) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        rows = rows.copy()
        walked, found = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            done = self.is_sampled[at]
            hit = live[done]
            ones = self.marks.rank(np.ones(len(hit), dtype=np.int64), rows[hit])
            found[hit] = self.samples[ones] + walked[hit]
            live, at = live[~done], at[~done]
            symbol = self.bwt.access(at)
            rows[live] = self.before[symbol] + self.bwt.rank(symbol, at)
            walked[live] += 1
        return found


@dataclass
class Phrases:
    """A block of the benchmark: its words, its distinct phrases and the items each belongs to."""

    vocabulary: np.ndarray  # sorted word hashes; word i of the vocabulary is symbol i + 1
    spelled: list[bytes]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], size: int) -> Phrases:
        spelled: dict[int, bytes] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for texts in bytetext.slices(pa.array([t for _, t in items], pa.string())):
            found = bytetext.words(texts)
            raw = bytetext.LOWERED[texts.data].tobytes()
            spelled.update(
                (int(h), raw[s:e]) for h, s, e in zip(found.hashes, found.starts, found.ends, strict=True)
            )
            for i in range(len(texts)):
                own = tuple(map(int, found.hashes[found.bounds[i] : found.bounds[i + 1]]))
                for at in range(max(1, len(own) - size + 1) if own else 0):
                    owners[own[at : at + size]].add(items[texts.first + i][0])
        vocabulary = np.array(sorted(spelled), dtype=np.uint64)
        rows = np.zeros((len(owners), size), dtype=np.int64)
        for i, phrase in enumerate(owners):
            rows[i, size - len(phrase) :] = np.searchsorted(vocabulary, np.array(phrase, dtype=np.uint64)) + 1
        return cls(
            vocabulary, [spelled[int(h)] for h in vocabulary], rows,
            np.array([len(p) for p in owners], dtype=np.int64),
            [sorted(x for x in own if x is not None) for own in owners.values()],
        )


class _Shard:
    """Collects runs of benchmark words of many documents, then indexes and searches them at once."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.text: list[np.ndarray] = []
        self.words_at: list[np.ndarray] = []  # number of the word in its document
        self.doc_at: list[np.ndarray] = []
        self.size = 0
        h = phrases.vocabulary
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(h >> np.uint64(48)).astype(np.int64)] = True

    def add(self, texts: bytetext.Texts, found: bytetext.Words, first_doc: int) -> None:
        known = self.phrases.vocabulary
        if not len(known) or not len(found.hashes):
            return
        at = np.flatnonzero(self.maybe[(found.hashes >> np.uint64(48)).astype(np.int64)])
        symbol = np.searchsorted(known, found.hashes[at])
        symbol[symbol == len(known)] = 0
        same = known[symbol] == found.hashes[at]
        at, symbol = at[same], symbol[same] + 1
        if not len(at):
            return
        doc = np.searchsorted(found.bounds, at, side="right") - 1
        while True:
            cut = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(doc) != 0)))
            run = np.cumsum(cut) - 1
            long = np.bincount(run)[run] >= self.phrases.shortest
            at, symbol, doc = at[long], symbol[long], doc[long]
            if not len(at):
                return
            raw = bytetext.LOWERED[texts.data].tobytes()
            exact = np.fromiter(
                (raw[s:e] == self.phrases.spelled[k - 1] for s, e, k in
                 zip(found.starts[at], found.ends[at], symbol, strict=True)), bool, len(at),
            )
            if exact.all():
                break
            at, symbol, doc = at[exact], symbol[exact], doc[exact]
        ends = np.concatenate((np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1, [len(at)]))
        self.text.append(np.insert(symbol, ends, 0))
        self.words_at.append(np.insert(at - found.bounds[doc], ends, -1))
        self.doc_at.append(np.insert(doc + first_doc, ends, -1))
        self.size += len(at)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence."""
        none = np.zeros(0, dtype=np.int64)
        if not self.text:
            return none, none, none
        text = np.concatenate(self.text)
        index = FmIndex(text, len(self.phrases.vocabulary))
        low, high = index.search(self.phrases.rows, self.phrases.lengths)
        phrase = np.repeat(np.arange(len(low)), high - low)
        ahead = np.cumsum(high - low) - (high - low)
        places = index.locate(np.arange(len(phrase)) - ahead[phrase] + low[phrase])
        return np.concatenate(self.doc_at)[places], np.concatenate(self.words_at)[places], phrase


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _searcher(block: object, then: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``block``: a broadcast of Phrases, of bounded size. ``then``: keep the texts, cut the
    spans out of them, or drop them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        held: list[pa.RecordBatch] = []
        n_words: list[np.ndarray] = []
        shard, docs = _Shard(phrases), 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, word, phrase = shard.hits()
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            for d, w, p in zip(doc.tolist(), word.tolist(), phrase.tolist(), strict=True):
                spans[d].append((w, w + int(phrases.lengths[p])))
                items[d].update(phrases.items[p])
            at = 0
            counts = np.concatenate(n_words) if n_words else np.zeros(0, dtype=np.int64)
            for batch in held:
                n = len(batch)
                before = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
                own_spans = [
                    merged_spans(spans.get(at + i, []) + [(s["start"], s["end"]) for s in before[0][i] or []])
                    for i in range(n)
                ]
                own_items = [sorted(items.get(at + i, set()) | set(before[1][i] or [])) for i in range(n)]
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns |= {
                    "_spans": pa.array(
                        [[{"start": s, "end": e} for s, e in x] for x in own_spans],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                    "_items": pa.array(own_items, pa.list_(pa.string())),
                    "_words": pa.array(counts[at : at + n], pa.int64()),
                }
                if then == "cut":
                    columns["_text"] = _without(columns["_text"], own_spans)
                elif then == "drop":
                    columns["_text"] = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                at += n

        for batch in batches:
            for texts in bytetext.slices(batch.column("_text")):
                found = bytetext.words(texts)
                n_words.append(np.diff(found.bounds))
                shard.add(texts, found, docs + texts.first)
            held.append(batch)
            docs += len(batch)
            # What is held back is bounded: texts by bytes, runs by words.
            if shard.size >= SHARD_WORDS or sum(b.nbytes for b in held) >= HELD_BYTES:
                yield from flush()
                held, n_words, shard, docs = [], [], _Shard(phrases), 0
        yield from flush()

    return search


def blocks_of(benchmark: DataFrame, size: int, block_chars: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``block_chars`` characters; one block at a time is on the driver."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")
    ).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for i in range(n):
        block = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items
        yield Phrases.of([(r["id"], r["text"]) for r in block.toLocalIterator()], size)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, size: int = PHRASE_WORDS, block_chars: int = BLOCK_CHARS,
    cut: bool = False,
) -> DataFrame:
    """All columns of ``docs`` but the text, with ``_spans`` (hit words), ``_items`` and ``_words``.

    With ``cut`` the last pass leaves in ``_text`` what the spans of all passes leave of the text.
    """
    spark = docs.sparkSession
    empty = "array<struct<start:int,end:int>>"
    frame = docs.withColumns({
        "_text": F.col("text").cast("string"), "_spans": F.array().cast(empty),
        "_items": F.array().cast("array<string>"), "_words": F.lit(0).cast("long"),
    }).drop("text")
    passes = list(blocks_of(benchmark, size, block_chars)) or [Phrases.of([], size)]
    for i, phrases in enumerate(passes, 1):
        block = spark.sparkContext.broadcast(phrases)
        then = "keep" if i < len(passes) else "cut" if cut else "drop"
        frame = in_arrow(frame, _searcher(block, then), frame.schema)
    return frame


def contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"),
        F.col("_spans").alias("spans"), (hit > 0).alias("contaminated"),
    )


def _without(text: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts without their spans of words."""
    if not any(spans):
        return text
    out = text.to_pylist()
    for i in (i for i, own in enumerate(spans) if own):
        (texts,) = bytetext.slices(pa.array([out[i]], pa.string()))
        found = bytetext.words(texts)
        raw, at, kept = texts.data.tobytes(), 0, []
        for start, end in spans[i]:
            kept.append(raw[at : found.starts[start]])
            at = found.ends[end - 1]
        out[i] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(out, pa.string())


def cut_passages(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The documents with every hit span removed; ``n_chars``, where there is one, follows the text."""
    cut = find_passages(packed(docs, "text"), benchmark, cut=True, **options)
    changed = F.size("_spans") > 0
    return unpacked(cut, docs, {"text": F.col("_text")} | with_length(docs, changed, F.col("_text")))
