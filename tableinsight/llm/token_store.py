"""Token ids in directly addressable codes, and random access to any token.

Method. Ids are split into chunks of eight bits, lowest first. Level 0 holds the low chunk of every
id and one continuation bit each; level 1 holds the next chunk of the ids whose bit was set, with
bits of its own, and so on. A rank directory over the bits says where an id continues, so any token
is read from a few bytes without decoding what stands before it.

File format. Parquet rows in the shared folder, one per block of whole documents: shard (range
number), block, start (ids before the block in its shard), docs and ends (id and last position of
each document), levels (chunk bytes), bits (continuation bitmaps, little-endian 64-bit words) and
ranks (ones before each bitmap word, 32-bit). Blocks follow ascending doc_id over shards and blocks.

Encoding. The vocabulary splits a text into words, with the space before them, and white space
before it merges, so a distinct word needs encoding once. Texts whose white space is single spaces
and line ends between words are put together from a bounded memo of encoded words; all others, and
all texts under a vocabulary that joins words, are encoded whole. Both use the tokenizers library.

Defined results. A null or empty text has only the end id. Repeated doc_ids keep their rows, in text
order; null ids come first. No rows in, no rows out. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableinsight.llm import bytetext
from tableinsight.llm.common import in_arrow, stored

END_ID = 0
BLOCK_TOKENS = 1 << 20
MEMO_WORDS = 1_000_000  # per worker, about 32 bytes each; a full memo starts again
LINES_AT_ONCE = 2000
SPACE_MARK = "\u0120"  # fixed value: how byte-level vocabularies write a space
TEXTS_CHARS = 1 << 20
# White space other than single spaces and line ends: by itself, or next to another.
OTHER_SPACE = ["  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


STORED = (
    "shard int, block int, start long, docs array<long>, ends array<long>, "
    "levels array<binary>, bits array<binary>, ranks array<binary>"
)


@dataclass
class Coded:
    """One block of ids in directly addressable codes."""

    levels: list[np.ndarray]
    bits: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray) -> Coded:
        levels, bits, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            levels.append((rest & 0xFF).astype(np.uint8))
            more = rest > 0xFF
            packed = np.packbits(more, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)
            bits.append(packed)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            ranks.append(np.concatenate(([0], ones[:-1])).astype(np.uint32) if len(ones) else ones.astype(np.uint32))
            if not more.any():
                return cls(levels, bits, ranks)
            rest = rest[more] >> 8

    def read(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places, in any order."""
        out = np.zeros(len(places), dtype=np.uint32)
        live, at = np.arange(len(places)), places.astype(np.int64)
        for level, (chunk, bits, ranks) in enumerate(zip(self.levels, self.bits, self.ranks, strict=True)):
            out[live] |= chunk[at].astype(np.uint32) << np.uint32(8 * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            more = ((bits[word] >> bit) & np.uint64(1)).astype(bool)
            live, word, bit = live[more], word[more], bit[more]
            if not len(live):
                break
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            at = ranks[word].astype(np.int64) + np.bitwise_count(below)
        return out


class Encoder:
    """Texts to little-endian 16-bit ids; it lives, with its memo, as long as the Python worker.

    The memo holds encoded words by two hashes of their bytes, in arrays: sorted keys, second
    hashes, and where each word's ids stand.
    """

    def __init__(self, path: str, marks_are_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = marks_are_text
        # Texts that hold one of these are encoded whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = [*OTHER_SPACE, *added]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        probe = [self._ids(x).tolist() for x in ("\n", "ab,", " cd", "\u00e9f", " g.")]
        self.line_end = np.uint16(probe[0][0])
        # Whether words and line ends are encoded apart, as by a byte-level vocabulary.
        self.apart = len(probe[0]) == 1 and self._ids("ab, cd\n\u00e9f g.").tolist() == [
            i for k in (1, 2, 0, 3, 4) for i in probe[k]
        ]
        # Whether a word of ASCII letters after a space is one unit of the vocabulary's model.
        self.direct = self.apart and self._model_ids("Ab") == self._ids(" Ab").tolist()
        self.marks = {x.encode(): self._ids(x).tolist() for x in ".,;:!?"}
        self.direct = self.direct and all(
            self._model_ids("Ab") + ids == self._ids(" Ab" + x.decode()).tolist() for x, ids in self.marks.items()
        )
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.second = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.uint32)
        self.size = np.zeros(0, dtype=np.uint32)
        self.ids = np.zeros(0, dtype="<u2")

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u2")

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(SPACE_MARK + word)]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words as they stand in a text, each with its space or line end, or neither; and
        where in them each word's ids start and how many they are."""
        at, size = np.zeros((2, len(words)), dtype=np.int64)
        direct, stops, found = [], [0], []
        rest: list[int] = []
        tokenize, marks, none = self.tokenizer.model.tokenize, self.marks, []
        for n, word in enumerate(words):
            # A mark after letters is a unit of its own.
            mark = marks.get(word[-1:], none)
            letters = word[1:-1] if mark else word[1:]
            if self.direct and word[:1] == b" " and letters.isalpha():
                found += [t.id for t in tokenize(SPACE_MARK + letters.decode())]
                found += mark
                direct.append(n)
                stops.append(len(found))
            else:
                rest.append(n)
        at[direct], size[direct] = stops[:-1], np.diff(stops)
        out, held = [np.array(found, dtype="<u2")], len(found)
        for first in range(0, len(rest), LINES_AT_ONCE):
            part = rest[first : first + LINES_AT_ONCE]
            after_end = np.array([words[n][:1] == b"\n" for n in part])
            lines = "\n".join([words[n].removeprefix(b"\n").decode() for n in part])
            # A line end is one token, at the start of the word that it came with; one more is before all.
            ids = np.concatenate(([self.line_end], self._ids(lines))).astype("<u2")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            if len(ends) != len(part) + 1:
                raise ValueError("words and line ends are not encoded apart")
            at[part] = held + ends[:-1] + 1 - after_end
            size[part] = np.diff(ends) - 1 + after_end
            out.append(ids)
            held += len(ids)
        return np.concatenate(out), at, size

    def _learn(self, keys: np.ndarray, second: np.ndarray, words: list[bytes]) -> None:
        ids, at, size = self._encode(words)
        at += len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        place = np.searchsorted(self.keys, keys)
        # One after the other: no second copy of the whole memo.
        for name, new in (("keys", keys), ("second", second), ("at", at), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def _plain(self, texts: bytetext.Texts) -> list[np.ndarray]:
        """Texts whose white space is single spaces and line ends between words, by the memo."""
        # A word starts at its space or line end.
        starts, ends = bytetext.pieces((texts.data == 32) | (texts.data == 10), texts.offsets)
        first, again = bytetext.exact_hashes(texts.data, starts, ends)
        keys, sample, number = np.unique(first, return_index=True, return_inverse=True)
        at = self._find(keys, again[sample])
        if (fresh := np.flatnonzero(at < 0)).size:
            if len(self.keys) + len(fresh) > MEMO_WORDS:
                self._forget()
                fresh = np.arange(len(keys))
            raw = texts.data.tobytes()
            new = sample[fresh]
            words = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self._learn(keys[fresh], again[sample[fresh]], words)
            at = self._find(keys, again[sample])
        # Words of equal first hash and other second hash: such texts are encoded whole.
        if (again != again[sample][number]).any() or (at < 0).any():
            raw = texts.data.tobytes()
            return [self._ids(raw[a:b].decode()) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
        at = at[number]
        size = self.size[at].astype(np.int64)
        begin = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.at[at] - begin, size) + np.arange(int(size.sum()))]
        cuts = np.append(begin, len(ids))[np.searchsorted(starts, texts.offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _find(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (self.second[place] == second), place, -1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [
            self.apart and text != "" and text[0] not in " \n" and text[-1] not in " \n"
            and not any(x in text for x in self.whole)
            for text in texts
        ]
        out: list[np.ndarray] = [self._ids(t) if not p else t for t, p in zip(texts, plain, strict=True)]
        which = [i for i, p in enumerate(plain) if p]
        for group in bytetext.slices(pa.array([texts[i] for i in which], pa.string()), TEXTS_CHARS):
            for i, ids in enumerate(self._plain(group)):
                out[which[group.first + i]] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, marks_are_text=False)  # ids as the tokenizer's file has them
    return _encoders[path]


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """Texts of about TEXTS_CHARS together; a null is empty."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= TEXTS_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _write(path: str, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(shard: int, block: int, start: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        coded = Coded.of(np.concatenate(parts))
        arrays = [
            pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
            pa.array([docs], pa.list_(pa.int64())),
            pa.array([np.cumsum([len(p) for p in parts]).tolist()], pa.list_(pa.int64())),
            *(pa.array([[x.tobytes() for x in part]], pa.list_(pa.binary()))
              for part in (coded.levels, coded.bits, coded.ranks)),
        ]
        names = ["shard", "block", "start", "docs", "ends", "levels", "bits", "ranks"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        shard = block = start = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            ids_of = zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            for texts in _groups(batch.column("text")):
                for ids in encode(texts):
                    shard, doc = next(ids_of)
                    parts.append(np.append(ids, np.uint16(END_ID)))
                    docs.append(doc)
                    held += len(parts[-1])
                    if held >= block_tokens:
                        yield row(shard, block, start, docs, parts)
                        block, start, held, docs, parts = block + 1, start + held, 0, [], []
        if docs:
            yield row(shard, block, start, docs, parts)

    return write


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's ids through the codes; (doc_id, shard, at, n_tokens, ids_crc32)."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            parts = {
                name: [np.frombuffer(x.as_buffer(), dtype=kind) for x in row[name]]
                for name, kind in (("levels", np.uint8), ("bits", np.uint64), ("ranks", np.uint32))
            }
            ends = row["ends"].values.to_numpy()
            ids = Coded(**parts).read(np.arange(ends[-1])).astype("<u4")
            starts = np.concatenate(([0], ends[:-1]))
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [row["docs"].values, pa.array(np.full(n, row["shard"].as_py(), np.int32)),
                 pa.array(starts + row["start"].as_py()), pa.array(ends - starts), pa.array(sums, pa.int64())],
                names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the blocks to the shared folder, documents in ascending order; returns what was written."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )
    return stored(in_arrow(ordered, _write(path, block_tokens), STORED), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Per document of the written blocks: doc_id, start, n_tokens, ids_crc32.

    A shard's first position is the sum over the shards before it: one row per range partition.
    """
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("shard").agg(F.sum(F.element_at("ends", -1)).alias("tokens"))
        .select("shard", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    )
    read = in_arrow(blocks, _read_back, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    return read.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_at(blocks: DataFrame, shard: int, position: int) -> int | None:
    """One id by its position in a shard: one block is read, and of it a few bytes."""
    block = (
        blocks.filter((F.col("shard") == shard) & (F.col("start") <= position))
        .filter(F.col("start") + F.element_at("ends", -1) > position)
        .first()
    )
    if block is None or position < 0:
        return None
    parts = {
        name: [np.frombuffer(x, dtype=kind) for x in block[name]]
        for name, kind in (("levels", np.uint8), ("bits", np.uint64), ("ranks", np.uint32))
    }
    return int(Coded(**parts).read(np.array([position - block["start"]]))[0])
