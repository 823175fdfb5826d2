"""Words of many texts at once: byte masks and rolling hashes over an Arrow column.

A word is a run of digits, ASCII letters and code points above 127, with A to Z in lower case. In
UTF-8 every byte of a code point above 127 is itself above 127, so words are found byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # texts worked on together; one longer text is worked on alone

LONG_RUN = 64  # bytes; sums of powers hold texts of patterns alike that are longer by far

_BYTES = np.arange(256)
IS_WORD = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90))
    | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
)
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))[LOWERED]  # upper and lower case alike
_EXACT = mixed(np.arange(1001, 1257, dtype=np.uint64))
_OTHER = 0xC2B2AE3D27D4EB4F
_tables: dict[str, np.ndarray] = {}


def forget_long() -> None:
    """Tables that outgrew a slice go; the next long text makes them again."""
    for name in [name for name, table in _tables.items() if len(table) > SLICE_BYTES + 1]:
        del _tables[name]


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        _tables[name] = _powers(base, max(n, SLICE_BYTES + 1))
    return _tables[name]


@dataclass
class Texts:
    """Bytes of some texts end to end; ``offsets`` has one entry more than there are texts."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # index of the first text in its batch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cuts a column into groups of whole texts of about ``most`` bytes; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


@dataclass
class Words:
    starts: np.ndarray  # byte offsets in the slice
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]
    hashes: np.ndarray


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a run ends where its text ends."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[filled] = inside[filled]
    closing = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[closing] = inside[closing]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: Texts) -> Words:
    inside = IS_WORD[texts.data]
    starts, ends = edges(inside, texts.offsets)
    return Words(starts, ends, np.searchsorted(starts, texts.offsets), run_hashes(texts.data, starts, ends))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, letters without case."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _table("powers", _BASE, n + 1)[:n], out=sums[1:])
    run = mixed((sums[ends] - sums[starts]) * _table("inverse", _INVERSE, n + 1)[starts])
    for i, digest in _long_runs(data, starts, ends):
        run[i] = digest[0]
    return run


def _long_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Two words of a digest of every long run."""
    for i in np.flatnonzero(ends - starts > LONG_RUN).tolist():
        run = data[starts[i] : ends[i]]
        yield i, np.frombuffer(hashlib.blake2b((LOWERED[run] if lower else run).tobytes(), digest_size=16).digest(), "<u8")


def pieces(breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts, none empty, in front of every break; starts and ends of what is between cuts."""
    cut = breaks.copy()
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(breaks))


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of byte runs as they are."""
    n = len(data)
    out = []
    for name, base, values in (("powers", _BASE, _EXACT), ("others", _OTHER, _EXACT[::-1])):
        inverse = "inverse" if name == "powers" else "other inverse"
        sums = np.zeros(n + 1, dtype=np.uint64)
        terms = values[data]
        terms *= _table(name, base, n + 1)[:n]
        np.cumsum(terms, out=sums[1:])
        del terms
        out.append(mixed((sums[ends] - sums[starts]) * _table(inverse, pow(base, -1, 1 << 64), n + 1)[starts]))
    for i, digest in _long_runs(data, starts, ends, lower=False):
        out[0][i], out[1][i] = digest
    return out[0], out[1]


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and their bounds; a text of fewer words, but some, is one shingle."""
    counts = np.diff(bounds)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n_out)))
    total = int(out_bounds[-1])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], n_out) + np.arange(total)
    ends = np.repeat(bounds[1:], n_out)
    padded = np.concatenate((hashes, np.zeros(k, dtype=np.uint64)))
    value = np.zeros(total, dtype=np.uint64)
    for j in range(k):
        part = padded[at + j]
        part[at + j >= ends] = 0
        value = mixed(value * np.uint64(3) + part) if j else part
    return mixed(value), out_bounds


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Byte offsets of one text as code point offsets."""
    begins = (data & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))[places]
