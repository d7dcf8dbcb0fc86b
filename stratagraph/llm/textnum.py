"""Vectorised text arithmetic for Arrow batches.

A batch of texts is looked at as one byte buffer with document offsets, so
that splitting, hashing and window work cost a few numpy passes for a whole
batch instead of a Python step for each word.  Memory is bounded by cutting
a batch into runs of whole documents of about ``CHUNK`` bytes; only a single
document that is larger than that makes a larger run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True  # the word contracts: space and 0x09-0x0D

_tables: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of its inverse); base is odd."""
    have = _tables.get((base, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        size += size // 2
        step = np.full(size, pow(base, -1, 1 << 64) if inverse else base, _U)
        step[0] = 1
        have = np.cumprod(step)
        _tables[(base, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def runs(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents."""
    if not len(column):
        return
    raw, offsets = buffers(column)
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(offsets) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and each document's first word."""
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte unchanged."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order, not empty, and don't overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    source = place + np.repeat(starts, lengths)
    value = (data[source].astype(_U) + _U(1)) * powers(_BYTE_BASE, int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, self.n = base, len(values)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Of each k consecutive values."""
        if self.n < k:
            return np.zeros(0, _U)
        return mix((self.sums[k:] - self.sums[:-k]) * powers(self.base, self.n - k + 1, True))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        got = (self.sums[ends] - self.sums[starts]) * powers(self.base, self.n + 1, True)[starts]
        return mix(got + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """A mask of the n places that some span covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0
