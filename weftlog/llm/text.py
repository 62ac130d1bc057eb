"""Vectorised word splitting and hashing over Arrow text buffers, used inside Spark tasks.

A task gets Arrow batches from ``mapInArrow``; ``slices`` cuts them into pieces of a few
megabytes of whole texts, so that the temporary arrays of a task are bounded by
``SLICE_BYTES`` plus the longest single text.  All hashes are 64-bit and depend on the
bytes alone, so every task and every run computes the same ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; one longer text is still taken whole.
SLICE_BYTES = 1 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_tables: dict[str, np.ndarray] = {}


def _grown(name: str, n: int, make) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        _tables[name] = make(1 << max(12, (n - 1).bit_length()))
    return _tables[name][:n]


def _position_keys(n: int) -> np.ndarray:
    return _grown("position", n, lambda m: mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    def make(m: int) -> np.ndarray:
        out = np.full(m, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return _grown(f"powers{base}", n, make)


def space_table() -> np.ndarray:
    """Word bytes: everything but space and tab to carriage return."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_table() -> np.ndarray:
    """Word bytes: ASCII digits and letters and every byte of a non-ASCII character."""
    table = np.zeros(256, dtype=bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


SPACE, ALNUM, LOWER = space_table(), alnum_table(), lower_table()


@dataclass
class Slice:
    """Whole texts ``lo`` to ``hi`` of a batch: their bytes, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks, and would keep their peak."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole texts by about ``limit`` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    release()


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of word bytes; none crosses the start of a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    begins[cut] = inside[cut]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    closes[cut] = inside[cut]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (spans ascend and do not overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    head = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(head, lengths)
    used = data[place + np.repeat(starts, lengths)].astype(np.uint64)
    used += np.uint64(1)
    used *= _position_keys(int(lengths.max()))[place]
    return mix(np.add.reduceat(used, head) + lengths.astype(np.uint64))


def words(piece: Slice, table: np.ndarray = SPACE, lower: bool = False) -> Words:
    data = LOWER[piece.data] if lower else piece.data
    starts, ends = spans(data, piece.offsets, table)
    return Words(starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, piece.offsets))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values, by differences of a prefix sum."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n), out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * _powers(_INVERSE, n - width + 1))


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end] for many spans; equal to ``window_hashes`` for equal widths."""
    n = len(hashes)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n), out=prefix[1:])
    return mix((prefix[end] - prefix[begin]) * _powers(_INVERSE, n + 1)[begin])


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word numbers at which a window of ``width`` words of one text begins."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
