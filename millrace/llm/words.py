"""Words of whole Arrow text columns as numpy arrays: places, 64-bit hashes, and hashes of runs of words.

All separators are single ASCII bytes, so UTF-8 text is split byte by byte without decoding it. A hash is a sum of
table values times powers of an odd number, modulo 2**64, so the hash of any stretch is a difference of prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at a time; a longer text is one piece by itself.
PIECE_BYTES = 2 << 20
HASHED_BYTES = 1 << 18

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE, _RUN_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes of the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Words are `[^\x20\x09-\x0D]+`.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lowered.
PLAIN = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NEWLINE = separators((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KNOWN_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of `base` and of its inverse, at least n + 1 of them; a worker keeps the longest list it needed."""
    known = _KNOWN_POWERS.get(int(base))
    if known is None or len(known[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(int(base), -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        known = _KNOWN_POWERS[int(base)] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return known


class Texts:
    """The texts of an Arrow column as bytes without gaps; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.data = raw[bounds[0]:bounds[-1]]
        self.n = len(column)

    def spans(self, separator: np.ndarray, lower: bool = False, keep_empty: bool = False) -> Spans:
        """The stretches between separators; `keep_empty` also counts those of no byte (lines)."""
        data = LOWER[self.data] if lower else self.data
        filled = np.flatnonzero(np.diff(self.bounds))
        if keep_empty:
            cut = np.flatnonzero(separator[data])
            starts = np.sort(np.concatenate([self.bounds[:-1], cut + 1]), kind="stable")
            ends = np.sort(np.concatenate([self.bounds[1:], cut]), kind="stable")
            inside = np.searchsorted(cut, self.bounds)
            counts = np.diff(inside) + 1
        else:
            inner = ~separator[data]
            first, last = inner.copy(), inner.copy()
            first[1:] &= ~inner[:-1]
            last[:-1] &= ~inner[1:]
            first[self.bounds[filled]] = inner[self.bounds[filled]]
            last[self.bounds[filled + 1] - 1] = inner[self.bounds[filled + 1] - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            counts = np.diff(np.searchsorted(starts, self.bounds))
        return Spans(data, starts, ends, counts)


class Spans:
    """Words (or lines) of a piece: byte places, how many each text has, and their hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.data, self.starts, self.ends, self.counts = data, starts, ends, counts.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.text = np.repeat(np.arange(len(counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each stretch, some HASHED_BYTES of text at a time."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + HASHED_BYTES, side="right")))
            part = self.data[low:self.ends[j - 1]]
            up, down = powers(_BASE, len(part))
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[part] * up[:len(part)], out=total[1:])
            start = self.starts[i:j] - low
            out[i:j] = (total[self.ends[i:j] - low] - total[start]) * down[start]
            i = j
        return mix(out)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words of one text."""
        at = np.arange(max(0, len(hashes) - k + 1))
        at = at[self.text[at] == self.text[at + k - 1]] if len(at) else at
        return at, run_hashes(hashes, at, at + k)


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, from the hashes of words."""
    up, down = powers(_RUN_BASE, len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


#: What drops the things that a worker keeps from task to task for work of another kind.
FORGET: list[Callable[[], None]] = []


def trim() -> None:
    """Give the system back what is free in this process; freed arrays are else kept by the C library, and buffers by Arrow."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it.
    if free:
        free(0)


def release() -> None:
    """Forget what other kinds of work have kept, and give back what is free.

    A worker waits for its next task with all it holds, beside an executor whose own memory is full.
    """
    for forget in FORGET:
        forget()
    trim()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of batches of at most PIECE_BYTES of text, or of one longer text. Free memory is released before and after."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = Texts(batch.column(column)).bounds
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + PIECE_BYTES, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            part = batch.slice(start, end - start)
            yield part, Texts(part.column(column))
            start = end
    release()


def longs(column: pa.Array) -> np.ndarray:
    """A column of longs as int64; it may hold no nulls."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def sum_by(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers or booleans per id, as int64."""
    return np.bincount(ids, weights=values, minlength=n).astype(np.int64)


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values that hold values[cuts[i]:cuts[i + 1]]."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64) * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values in a column of blobs."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
