"""Vectorised helpers over Arrow batches of whole texts: words, and hashes of words and of runs of words.

A word is a run of bytes other than space and 0x09-0x0D. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at once; a longer text is handled alone, never cut.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n-1, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 256), BASE, np.uint64)
        step[0] = 1
        _POWERS = np.cumprod(step)
    return _POWERS[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def released() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Steps = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Made = TypeVar("Made")


def swept(run: Steps) -> Steps:
    """``run``, after whose end memory goes back to the system: that of its own variables too, which are still held when its batches end."""

    def swept_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return swept_run


def alone(made: Made) -> Made:
    """``made``, of which only the result is still held: memory that making it took goes back to the system."""
    released()
    return made


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def segments(data: np.ndarray, offsets: np.ndarray, is_separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes; a run never crosses from one text to the next."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~is_separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    codes = BYTE_CODE[data[place + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))


class Words:
    """The words of a slice: ``starts``, ``ends``, ``hash``; text i has words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: pa.Array | tuple[np.ndarray, np.ndarray], lower: bool = False):
        self.data, self.offsets = texts if isinstance(texts, tuple) else flat(texts)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends = segments(self.data, self.offsets, IS_SEPARATOR)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hash = hashes(self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """For each word, the text it is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of ``k`` words within one text starts, and the run's hash."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        document = self.document()
        at = np.flatnonzero(document[:n] == document[k - 1 :])
        return at, run_hashes(self.hash, k)[at]


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive codes, by doubling."""
    total, done, power, size, left = None, 0, int(BASE), 1, k
    current = codes
    while True:
        if left & 1:
            n = len(codes) - done - size + 1
            total = current[:n] if total is None else total[:n] * np.uint64(power) + current[done : done + n]
            done += size
        left >>= 1
        if not left:
            return mix(total + np.uint64(k))
        n = len(current) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        current = current[:n] * np.uint64(power) + current[size : size + n]
        power, size = power * power % 2**64, size * 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 3) if data else b""


def spread(data: bytes) -> bytes:
    return zstandard.decompress(data) if data else b""


def pack(values: np.ndarray) -> bytes:
    """The array's bytes of equal weight side by side, compressed."""
    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()) if len(values) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(spread(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    """Consecutive parts of ``data``."""
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted keys changes."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(changes(key)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n
