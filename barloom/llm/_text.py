"""Vectorised text kernels over Arrow string buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D.  Hashes of words up to LONG_WORD bytes are
polynomial sums modulo 2**64 taken with one cumulative sum per chunk of bytes, then mixed; longer words, for
which such sums have known collisions, are hashed one by one with xxh3.  Hashes depend on the bytes alone, so
every task and every retry sees the same values.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

U64 = np.uint64
CHUNK = 1 << 18
LONG_WORD = 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values that follow from the seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse for one chunk, and a random value for each byte."""

    def __init__(self, seed: int):
        self.table = stream(seed, 256)
        base = int(stream(seed + 77, 1)[0]) | 5
        up, down = np.full(CHUNK + 1, base, U64), np.full(CHUNK + 1, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            self.up, self.down = np.cumprod(up), np.cumprod(down)


_POWERS: dict[int, _Powers] = {}


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks() if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and of every document the range of its words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are in order and do not overlap."""
    if seed not in _POWERS:
        _POWERS[seed] = _Powers(seed)
    p, out = _POWERS[seed], np.empty(len(start), U64)
    size = end - start
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    short = np.flatnonzero(size <= LONG_WORD) if len(size) and size.max() > LONG_WORD else slice(None)
    first, last = start[short], end[short]
    found = np.empty(len(first), U64)
    i = 0
    while i < len(first):
        lo = first[i]
        j = int(np.searchsorted(last, lo + CHUNK, "right"))
        hi = last[j - 1]
        total = np.zeros(hi - lo + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(p.table[data[lo:hi]] * p.up[: hi - lo], out=total[1:])
            s, e = first[i:j] - lo, last[i:j] - lo
            found[i:j] = mix((total[e] - total[s]) * p.down[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
        i = j
    out[short] = found
    return out


def trimmed(run):
    """run, a function over batches, after which the worker gives freed memory back: other tasks use the worker again."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def windows(hashed: np.ndarray, first: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each run of ``size`` words within one document."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U64)
        for k, c in enumerate(stream(seed, size)):
            total += hashed[k : k + n] * (c | U64(1))
    whole = np.ones(n, bool)
    for cut in range(1, size):  # a window may not run over a document's end
        at = first[1:-1] - cut
        whole[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(whole)
    return mix(total[at]), at


def doc_of(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The document's row of each word index."""
    return np.searchsorted(first, at, "right") - 1


def slices(sizes: np.ndarray, limit: int = 4 << 20):
    """(lo, hi) row ranges of at most ``limit`` bytes each, one row at least; sizes: bytes by row."""
    total, lo = np.r_[0, np.cumsum(sizes)], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """The batch in parts of a bounded number of text bytes."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0), np.int64)
    for lo, hi in slices(sizes, limit):
        yield batch.slice(lo, hi - lo)
