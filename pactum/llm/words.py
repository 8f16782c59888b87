"""Words and word shingles of UTF-8 text, hashed a whole Arrow slice at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Both only concern ASCII
bytes, so working on the UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.random.default_rng(20240502).integers(1, 2**63, 64, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if pa.types.is_large_string(column.type):
        column, kind = column, np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = 256_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row that is longer; a byte takes up to some 100 bytes of a worker."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def returning_memory(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which the worker, which Spark keeps, gives the memory that it no longer uses back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept by the worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            one = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(size - 1, _INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, offsets of each row's words)."""
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, powers: Powers) -> list[np.ndarray]:
    """For each row its distinct ``width``-word shingles as sorted 64-bit hashes.

    A row with fewer words, but at least one, has its whole word sequence as its one shingle.
    """
    hashes, at = word_hashes(data, offsets, powers)
    count = np.diff(at)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        rolled = hashes[:n] * _PLACE[0]
        for k in range(1, width):
            rolled += hashes[k : k + n] * _PLACE[k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for row in range(len(count)):
        first, words = at[row], count[row]
        if words >= width:
            part = np.sort(rolled[first : first + words - width + 1])
            out.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
        elif words:
            few = (hashes[first : first + words] * _PLACE[:words]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(few + _PLACE[40 + words : 41 + words]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
