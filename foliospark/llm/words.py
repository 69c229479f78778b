"""Vectorised word kernel shared by the Python-side operators.

A word is a maximal run of bytes outside ``20 09-0D``.  All separators are
single ASCII bytes, so words can be found on the UTF-8 bytes of many texts at
once.  Each word gets a 64-bit hash: a polynomial over a fixed random byte
table, modulo 2**64, finished with a mixer.  No Python object is made for a
word, and memory is about 60 bytes for each byte of the texts handed in, so
callers go through :func:`slices` to keep a call near ``target`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240131).integers(1, 2**64, size=256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        kept = _powers[base] = np.multiply.accumulate(steps)
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts_of(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n+1 offsets; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` text bytes; a longer text stands alone."""
    _, offsets = texts_of(array)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + target, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


class Words:
    """Words of a run of texts, in order."""

    __slots__ = ("bytes", "doc", "ends", "first", "hashes", "starts")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            raw = _LOWER[raw]
        n = len(raw)
        self.bytes = raw
        space = np.ones(n + 2, dtype=bool)
        space[1:-1] = _SPACE[raw]
        word = ~space[1:-1]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(word & (space[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word & (space[2:] | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * powers(_BASE, n), out=sums[1:])
        spans = (sums[self.ends] - sums[self.starts]) * powers(_INVERSE, n + 1)[self.starts]
        self.hashes = mix(spans + (self.ends - self.starts).astype(np.uint64))
        #: first[d] .. first[d+1] are the words of text d.
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @classmethod
    def of(cls, array: pa.Array, lower: bool = False) -> Words:
        return cls(*texts_of(array), lower=lower)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive word hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_BASE, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_INVERSE, n + 1)[: n - size + 1])
