"""Vectorised text handling inside tasks: words, word hashes and size-bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: A word is a maximal run of bytes outside ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if _powers[kind].size < n:
        steps = np.full(max(n, 1 << 21), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def slices(texts: pa.Array, limit: int = 1 << 21, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes and ``rows`` texts each; a longer text is a range of its own."""
    ends = text_bytes(texts)[1]
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), len(texts), at + rows)
        yield at, stop
        at = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and the offsets of the texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat = texts.cast(pa.large_binary())
    if flat.null_count:
        flat = flat.fill_null(b"")
    if len(flat) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (with the total last)."""
    n = data.size
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(offsets.size, np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~space[data]
    starts, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = solid[inner + 1]
    ends[inner - 1] = solid[inner]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", data.size), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", max(data.size, 1))[starts] if starts.size else np.zeros(0, np.uint64)
    return mix(h + (ends - starts).astype(np.uint64))


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(bounds.size - 1), np.diff(bounds))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of every entry's value in order of first appearance, the values, and where each first stands."""
    import pandas as pd

    codes, values = pd.factorize(hashes)
    first = np.zeros(values.size, np.int64)
    first[codes[::-1]] = np.arange(codes.size - 1, -1, -1)
    return codes, values, first


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges of ``sizes`` from ``begins``, one after the other."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if upto.size else 0) + np.repeat(begins - upto + sizes, sizes)


class Ranges:
    """Arrays of differing lengths kept one after the other in a growing buffer."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.begin, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + flat.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + sizes.size > self.begin.size:
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.size[self.n : self.n + sizes.size] = sizes
        self.begin[self.n : self.n + sizes.size] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + flat.size] = flat
        self.used, self.n = self.used + flat.size, self.n + sizes.size

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the given numbers one after the other, and their sizes."""
        sizes = self.size[index]
        return self.flat[spread(self.begin[index], sizes)], sizes


def grown(schema: T.StructType, **added: str) -> T.StructType:
    """The schema with columns at its end."""
    return T.StructType([*schema.fields, *[T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in added.items()]])
