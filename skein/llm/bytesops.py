"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

Worker code processes a batch in chunks of whole rows of about ``CHUNK_BYTES``
bytes, so temporaries stay small; a single longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C17                    # odd, P - 1 twice an odd number
_SEEDS = np.random.default_rng(20240607).integers(1, 2 ** 63, 256, dtype=np.uint64)


def lower_table() -> np.ndarray:
    """Byte map A-Z -> a-z, other bytes unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def text_arrays(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    buf = col.buffers()
    if len(col) == 0 or buf[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(buf[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True as (start, end), never across a row boundary."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = offsets[(offsets > 0) & (offsets < n)]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[edge] = mask[edge]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[edge - 1] = mask[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row that holds each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """64-bit hashes of byte spans by prefix sums of b_i * P^i (mod 2^64)."""

    def __init__(self) -> None:
        self._pw = np.ones(1, np.uint64)
        self._ipw = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._pw) < n:
            inv = pow(_P, -1, 1 << 64)
            pw = np.full(n, _P, np.uint64)
            ipw = np.full(n, inv, np.uint64)
            pw[0] = ipw[0] = 1
            self._pw, self._ipw = np.multiply.accumulate(pw), np.multiply.accumulate(ipw)

    def sums(self, data: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Prefix sums over the bytes; ``table`` has a seed per byte."""
        n = len(data)
        self._powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * self._pw[:n], out=c[1:])
        return c

    def of(self, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end) from the prefix sums."""
        return mix64((c[end] - c[start]) * self._ipw[start] + (end - start).astype(np.uint64))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
        return self.of(self.sums(data, table), start, end)


def seed_table(fold: np.ndarray | None = None) -> np.ndarray:
    """A random 64-bit value per byte, after folding bytes (for example to lower case)."""
    return _SEEDS if fold is None else _SEEDS[fold]
