"""UTF-8 text of Arrow batches as numpy arrays: words, lines and their hashes without Python strings.

``Texts`` views the string column of a few rows as one byte array with row
offsets. Nothing crosses a row boundary. Null text is empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 19  # bytes of text that are worked on at once
CHUNK = 256  # bytes that are hashed as one polynomial


def tidy(run: Callable) -> Callable:
    """A map over batches after which a worker gives its free memory back, as workers outlive their tasks."""

    @wraps(run)
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


def give_back() -> None:
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=U64) | U64(1)


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    """``base**i mod 2**64`` for i < n."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def table_of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~table_of(SPACE)
NEWLINE = 10


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null rows have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Consecutive rows of ``batch`` with about ``limit`` bytes of text; a longer text stands alone."""
    data, off = string_buffers(batch.column(column))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), Texts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


class Texts:
    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data, self.off, self.n = data, off, len(off) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged lie in each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def starts_characters(self) -> np.ndarray:
        return (self.data & 0xC0) != 0x80

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes within rows: starts, ends, row of each."""
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.off] = True
        starts = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        ends = np.flatnonzero(before[1:] & (~after[1:] | cut[1:])) + 1
        return starts, ends, np.searchsorted(self.off, starts, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines split at newlines: starts, ends, row of each. An empty row has one empty line."""
        nl = np.flatnonzero(self.data == NEWLINE)
        starts = np.concatenate([self.off[:-1], nl + 1])
        ends = np.concatenate([nl, self.off[1:]])
        row = np.concatenate([np.arange(self.n), np.searchsorted(self.off, nl, "right") - 1])
        order = np.lexsort((starts, row))
        # A row has as many ends as starts, and both rise with the row.
        end_row = np.concatenate([np.searchsorted(self.off, nl, "right") - 1, np.arange(self.n)])
        return starts[order], ends[np.lexsort((ends, end_row))], row[order]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans: equal bytes give equal hashes wherever they stand.

        A polynomial modulo 2**64 has known collisions from some 1000 bytes on, whatever
        its base. So no more than ``CHUNK`` bytes are hashed by one; a longer
        span's chunks are mixed one after the other.
        """
        data = self.data if data is None else data
        sums = np.zeros(len(data) + 1, U64)
        room = max(PIECE, 1 << max(0, len(data) - 1).bit_length())
        np.cumsum(byte_codes()[data] * powers(room, BASE)[: len(data)], out=sums[1:])
        inverse = powers(room + 1, INVERSE)
        plain = lambda lo, hi: mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(U64))
        long = np.flatnonzero(ends - starts > CHUNK)
        out = plain(starts, np.minimum(ends, starts + CHUNK))
        at = starts[long] + CHUNK
        while len(long):
            upto = np.minimum(ends[long], at + CHUNK)
            out[long] = mix(out[long] * U64(BASE) + plain(at, upto))
            more = upto < ends[long]
            long, at = long[more], upto[more]
        return out


def first_of_windows(row: np.ndarray, k: int) -> np.ndarray:
    """Indices i such that items i..i+k-1 belong to one row (``row`` rises)."""
    if len(row) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])


def window_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), U64)
    for i in range(k):
        out = out * U64(BASE) + h[at + i]
    return mix(out)
