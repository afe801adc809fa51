"""Vectorised text helpers that run inside Spark tasks.

Texts arrive as Arrow string columns. ``slices`` cuts a batch into pieces of bounded
bytes, ``flat`` views one piece as a single byte array with offsets, and the rest works on
that array: word boundaries, 64-bit word hashes, shingle hashes. Nothing here loops over
characters, and nothing holds more than one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 2 << 20
LONG_WORD = 256  # words of more bytes are hashed one by one

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def whole(column: pa.Array) -> pa.Array:
    """The column as non-null strings with 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PIECE_BYTES of text; a row is never cut."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(size.astype(np.int64)) - size) // PIECE_BYTES
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes A-Z lower-cased, with eight spare bytes at the end, and each row's offsets."""
    column = whole(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = LOWER[raw]
    return out, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACES) -> tuple[np.ndarray, ...]:
    """Start and end of each maximal run of non-separator bytes, and each row's first word."""
    n = int(offsets[-1])
    inside = ~separator[data[:n]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on, as one integer."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    view, length = eights(data), end - start
    first = view[start] & MASKS[np.minimum(length, 8)]
    out = mix(first + length.astype(np.uint64) * C1)
    todo = np.flatnonzero(length > 8)
    at = 8
    while len(todo) and at < LONG_WORD:
        part = view[start[todo] + at] & MASKS[np.minimum(length[todo] - at, 8)]
        out[todo] = mix(out[todo] * C1 + part)
        at += 8
        todo = todo[length[todo] > at]
    for i in todo:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; the caller drops those that cross rows."""
    m = max(len(hashes) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out + hashes[k : k + m]) * C1
    return mix(out)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct n-word shingles, sorted; all words as one shingle where they are fewer."""
    every = runs(hashes, n)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= n:
            own = np.sort(every[lo : hi - n + 1])
            yield own[np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))]
        elif hi > lo:
            yield runs(hashes[lo:hi], int(hi - lo)) + U(hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
