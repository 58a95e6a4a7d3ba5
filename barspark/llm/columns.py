"""Numpy views of Arrow text columns, and hashes of their words and word shingles.

Everything here works on a slice of a column at a time; a slice ends after slice_bytes
or after the one text that passes them, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U64 = np.uint64


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def large_strings(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and odd multipliers)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_STEP = U64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A random 64-bit value per (lower-cased) byte.
_BYTE = mix64((_LOWER + 1).astype(U64) * _STEP)
_place = np.empty(0, U64)


def _places(n: int) -> np.ndarray:
    """Odd multipliers of the first n places of a word."""
    global _place
    if n > 1 << 20:
        return mix64((np.arange(n, dtype=U64) + U64(7)) * _STEP) | U64(1)
    if len(_place) < n:
        _place = mix64((np.arange(max(n, 256), dtype=U64) + U64(7)) * _STEP) | U64(1)
    return _place


def segment_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each segment of 64-bit values: a sum of values times a multiplier of their place, and the length."""
    if not len(starts):
        return np.empty(0, U64)
    inside = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = values[np.repeat(starts, lengths) + inside] * _places(int(lengths.max()))[inside]
    return mix64(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(U64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased), and each text's first word number (one more at the end)."""
    if not len(data):
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    word = ~_SEPARATOR[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | border[:-1]))
    after = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~after | border[1:])) + 1
    hashes = segment_hashes(_BYTE[data], start, end - start)
    return hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words in text order (of the whole sequence where it is shorter), and each text's first."""
    counts = np.diff(firsts)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(made)])
    if not out_first[-1]:
        return np.empty(0, U64), out_first
    weight = _places(width)
    padded = np.concatenate([hashes, np.zeros(width, U64)])
    run = np.zeros(len(hashes), U64)
    for j in range(width):
        run += mix64(padded[j : j + len(hashes)] + U64(j)) * weight[j]
    at = np.repeat(firsts[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    out = mix64(run[at] + np.array([width], U64) * _STEP)
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        part = hashes[firsts[d] : firsts[d + 1]]
        places = np.arange(len(part), dtype=U64)
        out[out_first[d]] = mix64((mix64(part + places) * weight[: len(part)]).sum(keepdims=True) + np.array([len(part)], U64) * _STEP)[0]
    return out, out_first
