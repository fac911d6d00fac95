"""Flat numpy views of an Arrow string column.

A batch of texts is treated as one byte buffer plus row offsets, so that words, lines and
n-grams of all its rows are found and hashed by a few vector operations. Batches are cut into
chunks of bounded bytes first: the arrays below cost some tens of bytes for each byte of text.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; since those are ASCII,
this is the same as splitting the decoded text. Spans are hashed with a polynomial prefix hash
modulo 2**64 and a final mix, so equal bytes hash alike wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that start a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(U64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: neighbouring inputs give unrelated outputs."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), _BASE if kind == "up" else _INVERSE, U64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step)
    return have[:n]


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; nulls are empty; a longer row comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: a maximal run of bytes that are not in ``gap``."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * _power("up", len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end of the buffer that ``sums`` was made from."""
    h = (sums[end] - sums[start]) * _power("down", len(sums))[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SLOT = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingles(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every window of n words that stays in one row."""
    if len(words) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
    h = np.zeros(len(at), U64)
    for j in range(n):
        h += words[at + j] * _SLOT[j]
    return mix(h), at


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each byte) between the row offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given spans one after another, and their offsets."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return buf[at], offsets


def span_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given spans as an Arrow string array."""
    data, offsets = row_bytes(buf, start, end)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
