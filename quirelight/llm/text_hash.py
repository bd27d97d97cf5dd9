"""Vectorised word and shingle hashing over Arrow string buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
All byte values involved are ASCII, so working on UTF-8 bytes gives the same
words as working on code points.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
SHINGLE_BYTES = 1 << 18  # of texts whose shingles are made at once

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK_BYTES * 2:
        return _power_table(_BASE, n), _power_table(_INVERSE, n)
    if not _tables or len(_tables["up"]) < n:
        most = min(CHUNK_BYTES * 2, 1 << (n - 1).bit_length())
        _tables["up"], _tables["down"] = _power_table(_BASE, most), _power_table(_INVERSE, most)
    return _tables["up"][:n], _tables["down"][:n]


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def lowered(raw: np.ndarray) -> np.ndarray:
    return _lower[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, last byte) of each word; a row's end also ends a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_blank[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    starts = first[:-1].copy()
    starts[1:] |= ~solid[:-1]
    ends = first[1:].copy()
    ends[:-1] |= ~solid[1:]
    ends[-1] = True
    return np.flatnonzero(starts & solid), np.flatnonzero(ends & solid)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, number of words of each row)."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(n, np.int64)
    starts, ends = word_spans(raw, offsets)
    up, down = _powers(len(raw))
    total = np.cumsum((_lower[raw].astype(U) + U(1)) * up, dtype=U)
    hashes = total[ends]
    inner = starts > 0
    hashes[inner] -= total[starts[inner] - 1]
    hashes = mix(hashes * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts.astype(np.int64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each ``width``-word window in order, windows of each row).

    A row with fewer words, but one at least, has its whole sequence as its
    only shingle; a row without words has none.
    """
    have = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(have.sum()), U)
    if not len(out):
        return out, have
    factor = [U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
    at = np.concatenate([[0], np.cumsum(counts)])
    to = np.concatenate([[0], np.cumsum(have)])
    long = counts >= width
    if long.any():
        m = len(words) - width + 1
        whole = np.zeros(m, U)
        for k in range(width):
            whole += words[k : k + m] * factor[k]
        row = np.repeat(np.arange(len(counts)), have)
        inside = long[row]
        source = (np.arange(len(out)) - to[row] + at[row])[inside]
        out[inside] = mix(whole[source])
    for i in np.flatnonzero((counts > 0) & ~long):
        w = words[at[i] : at[i + 1]]
        out[to[i]] = mix((w * np.array(factor[: len(w)], U)).sum(dtype=U, keepdims=True) + U(len(w)))[0]
    return out, have


def row_shingles(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingle hashes in ascending order) for each row."""
    raw, offsets = texts_of(column)
    for a, b in chunks(offsets, SHINGLE_BYTES):
        part = raw[offsets[a] : offsets[b]]
        sh, have = shingle_hashes(*word_hashes(part, offsets[a : b + 1] - offsets[a]), width)
        at = np.concatenate([[0], np.cumsum(have)])
        for i in range(b - a):
            yield a + i, np.unique(sh[at[i] : at[i + 1]])
