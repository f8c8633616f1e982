"""Whole columns of texts as numpy arrays: bytes, words and their hashes, without a Python step for each word.

Texts come as Arrow columns and are looked at in pieces of bounded size. Words are hashed by one
polynomial over the bytes (a prefix sum, so a word costs two look-ups) and then mixed; two
words of the usual lengths share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at in one go, so that the arrays stay in the CPU's cache.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Byte classes: words between white space; words of letters, digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def power(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more offset than texts). Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string()) if col.null_count else col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def groups(at: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many texts, and of at most so many bytes together, or one longer text."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1), lo + rows)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word of the class; words don't cross texts."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[buf]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + PIECE, "right")))
        n = int(end[hi - 1]) - base
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf[base : base + n].astype(np.uint64) + np.uint64(1)) * power(_BASE, n), out=sums[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * power(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def counts_in(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)[:n]

