"""Vectorised words and shingles of Arrow text columns.

Texts are taken as UTF-8 bytes of one buffer; words, their 64-bit hashes and
their documents come out as NumPy arrays without a Python step per word.  Only
ASCII bytes are looked at (white space, A-Z), so multi-byte code points pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once.  A longer document is one block of its own.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, multiply, twice)."""
    h = h ^ U(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def blocks(col: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of about ``size`` bytes each."""
    raw, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each row (one more than rows)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ws = _WS[raw]
    gap = np.empty(n + 1, bool)  # gap[i]: a word can't reach over the border before byte i
    gap[0] = gap[n] = True
    gap[1:n] = ws[:-1]
    gap[off] = True
    starts = np.flatnonzero(~ws & gap[:n])
    gap[1:n] = ws[1:]
    gap[off] = True
    ends = np.flatnonzero(~ws & gap[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of the bytes of each span, A-Z in lower case."""
    n = len(raw)
    up, down = _powers(1 << max(10, n.bit_length()))
    terms = (_LOW[raw] if lower else raw).astype(U)
    terms += U(1)
    terms *= up[:n]
    total = np.zeros(n + 1, U)
    np.cumsum(terms, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0x8CB92BA72F3D8DD7))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of the first word of each row (one more than rows)."""
    starts, ends, first = word_spans(raw, off)
    if not len(starts):
        return np.zeros(0, U), first
    return span_hashes(raw, starts, ends), first


_C = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted inside it: hashes and row borders.

    A row with fewer words has its whole sequence as one; without words, none.
    """
    n_rows = len(first) - 1
    count = np.diff(first)
    n = len(h)
    m = max(0, n - k + 1)
    s = np.zeros(m, U)
    for j in range(k):
        s += h[j : j + m] * U(_C[j % len(_C)] + 2 * (j // len(_C)))
    s = mix(s, k)
    row = np.repeat(np.arange(n_rows), count)
    ok = row[:m] == row[n - m :] if m else np.zeros(0, bool)
    s, srow = s[ok], row[:m][ok]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        part = np.zeros(len(few), U)
        for j in range(k - 1):
            on = count[few] > j
            part[on] += h[first[few[on]] + j] * U(_C[j % len(_C)] + 2 * (j // len(_C)))
        part = mix(mix(part, k) + count[few].astype(U), 77)
        s, srow = np.concatenate([s, part]), np.concatenate([srow, few])
    order = np.lexsort((s, srow))
    s, srow = s[order], srow[order]
    if len(s):
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (srow[1:] != srow[:-1])
        s, srow = s[keep], srow[keep]
    return s, np.searchsorted(srow, np.arange(n_rows + 1))
