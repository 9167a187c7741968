"""Vectorised words over UTF-8 buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; the texts
are lowered in the JVM before. All functions take Arrow string arrays and never
loop over rows in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the row of each."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = _WORD[data]
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    after[heads[1:] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    powers = np.ones(int(sizes.max()), np.uint64)
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    at = inside + np.repeat(starts, sizes)
    return mix(np.add.reduceat((data[at].astype(np.uint64) + _U(1)) * powers[inside], firsts))


def grams(words: np.ndarray, rows: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position in the row) of all n-grams of words within a row.

    With ``short``, a row of fewer than n words, but of one at least, has one gram of them all.
    """
    if not len(words):
        return words, rows, rows
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    position = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.r_[firsts, len(rows)]))
    m = len(words) - n + 1
    out, of, at = np.zeros(0, np.uint64), np.zeros(0, rows.dtype), np.zeros(0, np.int64)
    if m > 0:
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g = g * _M1 + words[j : j + m]
        ok = rows[:m] == rows[n - 1 :]
        out, of, at = mix(g[ok]), rows[:m][ok], position[:m][ok]
    if short:
        counts = np.diff(np.r_[firsts, len(rows)])
        few = counts < n
        if few.any():
            w = words * np.take(np.multiply.accumulate(np.full(n + 1, _M1)), np.minimum(position, n))
            g = mix(np.add.reduceat(w, firsts)[few] + counts[few].astype(np.uint64))
            out, of, at = np.r_[out, g], np.r_[of, rows[firsts][few]], np.r_[at, np.zeros(len(g), np.int64)]
            order = np.argsort(of, kind="stable")
            out, of, at = out[order], of[order], at[order]
    return out, of, at


def long_grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``grams`` without the short rows, in time that doesn't grow with n: differences of prefix sums of w[i] * M^i, divided by M^i."""
    if len(words) < n:
        return words[:0], rows[:0], rows[:0]
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    position = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.r_[firsts, len(rows)]))
    up, down = (np.full(len(words), x, np.uint64) for x in (_M1, _U(pow(int(_M1), -1, 1 << 64))))
    up[0] = down[0] = 1
    sums = np.r_[_U(0), np.cumsum(words * np.multiply.accumulate(up))]
    m = len(words) - n + 1
    ok = rows[:m] == rows[n - 1 :]
    g = (sums[n:] - sums[:m]) * np.multiply.accumulate(down)[:m]
    return mix(g[ok]), rows[:m][ok], position[:m][ok]


def pack48(x: np.ndarray) -> bytes:
    """The low 48 bits of each number, 6 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")
