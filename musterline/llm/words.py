"""Vectorised words and hashes over the UTF-8 bytes of Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK // 4)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of one text; fold lower-cases A-Z."""
    table = _FOLDED if fold else _BYTE
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + BLOCK, len(data))
        while hi < len(data):  # end the block at white space
            more = np.flatnonzero(_SPACE[data[hi : hi + 4096]])
            if len(more):
                hi += int(more[0])
                break
            hi = min(hi + 4096, len(data))
        block = data[lo:hi]
        inside = np.zeros(len(block) + 2, np.int8)
        inside[1:-1] = ~_SPACE[block]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up = powers(_BASE, len(block))
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(table[block] * up, out=total[1:])
            down = powers(pow(_BASE, -1, 1 << 64), len(block))
            hashes.append(mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + lo)
            ends.append(e + lo)
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def document_words(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, its bytes, starts, ends, hashes). Short neighbours are hashed together, in blocks."""
    data, at = text_bytes(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK // 2, side="right")) - 1)
        hi = min(hi, n)
        if hi == lo + 1:
            text = data[at[lo] : at[hi]]
            yield lo, text, *word_hashes(text, fold)
        else:
            size = np.diff(at[lo : hi + 1])
            joined = np.full(int(at[hi] - at[lo]) + hi - lo, 0x20, np.uint8)
            shift = np.repeat(np.arange(hi - lo), size)
            joined[np.arange(len(shift)) + shift] = data[at[lo] : at[hi]]
            s, e, h = word_hashes(joined, fold)
            begin = at[lo:hi] - at[lo] + np.arange(hi - lo)
            cut = np.searchsorted(s, np.append(begin, len(joined)))
            for k in range(hi - lo):
                a, b = cut[k], cut[k + 1]
                yield lo + k, data[at[lo + k] : at[lo + k + 1]], s[a:b] - begin[k], e[a:b] - begin[k], h[a:b]
        lo = hi


def runs_hash(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k neighbours in a row; none where there are fewer than k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = (_BASE * (2 * seed + 3)) % (1 << 64) | 1
    up, down = powers(base, len(h)), powers(pow(base, -1, 1 << 64), len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def whole_hash(h: np.ndarray, seed: int = 0) -> int:
    """Hash of a sequence and its length."""
    if not len(h):
        return 0
    base = (_BASE * (2 * seed + 5)) % (1 << 64) | 1
    return int(mixed(np.array([(h * powers(base, len(h))).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))[0])


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle as a whole."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < k:
        return np.array([whole_hash(h, 7)], np.uint64)
    return np.unique(runs_hash(h, k))


def word_counts(column: pa.Array) -> pa.Array:
    """Words of each row; null counts 0."""
    data, at = text_bytes(column)
    out = np.zeros(len(at) - 1, np.int64)
    lo = 0
    while lo < len(out):
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 8 * BLOCK, side="right")) - 1), len(out))
        inside = ~_SPACE[data[at[lo] : at[hi]]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = at[lo:hi] - at[lo]
        begin = begin[begin < len(inside)]
        first[begin] = inside[begin]  # a text begins anew
        total = np.append(0, np.cumsum(first))
        out[lo:hi] = np.diff(total[at[lo : hi + 1] - at[lo]])
        lo = hi
    return pa.array(out)
