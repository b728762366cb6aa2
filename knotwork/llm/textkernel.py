"""Vectorised words and shingles over the UTF-8 buffers of an Arrow text column.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
Nothing here loops over characters or words in Python: a batch of documents is one
byte array, and a word's 64-bit hash is folded from its eight-byte pieces.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators for letter words: every ASCII byte but letters and digits.
ALNUM_SEP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: The same with digits as separators.
LETTER_SEP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(bounds) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Runs (first, last) of documents of at most ``limit`` bytes, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and the offsets of each document's words."""
    low = _LOWER[data]
    inside = ~separators[low]
    n = len(low)
    if n == 0:
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _P + (eight[starts] & _KEEP[np.minimum(size, 8)]))
    at, left = starts + 8, size - 8
    more = np.flatnonzero(left > 0)
    while len(more):
        h[more] = mix(h[more] * _P + (eight[at[more]] & _KEEP[np.minimum(left[more], 8)]))
        at[more] += 8
        left[more] -= 8
        more = more[left[more] > 0]
    return h


def shingle_sets(column, k: int):
    """Yield for each document the sorted distinct hashes of its ``k``-word shingles.

    With fewer than ``k`` words the whole sequence is one shingle; without words the
    set is empty.
    """
    data, offsets = utf8(column)
    empty = np.zeros(0, np.uint64)
    for a, b in slices(offsets):
        cut = offsets[a : b + 1] - offsets[a]
        low, starts, ends, per = words(data[offsets[a] : offsets[b]], cut)
        h = word_hashes(low, starts, ends)
        g = h[: max(0, len(h) - k + 1)].copy()
        for j in range(1, k):
            g = g * _P + h[j : j + len(g)]
        g = mix(g)
        for d in range(b - a):
            i, n = per[d], per[d + 1] - per[d]
            if n >= k:
                yield np.unique(g[i : i + n - k + 1])
            elif n:
                one = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[i : i + n]:
                        one = one * _P + x
                yield mix(np.array([one], np.uint64))
            else:
                yield empty


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after a large group."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
