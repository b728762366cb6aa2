"""Suffix arrays by external induced sorting.

The text is a vector of integers. Suffixes are classed as L (larger than their successor)
or S; the leftmost S suffixes of each run are sorted first: the pieces between them are
named by rank, several symbols to a machine word, and the shorter text of names is sorted by
recursion. From their order all others are induced: a suffix that leaves the priority queue
sends the suffix before it into the queue, keyed by its first symbol.

The queue is disk-backed and works in blocks. It holds sorted runs of (key, suffix) tuples,
merged in tiers; a run above ``SPILL`` tuples lives in a file and is read as a window. A pop
takes all tuples up to a key and hands out the longest prefix that none of its own
successors can enter, so a whole block is induced with a few vector operations however
large the alphabet. Equal keys leave in the order they came.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

SPILL = 1 << 19
#: Reduced texts up to this length end the recursion and are ranked in memory.
SMALL = 1 << 18


class BlockQueue:
    """Priority queue of (key, value) blocks, first in first out among equal keys."""

    def __init__(self, folder: str):
        self.folder, self.runs, self.files, self.block = folder, [], 0, 1 << 15

    def _store(self, keys: np.ndarray, values: np.ndarray) -> list:
        if len(keys) <= SPILL:
            return [keys, values, 0, None]
        path = os.path.join(self.folder, f"run{self.files}")
        self.files += 1
        for name, x in (("k", keys), ("v", values)):
            x.tofile(path + name)
        return [np.memmap(path + "k", keys.dtype, "r"), np.memmap(path + "v", values.dtype, "r"), 0, path]

    def _drop(self, run: list) -> None:
        if run[3]:
            for name in "kv":
                os.unlink(run[3] + name)

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Tuples in order of arrival."""
        if len(keys) == 0:
            return
        order = np.argsort(keys, kind="stable")
        self._add(keys[order], values[order])

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A sorted run that is younger than all others; similar sizes are merged."""
        while self.runs:
            k, v, at, _ = self.runs[-1]
            if len(k) - at > 2 * len(keys):
                break
            keys, values = np.concatenate([k[at:], keys]), np.concatenate([v[at:], values])
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            self._drop(self.runs.pop())
        self.runs.append(self._store(keys, values))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All tuples up to some key, sorted; empty when the queue is."""
        self.runs = [r for r in self.runs if r[2] < len(r[0]) or self._drop(r)]
        if not self.runs:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        each = max(1, self.block // len(self.runs))
        limit = min(int(r[0][min(r[2] + each, len(r[0]) - 1)]) for r in self.runs)
        limit = max(limit, min(int(r[0][r[2]]) for r in self.runs))
        keys, values = [], []
        for r in self.runs:
            end = r[2] + int(np.searchsorted(r[0][r[2] :], limit, side="right"))
            if end > r[2]:
                keys.append(np.asarray(r[0][r[2] : end]))
                values.append(np.asarray(r[1][r[2] : end]))
                r[2] = end
        if len(keys) == 1:
            return keys[0], values[0]
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def give_back(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Tuples of the last ``take`` that were not used; they are older than what follows."""
        if len(keys):
            self.runs.append([keys, values, 0, None])


def _induce(symbol: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, folder: str) -> np.ndarray:
    """Suffixes in ascending order of ``symbol``: the seeds, sorted already, and all induced ones.

    A suffix i is induced from i + 1 if ``wanted[i]``. Induced suffixes come before seeds of
    the same first symbol.
    """
    queue, out = BlockQueue(folder), []
    never = np.iinfo(symbol.dtype).max
    key = symbol * symbol.dtype.type(2)
    # what a suffix sends when it leaves, by its place; nothing before the first
    sent = np.full(len(symbol), never, symbol.dtype)
    sent[1:][wanted[:-1]] = key[:-1][wanted[:-1]]
    queue.push(key[seeds] + symbol.dtype.type(1), seeds)
    while True:
        keys, values = queue.take()
        if len(keys) == 0:
            return np.concatenate(out) if out else np.zeros(0, np.int32)
        target = sent[values]
        m = len(keys)
        # a block whose smallest successor is not below its last key goes out whole
        if target.min() < keys[-1]:
            late = keys[1:] > np.minimum.accumulate(target)[:-1]
            if late.any():
                m = int(np.argmax(late)) + 1
        queue.block = min(1 << 20, max(1 << 11, 2 * m))
        out.append(np.array(values[:m]))
        queue.give_back(keys[m:], values[m:])
        go = np.flatnonzero(target[:m] != never)
        queue.push(target[go], values[go] - 1)


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique smallest."""
    n = len(text)
    up, down = text[1:] > text[:-1], text[1:] < text[:-1]
    at = np.where(up | down, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = (nearest < n - 1) & up[np.minimum(nearest, n - 2)]
    return s


def _sort(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, folder: str) -> np.ndarray:
    """Induce L suffixes from sorted seeds, then S suffixes from the L suffixes."""
    up = _induce(text, ~small, seeds, folder)
    larger = up[~small[up]]
    flipped = text.max() - text
    # the last suffix is the smallest of all: no S suffix comes from it, and it closes the order
    down = _induce(flipped, small, larger[::-1], folder)
    return np.concatenate([np.array([len(text) - 1], np.int32), down[::-1]])


def _names(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rank of the piece from each leftmost S suffix to the next one, both included; ties share a rank.

    A piece that is a beginning of another one is the larger of the two, because its last
    symbol is an S where the other has an L; so short pieces are padded with the largest value.
    Words of symbols refine the ranks until all ties are equal pieces.
    """
    per, bits = (4, 16) if text.dtype == np.int16 else (2, 32)
    size = np.append(np.diff(left) + 1, 1)
    n, pad = len(text), np.uint64((1 << bits) - 1)
    rank, live, w = np.zeros(len(left), np.int64), np.arange(len(left)), 0
    while len(live):
        word = np.zeros(len(live), np.uint64)
        at, left_over = left[live] + per * w, size[live] - per * w
        for k in range(per):
            symbol = text[np.minimum(at + k, n - 1)].astype(np.uint64)
            word = (word << np.uint64(bits)) | np.where(left_over > k, symbol, pad)
        order = np.argsort(word, kind="stable") if w == 0 else np.lexsort((word, rank[live]))
        live, word = live[order], word[order]
        old = rank[live]
        group = np.ones(len(live), bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= word[1:] != word[:-1]
        index = np.arange(len(live))
        begin = np.maximum.accumulate(np.where(group, index, 0))
        rank[live] = old + np.maximum.accumulate(np.where(new, index, 0)) - begin
        w += 1
        # go on with ties in which some piece has symbols left
        edge = np.flatnonzero(new)
        more = np.maximum.reduceat(size[live], edge) > per * w
        many = np.diff(np.append(edge, len(live))) > 1
        live = live[np.repeat(more & many, np.diff(np.append(edge, len(live))))]
    return rank


def _rank_in_memory(text: np.ndarray) -> np.ndarray:
    """Suffixes of a short text, by doubling the length that ranks cover; only ties go on."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.ones(n, bool)
    new[1:] = text[order[1:]] != text[order[:-1]]
    rank = np.zeros(n + 1, np.int64)
    rank[-1] = -1
    index = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, index, 0))
    span = 1
    while not new.all():
        tied = np.ones(n, bool)
        tied[:-1] = ~new[1:]
        at = np.flatnonzero(tied | ~new)
        live = order[at]
        follow = rank[np.minimum(live + span, n)]
        shift = np.lexsort((follow, rank[live]))
        live, follow, old = live[shift], follow[shift], rank[live]
        order[at] = live
        differ = np.ones(len(at), bool)
        differ[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        new[at] = differ
        rank[live] = at[np.maximum.accumulate(np.where(differ, np.arange(len(at)), 0))]
        span *= 2
    return order


def suffix_array(text: np.ndarray, folder: str | None = None) -> np.ndarray:
    """Sorted suffixes of a vector of non-negative integers whose last symbol is its unique smallest."""
    if len(text) < 2:
        return np.arange(len(text))
    if folder is not None and len(text) <= SMALL:
        return _rank_in_memory(text)
    own = folder is None
    folder = folder or tempfile.mkdtemp(prefix="knotwork-sort-")
    try:
        top = int(text.max())
        text = text.astype(np.int16 if top < 16_000 else np.int32 if top < 1 << 30 else np.int64)
        small = _types(text)
        left = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
        if len(left) > 1:
            rank = _names(text, left)
            order = np.argsort(rank, kind="stable")
            tie = rank[order[1:]] == rank[order[:-1]]
            if tie.any():
                name = np.zeros(len(left), np.int64)
                name[order] = np.concatenate([[0], np.cumsum(~tie)])
                order = suffix_array(name, folder)
            left = left[order]
        return _sort(text, small, left, folder)
    finally:
        if own:
            shutil.rmtree(folder, ignore_errors=True)
