"""Lower bounds by packing conflicts.

A conflict triple u-v-w (two positive pairs, one negative) costs at least its smallest
weight. A star is a centre with leaves that are positive to it and pairwise negative; of its
edges all but one must go, or leaves must be joined, so k leaves cost (k - 1) times the
smallest weight. A complete bipartite piece generalises stars. Pieces that do not overuse any
pair's weight add up. Any packing is a valid bound; local search improves it,
and one that a deadline cuts short is valid too.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from knotwork.plans import clock
from knotwork.plans.instance import INF, Infeasible, Instance, pair_costs


def triples(s: np.ndarray):
    """(u, v, w) with v < w: u-v and u-w positive, v-w negative."""
    for u in range(len(s)):
        near = np.flatnonzero(s[u] > 0)
        bad = np.triu(s[np.ix_(near, near)] < 0, 1)
        for i, j in np.argwhere(bad).tolist():
            yield u, int(near[i]), int(near[j])


def conflict_counts(s: np.ndarray) -> np.ndarray:
    """For every pair the conflict triples that hold it."""
    p, n = (s > 0).astype(np.int64), (s < 0).astype(np.int64)
    np.fill_diagonal(n, 0)
    # an edge is in a triple with every neighbour of one end that is negative to the other end
    edge = p * (p @ n + n @ p)
    return edge + n * (p @ p)


class Packing:
    """Pieces with their weights, and the capacity they leave on each pair."""

    def __init__(self, s: np.ndarray):
        self.left = np.minimum(np.abs(s), INF)
        self.sign, self.value, self.pieces = np.sign(s), 0, Counter()

    def pairs(self, piece):
        center, leaves = piece
        out = [(center, x) for x in leaves]
        return out + [(x, y) for i, x in enumerate(leaves) for y in leaves[i + 1 :]]

    def capacity(self, piece) -> int:
        """What the piece could still weigh; 0 if it is no star."""
        center, leaves = piece
        if any(self.sign[center, x] <= 0 for x in leaves):
            return 0
        if any(self.sign[x, y] >= 0 for i, x in enumerate(leaves) for y in leaves[i + 1 :]):
            return 0
        return int(min(self.left[a, b] for a, b in self.pairs(piece)))

    def add(self, piece, weight: int) -> None:
        if weight <= 0:
            return
        for a, b in self.pairs(piece):
            self.left[a, b] -= weight
            self.left[b, a] -= weight
        self.pieces[piece] += weight
        self.value += weight * (len(piece[1]) - 1)

    def remove(self, piece, weight: int) -> None:
        for a, b in self.pairs(piece):
            self.left[a, b] += weight
            self.left[b, a] += weight
        self.pieces[piece] -= weight
        if self.pieces[piece] == 0:
            del self.pieces[piece]
        self.value -= weight * (len(piece[1]) - 1)

    def fill(self, limit: int | None = None) -> None:
        """Triples greedily at full capacity; stops above the limit."""
        for u in range(len(self.left)):
            if clock.late():
                return
            for _, v, w in self.free_triples(u):
                c = self.capacity((u, (v, w)))
                if c:
                    self.add((u, (v, w)), c)
                    if limit is not None and self.value > limit:
                        return

    def free_triples(self, u: int):
        near = np.flatnonzero((self.sign[u] > 0) & (self.left[u] > 0))
        bad = np.triu((self.sign[np.ix_(near, near)] < 0) & (self.left[np.ix_(near, near)] > 0), 1)
        return [(u, int(near[i]), int(near[j])) for i, j in np.argwhere(bad)]

    def through(self, a: int, b: int):
        """Free triples that use the pair a, b."""
        out = []
        if self.left[a, b] <= 0:
            return out
        free = self.left > 0
        if self.sign[a, b] > 0:
            for x, y in ((a, b), (b, a)):
                for w in np.flatnonzero((self.sign[x] > 0) & free[x] & (self.sign[y] < 0) & free[y]).tolist():
                    out.append((x, tuple(sorted((y, w)))))
        elif self.sign[a, b] < 0:
            for u in np.flatnonzero((self.sign[a] > 0) & free[a] & (self.sign[b] > 0) & free[b]).tolist():
                out.append((u, (min(a, b), max(a, b))))
        return out


def p3_packing(x: Instance, limit: int | None = None, seed: int = 1, idle: int = 5) -> Packing:
    """Greedy triples, then swaps of one for two until ``idle`` rounds bring nothing."""
    rng, pack = random.Random(seed), Packing(x.s)
    pack.fill(limit)
    rounds = 0
    while rounds < idle and pack.pieces and not (limit is not None and pack.value > limit):
        rounds += 1
        before = pack.value
        todo = list(pack.pieces)
        rng.shuffle(todo)
        for piece in todo:
            if clock.late():
                return pack
            if piece not in pack.pieces:
                continue
            old = pack.value
            pack.remove(piece, 1)
            options = [c for a, b in pack.pairs(piece) for c in pack.through(a, b) if c != piece]
            rng.shuffle(options)
            added = []
            for c in options:
                if pack.capacity(c):
                    pack.add(c, 1)
                    added.append(c)
                    if len(added) == 2:
                        break
            if pack.value < old or (len(added) == 1 and rng.random() > 0.7):
                for c in added:
                    pack.remove(c, 1)
                pack.add(piece, 1)
        pack.fill(limit)
        if pack.value > before:
            rounds = 0
    return pack


def degeneracy_order(adjacent: np.ndarray) -> list[int]:
    """Nodes by repeatedly taking one of least degree, last one first."""
    degree, left, out = adjacent.sum(1).astype(int), set(range(len(adjacent))), []
    while left:
        u = min(left, key=lambda i: (degree[i], i))
        left.remove(u)
        out.append(u)
        for w in np.flatnonzero(adjacent[u]).tolist():
            degree[w] -= 1
    return out[::-1]


def greedy_colors(adjacent: np.ndarray) -> list[list[int]]:
    """Colour classes: in degeneracy order each node gets the smallest free colour."""
    color: dict[int, int] = {}
    for u in degeneracy_order(adjacent):
        used = {color[w] for w in np.flatnonzero(adjacent[u]).tolist() if w in color}
        color[u] = next(c for c in range(len(adjacent) + 1) if c not in used)
    classes: dict[int, list[int]] = {}
    for u, c in color.items():
        classes.setdefault(c, []).append(u)
    return [sorted(classes[c]) for c in sorted(classes)]


def star_packing(x: Instance, limit: int | None = None, seed: int = 1, idle: int = 3) -> Packing:
    """Stars from colour classes of neighbourhoods, filled up and improved.

    Around a centre, neighbours that are not pairwise negative and free are adjacent; a colour
    class is then a set of leaves. High degrees come first. Improvement takes one unit of a
    piece out and looks for pieces through its pairs that are worth more, merges stars of one
    centre, and extends stars by a leaf.
    """
    rng, pack = random.Random(seed), Packing(x.s)
    order = sorted(range(len(x)), key=lambda u: (-int((x.s[u] > 0).sum()), u))
    for u in order:
        while not clock.late():
            near = np.flatnonzero((pack.sign[u] > 0) & (pack.left[u] > 0))
            if len(near) < 2:
                break
            block = np.ix_(near, near)
            joined = ~((pack.sign[block] < 0) & (pack.left[block] > 0))
            np.fill_diagonal(joined, False)
            sets = [c for c in greedy_colors(joined) if len(c) > 1]
            if not sets:
                break
            leaves = tuple(int(near[i]) for i in max(sets, key=len))
            pack.add((u, leaves), pack.capacity((u, leaves)))
            if limit is not None and pack.value > limit:
                return pack
    pack.fill(limit)
    rounds = 0
    while rounds < idle and pack.pieces and not (limit is not None and pack.value > limit):
        rounds += 1
        before = pack.value
        todo = list(pack.pieces)
        rng.shuffle(todo)
        for piece in todo:
            if clock.late():
                return pack
            if piece not in pack.pieces:
                continue
            center, leaves = piece
            old = pack.value
            pack.remove(piece, 1)
            added = []
            wider = [(center, tuple(sorted((*leaves, w)))) for w in np.flatnonzero((pack.sign[center] > 0) & (pack.left[center] > 0)).tolist() if w not in leaves]
            options = [c for c in wider if pack.capacity(c)] or [c for a, b in pack.pairs(piece) for c in pack.through(a, b) if c != piece]
            rng.shuffle(options)
            for c in options:
                if pack.capacity(c):
                    pack.add(c, 1)
                    added.append(c)
            if pack.value < old or (pack.value == old and rng.random() > 0.8):
                for c in added:
                    pack.remove(c, 1)
                pack.add(piece, 1)
        pack.fill(limit)
        if pack.value > before:
            rounds = 0
    return pack


def bipartite_bound(x: Instance) -> int:
    """Greedy packing of complete bipartite pieces with one pair of sides of a unit instance (optional).

    A piece K(a, b) with a >= b is worth b * (a - 1): sides are pairwise negative inside and
    positive across. Grown from conflict triples, one node at a time.
    """
    if (np.abs(x.s) > 1).any() and not x.unit:
        return p3_packing(x).value
    free, sign, total = np.ones_like(x.s, bool), np.sign(x.s), 0
    for u, v, w in triples(x.s):
        if clock.late():
            break
        if not (free[u, v] and free[u, w] and free[v, w]):
            continue
        sides = [[u], [v, w]]
        for y in range(len(x)):
            if y in sides[0] or y in sides[1]:
                continue
            for own, other in ((0, 1), (1, 0)):
                if all(sign[y, z] < 0 and free[y, z] for z in sides[own]) and all(sign[y, z] > 0 and free[y, z] for z in sides[other]):
                    sides[own].append(y)
                    break
        a, b = max(map(len, sides)), min(map(len, sides))
        total += b * (a - 1)
        group = sides[0] + sides[1]
        free[np.ix_(group, group)] = False
    return total


def lower_bound(x: Instance, limit: int | None = None, seed: int = 1) -> int:
    """Cost that any clustering still has to pay, without what was spent."""
    return star_packing(x, limit, seed).value


def forced_by(x: Instance, budget: int, bound=star_packing) -> Instance | None:
    """Decide pairs for which the opposite decision's bound exceeds the budget.

    The induced cost of a decision lies on pairs of its two nodes. Pieces of a packing without
    either node add to it, so their value plus the induced cost is a bound.
    """
    pack = bound(x)
    left = budget - x.spent
    if pack.value > left:
        raise Infeasible("the bound exceeds the budget")
    merge, out, changed = [], x, False
    icf, icp = pair_costs(x)
    # the induced cost of deciding (u, v) lies on pairs of u or v, so pieces with u or v do not count
    at, weights = np.zeros((len(pack.pieces), len(x)), bool), np.zeros(len(pack.pieces), np.int64)
    for i, (piece, weight) in enumerate(pack.pieces.items()):
        at[i, [piece[0], *piece[1]]] = True
        weights[i] = weight * (len(piece[1]) - 1)
    for u in range(len(x)):
        clock.check()
        for v in range(u + 1, len(x)):
            rest = int(weights[~(at[:, u] | at[:, v])].sum())
            if x.s[u, v] < INF and rest + int(icf[u, v]) > left:
                merge.append((u, v))
            elif -INF < x.s[u, v] and rest + int(icp[u, v]) > left:
                out = out.forbid(u, v)
                changed = True
    if merge:
        out = out.copy()
        for u, v in merge:
            if out.s[u, v] <= -INF:
                raise Infeasible("a pair is forced both ways")
            out.spent += max(0, -int(out.s[u, v]))
            out.s[u, v] = out.s[v, u] = INF
        return out.contract_permanent()
    return out if changed else None


def forced_single_merge(x: Instance, budget: int, k: int = 10) -> Instance | None:
    """Join one of the ``k`` most similar pairs if forbidding it makes the bound exceed the budget."""
    p = np.maximum(x.s, 0)
    scores = []
    for u, v in np.argwhere(np.triu(x.s, 1) > 0).tolist():
        clock.check()
        rest = [w for w in range(len(x)) if w not in (u, v)]
        a, b = x.s[u, rest], x.s[v, rest]
        common = int(np.minimum(p[u, rest], p[v, rest]).sum())
        apart = (a > 0) & (b < 0) | (a < 0) & (b > 0)
        scores.append((int(x.s[u, v]) + common - int(np.minimum(np.abs(a), np.abs(b))[apart].sum()), u, v))
    for _, u, v in sorted(scores, reverse=True)[:k]:
        clock.check()
        y = x.forbid(u, v)
        if y.spent + lower_bound(y, budget - y.spent) > budget:
            return x.merge(u, v)
    return None
