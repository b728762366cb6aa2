"""Local search on one component: label propagation, FM, removal, splitting, swapping.

A state is a label for each node. With w(u, C) the sum of weights from u into cluster C, the
cost of a clustering is a constant minus the weights inside clusters, so moving u from its
cluster to C changes the cost by ``w(u, own) - w(u, C)``; being alone has w = 0.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import deque

import numpy as np

from knotwork.plans import clock
from knotwork.plans.instance import Instance


class State:
    """Labels with the weights from every node into every cluster."""

    def __init__(self, x: Instance, label: np.ndarray | None = None):
        self.s, n = x.s, len(x)
        self.n = n
        self.label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].ravel()
        self.into = np.zeros((n, n), np.int64)
        for u in range(n):
            self.into[:, self.label[u]] += self.s[:, u]
        self.size = np.bincount(self.label, minlength=n)

    def cost(self) -> int:
        same = self.label[:, None] == self.label[None, :]
        return int(np.triu(np.where(same, np.maximum(-self.s, 0), np.maximum(self.s, 0)), 1).sum())

    def delta(self, u: int, c: int) -> int:
        """Change of cost if u goes to c."""
        return int(self.into[u, self.label[u]] - self.into[u, c])

    def move(self, u: int, c: int) -> int:
        """Move and return the change of cost."""
        old = self.label[u]
        if old == c:
            return 0
        d = self.delta(u, c)
        self.into[:, old] -= self.s[:, u]
        self.into[:, c] += self.s[:, u]
        self.size[old] -= 1
        self.size[c] += 1
        self.label[u] = c
        return d

    def empty(self) -> int | None:
        """A cluster without nodes."""
        free = np.flatnonzero(self.size == 0)
        return int(free[0]) if len(free) else None

    def best(self, u: int, rng: random.Random | None = None, alone: bool = True) -> tuple[int, int]:
        """Best other cluster (an empty one stands for being alone) and the change of cost."""
        gain = self.into[u].astype(float)
        gain[self.size == 0] = -np.inf
        gain[self.label[u]] = -np.inf
        if alone and self.size[self.label[u]] > 1 and (e := self.empty()) is not None:
            gain[e] = 0
        top = gain.max()
        if top == -np.inf:
            return int(self.label[u]), 0
        ties = np.flatnonzero(gain == top)
        c = int(rng.choice(ties.tolist()) if rng else ties[0])
        return c, self.delta(u, c)

    def best_many(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``best`` of many nodes at once, without randomness."""
        rows, own = np.arange(len(nodes)), self.label[nodes]
        gain = self.into[nodes].astype(float)
        gain[:, self.size == 0] = -np.inf
        inside = gain[rows, own]
        gain[rows, own] = -np.inf
        if (e := self.empty()) is not None:
            gain[self.size[own] > 1, e] = 0
        to = gain.argmax(1)
        top = gain[rows, to]
        stay = top == -np.inf
        return np.where(stay, own, to), np.where(stay, 0, inside - np.where(stay, 0, top)).astype(np.int64)

    def restore(self, label: np.ndarray) -> None:
        """Go back to a saved labelling."""
        for u in np.flatnonzero(self.label != label):
            self.move(int(u), int(label[u]))

    def near(self, u: int) -> np.ndarray:
        """Nodes that a positive weight joins with u."""
        return np.flatnonzero(self.s[u] > 0)

    def degrees(self) -> np.ndarray:
        return (self.s > 0).sum(1)

    def members(self, c: int) -> np.ndarray:
        return np.flatnonzero(self.label == c)

    def weights(self, u: int, clusters: np.ndarray) -> np.ndarray:
        """Weights from u into clusters."""
        return self.into[u, clusters]

    def apart(self, c: int, most: int) -> list[tuple[int, int]]:
        """Negative pairs of a cluster by the weight that their ends have inside, ties by ids."""
        own = self.members(c)
        inner = self.s[np.ix_(own, own)]
        weight = inner.sum(1)
        bad = map(tuple, np.argwhere(np.triu(inner < 0, 1)).tolist())
        return [(int(own[i]), int(own[j])) for i, j in sorted(bad, key=lambda p: (-(weight[p[0]] + weight[p[1]]), p))[:most]]


class Lists:
    """A ``State`` of a graph with unit weights as adjacency lists: memory grows with its edges, not with its
    pairs, so a component's size decides nothing. Best moves are those to clusters of neighbours, or out."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None):
        self.n = n
        src, dst = np.concatenate([u, v]), np.concatenate([v, u])
        self.dst = dst[np.lexsort((dst, src))]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        self.label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].ravel()
        self.size = np.bincount(self.label, minlength=n)
        self.held: list[set[int]] = [set() for _ in range(n)]
        for i, c in enumerate(self.label.tolist()):
            self.held[c].add(i)
        # smallest first; one that has been filled since is passed over
        self.free = np.flatnonzero(self.size == 0).tolist()

    def near(self, u: int) -> np.ndarray:
        return self.dst[self.at[u] : self.at[u + 1]]

    def degrees(self) -> np.ndarray:
        return np.diff(self.at)

    def members(self, c: int) -> np.ndarray:
        return np.array(sorted(self.held[c]), np.int64)

    def cost(self) -> int:
        inside = int((np.repeat(self.label, np.diff(self.at)) == self.label[self.dst]).sum()) // 2
        return int((self.size * (self.size - 1) // 2).sum()) + len(self.dst) // 2 - 2 * inside

    def weights(self, u: int, clusters: np.ndarray) -> np.ndarray:
        around = np.sort(self.label[self.near(u)])
        joined = np.searchsorted(around, clusters, "right") - np.searchsorted(around, clusters)
        return 2 * joined - (self.size[clusters] - (clusters == self.label[u]))

    def delta(self, u: int, c: int) -> int:
        own, to = self.weights(u, np.array([self.label[u], c]))
        return int(own - to)

    def move(self, u: int, c: int) -> int:
        old = int(self.label[u])
        if old == c:
            return 0
        d = self.delta(u, c)
        self.size[old] -= 1
        self.size[c] += 1
        self.held[old].discard(u)
        self.held[c].add(u)
        self.label[u] = c
        if not self.size[old]:
            heapq.heappush(self.free, old)
        return d

    def empty(self) -> int | None:
        while self.free and self.size[self.free[0]]:
            heapq.heappop(self.free)
        return self.free[0] if self.free else None

    def best(self, u: int, rng: random.Random | None = None, alone: bool = True) -> tuple[int, int]:
        own = int(self.label[u])
        into: dict[int, int] = {}
        for c in self.label[self.dst[self.at[u] : self.at[u + 1]]].tolist():
            into[c] = into.get(c, 0) + 1
        inside = 2 * into.pop(own, 0) + 1 - int(self.size[own])
        gain = {c: 2 * e - int(self.size[c]) for c, e in into.items()}
        if alone and self.size[own] > 1 and (e := self.empty()) is not None:
            gain[e] = 0
        if not gain:
            return own, 0
        top = max(gain.values())
        ties = sorted(c for c, g in gain.items() if g == top)
        return (rng.choice(ties) if rng else ties[0]), inside - top

    def best_many(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, many = self.label[nodes], self.at[nodes + 1] - self.at[nodes]
        row = np.repeat(np.arange(len(nodes)), many)
        arcs = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.at[nodes][row]
        key, count = np.unique(row * self.n + self.label[self.dst[arcs]], return_counts=True)
        row, to = key // self.n, key % self.n
        gain, mine = 2 * count - self.size[to], to == own[row]
        inside = 1 - self.size[own]
        inside[row[mine]] += 2 * count[mine]
        row, to, gain = row[~mine], to[~mine], gain[~mine]
        if (e := self.empty()) is not None:
            some = np.flatnonzero(self.size[own] > 1)
            row, to, gain = np.append(row, some), np.append(to, np.full(len(some), e)), np.append(gain, np.zeros(len(some), gain.dtype))
        order = np.lexsort((to, -gain, row))
        rows, first = np.unique(row[order], return_index=True)
        goes, change = own.copy(), np.zeros(len(nodes), np.int64)
        goes[rows] = to[order][first]
        change[rows] = inside[rows] - gain[order][first]
        return goes, change

    def apart(self, c: int, most: int) -> list[tuple[int, int]]:
        own = self.members(c)
        inside = [np.searchsorted(own, w[self.label[w] == c]) for w in map(self.near, own.tolist())]
        weight = np.array([2 * len(w) for w in inside])
        found = []
        for i, w in enumerate(inside):
            later = np.ones(len(own), bool)
            later[: i + 1] = later[w] = False
            j = np.flatnonzero(later)
            # the first of a row by weight are all that can be among the first of all rows
            found += [(-int(weight[i] + weight[k]), i, int(k)) for k in j[np.argsort(-weight[j], kind="stable")[:most]]]
        return [(int(own[i]), int(own[j])) for _, i, j in sorted(found)[:most]]


def undo(st: State | Lists, log: list[tuple[int, int]]) -> None:
    """Take the moves of ``log(node, cluster before)`` back, the last first."""
    for u, old in reversed(log):
        st.move(u, old)


def label_propagation(st: State | Lists, rounds: int, rng: random.Random, order: str = "none", window: int = 100, least: int = 5, target: int | None = None, near: int = 25) -> int:
    """Rounds of best moves; returns the change of cost.

    Ends when a round moves nothing, or the last ``window`` rounds gained at most ``least``.
    With a target change, rounds double once the state comes within ``near`` of it, and end
    if the target cannot be reached at the present rate.
    """
    total, recent, k = 0, deque(maxlen=window), 0
    nodes = list(range(st.n))
    degree = st.degrees()
    if order == "degree_increasing":
        nodes.sort(key=lambda u: degree[u])
    elif order == "degree_decreasing":
        nodes.sort(key=lambda u: -degree[u])
    doubled = False
    while k < rounds and not clock.late():
        k += 1
        if order == "random":
            rng.shuffle(nodes)
        now = 0
        for u in nodes:
            c, d = st.best(u, rng)
            if d < 0 or (d == 0 and c != st.label[u] and rng.random() < 0.5 and st.size[c] > 0):
                now += st.move(u, c)
        total += now
        recent.append(-now)
        if now == 0:
            break
        if len(recent) == window and sum(recent) <= least:
            break
        if target is not None:
            if not doubled and total - near < target:
                rounds, doubled = 2 * rounds, True
            elif total + now * (rounds - k) > target:
                break
    return total


def boundary_fm(st: State | Lists, rng: random.Random, fraction: float = 0.1, least: int = 10_000, passes: int = 10, window: int = 5, gain: int = 5) -> int:
    """Passes of FM; ends after ``passes``, with a pass that gains nothing, or when the last
    ``window`` passes gained less than ``gain`` together."""
    total, recent = 0, deque(maxlen=window)
    for _ in range(passes):
        now = _fm_pass(st, max(int(fraction * st.n), least))
        total += now
        recent.append(-now)
        if now == 0 or (len(recent) == window and sum(recent) < gain):
            break
    return total


def _fm_pass(st: State | Lists, most: int) -> int:
    """Every node moves once at most, best change first, worsening ones too; keeps the best prefix.

    A move changes the gains of its neighbours and of both clusters' members only; theirs are
    renewed in the queue, and an entry that has become worse is renewed when it is popped.
    """
    moved, log, total, best, keep, idle = np.zeros(st.n, bool), [], 0, 0, 0, 0
    to, change = st.best_many(np.arange(st.n))
    heap = list(zip(change.tolist(), range(st.n), to.tolist()))
    heapq.heapify(heap)
    while heap and idle < most:
        d, u, c = heapq.heappop(heap)
        if moved[u]:
            continue
        c2, d2 = st.best(u)
        if c2 == st.label[u]:
            continue
        if d2 > d:
            heapq.heappush(heap, (d2, u, c2))
            continue
        old = int(st.label[u])
        log.append((u, old))
        total += st.move(u, c2)
        moved[u] = True
        idle += 1
        if total < best:
            best, keep, idle = total, len(log), 0
        near = np.unique(np.concatenate([st.near(u), st.members(old), st.members(c2)]))
        near = near[~moved[near]]
        if len(near):
            to, change = st.best_many(near)
            for entry in zip(change.tolist(), near.tolist(), to.tolist()):
                heapq.heappush(heap, entry)
    undo(st, log[keep:])
    return best


class Welford:
    """Running mean and variance of step gains, and the rule that further steps are hopeless."""

    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def push(self, x: float) -> None:
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)

    def stop(self, size: int, factor: float = 1.75) -> bool:
        if self.n < 2 or self.n <= math.log(max(size, 2)):
            return False
        return self.mean == 0 or self.n >= self.m2 / (self.n - 1) / self.mean**2 * factor


def localized_fm(st: State | Lists, rng: random.Random, seeds: int = 5) -> int:
    """FM from batches of seed nodes; moved nodes bring their neighbours in."""
    todo, moved, gained = list(range(st.n)), set(), 0
    rng.shuffle(todo)
    while todo:
        batch = [u for u in (todo.pop() for _ in range(min(seeds, len(todo)))) if u not in moved]
        heap = [(st.best(u)[1], u) for u in batch]
        heapq.heapify(heap)
        log, total, best, keep, rule = [], 0, 0, 0, Welford()
        while heap and not rule.stop(st.n):
            d, u = heapq.heappop(heap)
            if u in moved:
                continue
            c, now = st.best(u)
            if now > d:
                heapq.heappush(heap, (now, u))
                continue
            if c == st.label[u]:
                continue
            log.append((u, int(st.label[u])))
            total += st.move(u, c)
            moved.add(u)
            rule.push(now)
            if total < best:
                best, keep, rule = total, len(log), Welford()
            for w in st.near(u).tolist():
                if w not in moved:
                    heapq.heappush(heap, (st.best(w)[1], w))
        undo(st, log[keep:])
        gained += best
    return gained


def remove_clusters(st: State | Lists, rng: random.Random) -> int:
    """Dissolve each cluster into its members' best other adjacent clusters if that does not cost."""
    total = 0
    for c in rng.sample(np.flatnonzero(st.size > 1).tolist(), int((st.size > 1).sum())):
        log, delta = [], 0
        for u in st.members(c).tolist():
            near = np.unique(st.label[st.near(u)])
            near = near[near != c]
            if len(near):
                t = int(near[np.argmax(st.weights(u, near))])
                log.append((u, c))
                delta += st.move(u, t)
        if delta > 0:
            undo(st, log)
        else:
            total += delta
    return total


def split_clusters(st: State | Lists, rng: random.Random, pairs: int = 3) -> int:
    """Split clusters that miss an edge around a negative pair if that does not cost."""
    total = 0
    for c in np.flatnonzero(st.size > 2).tolist():
        own = st.members(c).tolist()
        for i, j in st.apart(c, pairs):
            e = st.empty()
            if e is None:
                break
            log, delta = [(j, c)], st.move(j, e)
            for u in own:
                if u not in (i, j):
                    here, there = st.weights(u, np.array([c, e]))
                    if there > here:
                        log.append((u, c))
                        delta += st.move(u, e)
            if delta <= 0:
                total += delta
                break
            undo(st, log)
    return total


def swap_nodes(st: State | Lists, rng: random.Random, most: int | None = None) -> int:
    """Force a node into its best other cluster, of ``most`` nodes at most if given, let members leave that
    it harms; keep if it does not cost."""
    total = 0
    for u in rng.sample(range(st.n), st.n):
        c, _ = st.best(u, rng, alone=False)
        if c == st.label[u] or (most is not None and st.size[c] > most):
            continue
        log, delta = [(u, int(st.label[u]))], st.move(u, c)
        for w in st.members(c).tolist():
            if w != u:
                t, d = st.best(w, rng)
                if d < 0:
                    log.append((w, c))
                    delta += st.move(w, t)
        if delta > 0:
            undo(st, log)
        else:
            total += delta
    return total


def best_of_runs(x: Instance, runs: int = 200, rounds: int = 500, seed: int = 1, lower: int = 0) -> tuple[np.ndarray, int]:
    """Best labels and cost of several shuffled label propagations from singletons; stops at ``lower``."""
    best, cost = np.arange(len(x)), State(x).cost()
    for r in range(runs):
        if cost <= lower or clock.late():
            break
        st = State(x)
        label_propagation(st, rounds, random.Random(seed * 1000 + r), "random")
        now = st.cost()
        if now < cost:
            best, cost = st.label.copy(), now
    return best, cost
