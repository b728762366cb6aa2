"""Exact solution of one component: subset dynamic program, and budgeted branch and bound."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

from knotwork.plans import bounds, clock
from knotwork.plans.instance import INF, RULES, Infeasible, Instance, distance_rule, induced_costs
from knotwork.plans.refine import best_of_runs

#: Components up to this size are solved by the subset dynamic program.
TABLE_NODES = 11
#: Shuffled label propagations for the upper bound, and their rounds.
UPPER_RUNS, UPPER_ROUNDS = 200, 500
#: Effort for certificates of clusters, which are a shortcut only.
CERTIFICATE_NODES, CERTIFICATE_SECONDS = 20_000, 5.0


@dataclass
class Solution:
    """Whether it was solved, its cost, clusters of original nodes, a lower bound, and counters."""

    worked: bool
    cost: int
    cliques: list[list[int]]
    lower: int = 0
    counters: Counter = field(default_factory=Counter)


class OutOfEffort(Exception):
    """The limit of search nodes or of time is reached."""


def subset_table(x: Instance) -> Solution:
    """Optimum over all partitions, in 3**n steps."""
    n = len(x)
    size = 1 << n
    # value of a set as one cluster: negative inside weights are paid, positive ones saved
    inner = np.zeros(size, np.int64)
    for mask in range(1, size):
        low = (mask & -mask).bit_length() - 1
        rest = mask & (mask - 1)
        inner[mask] = inner[rest] + sum(int(x.s[low, j]) for j in range(low + 1, n) if rest >> j & 1)
    best, choice = [0] * size, [0] * size
    saved = inner.tolist()
    for mask in range(1, size):
        low = mask & -mask
        rest = mask ^ low
        top, pick, sub = None, 0, rest
        while True:
            value = saved[sub | low] + best[rest ^ sub]
            if top is None or value > top:
                top, pick = value, sub | low
            if sub == 0:
                break
            sub = (sub - 1) & rest
        best[mask], choice[mask] = top, pick
    label, mask, k = np.zeros(n, int), size - 1, 0
    while mask:
        for j in range(n):
            if choice[mask] >> j & 1:
                label[j] = k
        mask ^= choice[mask]
        k += 1
    cliques = [sorted(m for i in np.flatnonzero(label == c) for m in x.members[i]) for c in range(k)]
    cost = x.cost_of(label) + x.spent
    return Solution(cost < INF, cost, sorted(cliques), cost)


class Search:
    """Branch and bound on one instance."""

    def __init__(self, nodes: int | None = None, seconds: float | None = None):
        self.nodes, self.until = nodes, None if seconds is None else time.monotonic() + seconds
        self.counters: Counter = Counter()

    def _tick(self) -> None:
        self.counters["nodes"] += 1
        clock.check()
        if (self.nodes is not None and self.counters["nodes"] > self.nodes) or (self.until and time.monotonic() > self.until):
            raise OutOfEffort

    def within(self, x: Instance, budget: int) -> Instance | None:
        """A solved instance of total cost at most ``budget``, or None."""
        self._tick()
        while True:
            if x.spent > budget:
                return None
            if x.is_cluster_graph():
                return x
            parts = x.components()
            if len(parts) > 1:
                return self._parts(x, parts, budget)
            if x.spent + bounds.lower_bound(x, budget - x.spent) > budget:
                self.counters["pruned"] += 1
                return None
            try:
                y = self._reduce(x, budget)
            except Infeasible:
                self.counters["infeasible"] += 1
                return None
            if y is None:
                break
            x = y
        u, v = branching_pair(x)
        for step in (Instance.merge, Instance.forbid):
            try:
                found = self.within(step(x, u, v), budget)
            except Infeasible:
                continue
            if found is not None:
                return found
        return None

    def _parts(self, x: Instance, parts: list[list[int]], budget: int) -> Instance | None:
        """Solve components one by one; negative pairs between them cost nothing."""
        spent, members = x.spent, []
        for p in sorted(parts, key=len):
            y = x.keep(p)
            y.spent = 0
            solved = None
            for allowed in range(bounds.lower_bound(y), budget - spent + 1):
                solved = self.within(y, allowed)
                if solved is not None:
                    break
            if solved is None:
                return None
            spent += solved.spent
            members += [sum((solved.members[i] for i in c), []) for c in solved.components()]
        n = len(members)
        return Instance(-np.ones((n, n), np.int64), None, members, spent) if spent <= budget else None

    def _reduce(self, x: Instance, budget: int) -> Instance | None:
        for rule in RULES:
            y = rule(x)
            if y is not None:
                self.counters[rule.__name__] += 1
                return y
        y = induced_costs(x, budget)
        if y is not None:
            self.counters["induced_costs"] += 1
            return y
        y = bounds.forced_by(x, budget)
        if y is not None:
            self.counters["forced_by"] += 1
        return y


def branching_pair(x: Instance) -> tuple[int, int]:
    """A positive pair in a conflict: heaviest, then in most conflicts, then first.

    Where no triple has a strictly negative pair, neutral pairs block; any edge beside one will do.
    """
    count = bounds.conflict_counts(x.s)
    best = None
    for u, v in combinations(range(len(x)), 2):
        s = int(x.s[u, v])
        if 0 < s < INF and count[u, v] > 0:
            key = (s, int(count[u, v]))
            if best is None or key > best[0]:
                best = (key, u, v)
    if best is None:
        at = np.argwhere(np.triu((x.s > 0) & (x.s < INF), 1))
        return tuple(map(int, at[0]))
    return best[1], best[2]


def root_reductions(x: Instance, upper: int, counters: Counter) -> Instance:
    """Reductions before branching, cheap ones first, starting over after a success."""
    y = distance_rule(x)
    if y is not None:
        counters["distance_rule"] += 1
        x = y
    while len(x) > 2:
        for name, rule in (
            *((r.__name__, r) for r in RULES),
            ("induced_costs", lambda z: induced_costs(z, upper)),
            ("forced_triples", lambda z: bounds.forced_by(z, upper, bounds.p3_packing)),
            ("forced_stars", lambda z: bounds.forced_by(z, upper)),
            ("forced_single_merge", lambda z: bounds.forced_single_merge(z, upper)),
        ):
            y = rule(x)
            if y is not None:
                counters[name] += 1
                x = y
                break
        else:
            return x
    return x


def cluster_certificates(x: Instance, label: np.ndarray, search: Search, most: int = 50) -> list[list[int]]:
    """Clusters of a heuristic solution that are optimal whatever the rest does.

    The instance around a cluster keeps only weights with an end in it. If its optimum equals
    the cost of putting the cluster together, the cluster is part of an optimum.
    """
    out = []
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        near = np.flatnonzero((x.s[own] > 0).any(0))
        closed = np.union1d(own, near)
        if len(own) < 2 or len(closed) > most or len(closed) == len(x):
            continue
        y = x.keep(closed.tolist())
        inside = np.isin(closed, own)
        touch = np.logical_or.outer(inside, inside)
        y.s = np.where(touch, y.s, 0)
        np.fill_diagonal(y.s, 0)
        y.spent = 0
        put = int(np.where(np.triu(np.logical_and.outer(inside, inside), 1), np.maximum(-y.s, 0), 0).sum() + np.maximum(y.s[np.ix_(inside, ~inside)], 0).sum())
        try:
            if put == 0 or search.within(y, put - 1) is None:
                out.append(own.tolist())
        except (OutOfEffort, clock.OutOfTime):
            break
    return out


def solve(x: Instance, limit: int | None = None, nodes: int | None = None, seconds: float | None = None, seed: int = 1, table: int | None = None) -> Solution:
    """Solve one instance; ``worked`` is false if effort or budget ran out, with the best found so far.

    Without ``nodes`` and ``seconds`` the search goes on until it has a proof. ``seconds`` hold for
    bounds, upper bounds and reductions too. Instances up to ``table`` nodes, and what
    reductions leave of that size, go to the subset dynamic program.
    """
    with clock.deadline(seconds):
        return _solve(x, limit, nodes, seconds, seed, table)


def _solve(x: Instance, limit: int | None, nodes: int | None, seconds: float | None, seed: int, table: int | None) -> Solution:
    counters: Counter = Counter()
    table = TABLE_NODES if table is None else table
    if len(x) <= table:
        s = subset_table(x)
        s.worked &= limit is None or s.cost <= limit
        return s
    # a quarter of the time each for the first bound and the first clustering, which are the answer if time runs out
    with clock.deadline(None if seconds is None else seconds / 4):
        bound = bounds.lower_bound(x)
    with clock.deadline(None if seconds is None else seconds / 4):
        upper_label, upper = best_of_runs(x, runs=UPPER_RUNS, rounds=UPPER_ROUNDS, seed=seed, lower=bound)
    upper += x.spent
    found = [sorted(sum((x.members[i] for i in np.flatnonzero(upper_label == c)), [])) for c in np.unique(upper_label)]
    fallback = Solution(False, upper, sorted(found), 0, counters)
    search = Search(nodes, seconds)
    search.counters = counters
    spent, cliques, lower, proved = 0, [], 0, True
    try:
        frozen = cluster_certificates(x, upper_label, Search(CERTIFICATE_NODES if nodes is None else nodes // 10 + 1, CERTIFICATE_SECONDS if seconds is None else seconds / 4)) if x.unit else []
        done = [i for c in frozen for i in c]
        if frozen:
            counters["cluster_certificates"] += len(frozen)
            cliques += [sorted(sum((x.members[i] for i in c), [])) for c in frozen]
            inside = sum(int(np.maximum(-np.triu(x.s[np.ix_(c, c)], 1), 0).sum()) for c in frozen)
            which = np.full(len(x), -1)
            for k, c in enumerate(frozen):
                which[c] = k
            cross = np.triu((which[:, None] != which[None, :]) & ((which >= 0)[:, None] | (which >= 0)[None, :]), 1)
            spent += inside + int(np.where(cross, np.maximum(x.s, 0), 0).sum())
        rest = x.keep([i for i in range(len(x)) if i not in set(done)]) if done else x
        base = x.spent
        if len(rest):
            rest = rest.copy()
            rest.spent = 0
            room = upper - spent - base
            reduced = root_reductions(rest, room, counters)
            spent += reduced.spent
            parts = [reduced.keep(p) for p in sorted(reduced.components(), key=len)]
            for p in parts:
                p.spent = 0
                lower += bounds.lower_bound(p)
            for p in parts:
                if len(p) <= table:
                    s = subset_table(p)
                    if not s.worked:
                        raise Infeasible("a component has no finite solution")
                    spent += s.cost
                    cliques += s.cliques
                    counters["small_components"] += 1
                    continue
                for budget in range(bounds.lower_bound(p), upper + 1):
                    solved = search.within(p, budget)
                    if solved is not None:
                        spent += solved.spent
                        cliques += [sorted(sum((solved.members[i] for i in c), [])) for c in solved.components()]
                        break
                else:
                    raise Infeasible("no solution within the upper bound")
        total = spent + base
        if limit is not None and total > limit:
            proved = False
        return Solution(proved, total, sorted(cliques), total, counters)
    except (OutOfEffort, clock.OutOfTime):
        fallback.lower = min(upper, max(bound, spent + lower) + x.spent)
        return fallback
