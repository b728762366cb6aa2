"""Weighted instances of one component, and the data reductions on them.

``s[u, v] > 0`` is the cost of separating u and v, ``-s[u, v]`` the cost of joining them. A
pair may be permanent (+INF) or forbidden (-INF). ``orig`` keeps sums of original weights.
Every reduction returns a new instance, None if it does not apply, or raises ``Infeasible``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from knotwork.plans import clock

INF = 10**9


class Infeasible(Exception):
    """A pair would have to be joined and separated, or the budget cannot suffice."""


class Instance:
    """Weights, original weights, the original nodes of each node, and the cost paid so far."""

    def __init__(self, s: np.ndarray, orig: np.ndarray | None = None, members: list[list[int]] | None = None, spent: int = 0):
        self.s = np.array(s, np.int64)
        np.fill_diagonal(self.s, 0)
        self.orig = self.s.copy() if orig is None else np.array(orig, np.int64)
        self.members = [[i] for i in range(len(self.s))] if members is None else [list(m) for m in members]
        self.spent = int(spent)

    @classmethod
    def from_edges(cls, n: int, edges) -> "Instance":
        """Unit weights: 1 for an edge, -1 for any other pair."""
        s = -np.ones((n, n), np.int64)
        for u, v in edges:
            s[u, v] = s[v, u] = 1
        return cls(s)

    def __len__(self) -> int:
        return len(self.s)

    def copy(self) -> "Instance":
        return Instance(self.s, self.orig, self.members, self.spent)

    @property
    def unit(self) -> bool:
        """All pairs weigh 1 or -1."""
        off = ~np.eye(len(self), dtype=bool)
        return bool((np.abs(self.s[off]) == 1).all())

    def positive(self) -> np.ndarray:
        return self.s > 0

    def keep(self, nodes) -> "Instance":
        """The instance induced by some nodes, with their history."""
        at = np.array(list(nodes), int)
        return Instance(self.s[np.ix_(at, at)], self.orig[np.ix_(at, at)], [self.members[i] for i in at], self.spent)

    def components(self) -> list[list[int]]:
        """Components over positive pairs, each sorted, in order of the smallest node."""
        pos, left, out = self.positive(), set(range(len(self))), []
        while left:
            root = min(left)
            seen, todo = {root}, [root]
            while todo:
                for w in np.flatnonzero(pos[todo.pop()]).tolist():
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
            left -= seen
            out.append(sorted(seen))
        return out

    def is_cluster_graph(self) -> bool:
        """Positive exactly within components; a neutral pair inside one fails."""
        for c in self.components():
            inner = self.s[np.ix_(c, c)]
            if (inner[~np.eye(len(c), dtype=bool)] <= 0).any():
                return False
        return True

    def merge(self, u: int, v: int) -> "Instance":
        """Join two nodes for good."""
        a, b, pair = self.s[u], self.s[v], int(self.s[u, v])
        if pair <= -INF:
            raise Infeasible("joining a forbidden pair")
        rest = [w for w in range(len(self)) if w not in (u, v)]
        a, b = a[rest], b[rest]
        against = a * np.sign(b) < 0
        if (against & (np.abs(a) >= INF) & (np.abs(b) >= INF)).any():
            raise Infeasible("a permanent pair meets a forbidden one")
        paid = max(0, -pair) + int(np.minimum(np.abs(a), np.abs(b))[against].sum())
        new = np.where(np.abs(a) >= INF, a, np.where(np.abs(b) >= INF, b, a + b))
        out = self.keep([u, *rest])
        out.s[0, 1:] = out.s[1:, 0] = new
        out.orig[0, 1:] = out.orig[1:, 0] = self.orig[u, rest] + self.orig[v, rest]
        out.members[0] = self.members[u] + self.members[v]
        out.spent += paid
        return out

    def forbid(self, u: int, v: int) -> "Instance":
        """Separate two nodes for good."""
        pair = int(self.s[u, v])
        if pair >= INF:
            raise Infeasible("separating a permanent pair")
        out = self.copy()
        out.spent += max(0, pair)
        out.s[u, v] = out.s[v, u] = -INF
        return out

    def contract_permanent(self) -> "Instance":
        """Join permanent pairs until none is left."""
        out = self
        while True:
            clock.check()
            at = np.argwhere(np.triu(out.s, 1) >= INF)
            if not len(at):
                return out
            out = out.merge(int(at[0][0]), int(at[0][1]))

    def cost_of(self, label) -> int:
        """Cost of a clustering of the current nodes, without what was spent."""
        same = np.equal.outer(label, label)
        wrong = np.triu(np.where(same, np.maximum(-self.s, 0), np.maximum(self.s, 0)), 1)
        return int(wrong.sum())


def pair_costs(x: Instance) -> tuple[np.ndarray, np.ndarray]:
    """Least costs (icf, icp) of separating and of joining every pair."""
    s = x.s
    p, n = np.maximum(s, 0), len(x)
    icf, icp = p.copy(), np.maximum(-s, 0)
    for w in range(n):
        clock.check()
        a = np.minimum.outer(np.abs(s[:, w]), np.abs(s[:, w]))
        pos = s[:, w] > 0
        both, one = np.logical_and.outer(pos, pos), np.logical_xor.outer(pos, pos)
        both[w, :] = both[:, w] = one[w, :] = one[:, w] = False
        icf += np.where(both, a, 0)
        icp += np.where(one, a, 0)
    return icf, icp


def induced_costs(x: Instance, budget: int) -> Instance | None:
    """First pair whose separation or joining exceeds what is left of the budget."""
    icf, icp = pair_costs(x)
    left = budget - x.spent
    for u, v in combinations(range(len(x)), 2):
        if x.s[u, v] >= INF:
            return x.merge(u, v)
        if min(icf[u, v], icp[u, v]) > left:
            raise Infeasible("both choices of a pair exceed the budget")
        if icf[u, v] > left:
            return x.merge(u, v)
        if icp[u, v] > left and x.s[u, v] > -INF:
            return x.forbid(u, v)
    return None


def distance_rule(x: Instance) -> Instance | None:
    """In a unit instance pairs at distance 3 and more are never joined."""
    if not x.unit:
        return None
    a = x.positive().astype(np.int64)
    far = (a + a @ a == 0) & ~np.eye(len(x), dtype=bool)
    if not far.any():
        return None
    out = x.copy()
    out.s[far] = -INF
    return out


def simple_twins(x: Instance) -> Instance | None:
    """A non-negative pair whose rows are proportional is joined."""
    n = len(x)
    if n < 3:
        return None
    for u, v in combinations(range(n), 2):
        if x.s[u, v] < 0:
            continue
        clock.check()
        rest = [w for w in range(n) if w not in (u, v)]
        a, b = x.s[u, rest], x.s[v, rest]
        if (np.sign(a) != np.sign(b)).any() or ((a <= -INF) != (b <= -INF)).any() or ((a >= INF) != (b >= INF)).any():
            continue
        live = (a != 0) & (np.abs(a) < INF)
        a, b = a[live], b[live]
        if len(a) == 0 or (a * b[0] == b * a[0]).all():
            return x.merge(u, v)
    return None


def complex_twins(x: Instance) -> Instance | None:
    """A positive pair is joined if, wherever the other nodes are, one end may follow the other.

    Let u be with the nodes A and v with the nodes B, apart. Moving v over changes the cost by
    ``s(v, B) - s(v, A) - s(u, v)``, moving u over by ``s(u, A) - s(u, B) - s(u, v)``. If for
    every A and B one of them is not positive, some optimum has the pair together. Half the
    sum of ``|s(u, w) - s(v, w)|`` bounds the smaller change, a knapsack gives it exactly. A node
    that one end must avoid can be with the other end only, and that one must move then.
    """
    for u, v in np.argwhere(np.triu(x.s, 1) > 0).tolist():
        clock.check()
        rest = np.array([w for w in range(len(x)) if w not in (u, v)], int)
        a, b = x.s[u, rest], x.s[v, rest]
        a_off, b_off = a <= -INF, b <= -INF
        if (a >= INF).any() or (b >= INF).any():
            continue
        # nodes that neither end may join are out
        both, weight = ~(a_off & b_off), int(x.s[u, v])
        a, b = a[both], b[both]
        if 2 * weight >= int(np.abs(a - b).sum()) or weight >= _worst_change(a.tolist(), b.tolist()):
            return x.merge(u, v)
    return None


#: The change of a move that a forbidden pair rules out, once and for all.
NEVER = 10**15


def _worst_change(a: list[int], b: list[int]) -> int:
    """Over all placements (with u, with v, with neither) the largest smaller change of the two moves."""
    best = {0: 0}
    for p, q in zip(a, b):
        clock.check()
        new = dict(best)
        for first, second in best.items():
            # with u, then with v; who must avoid the node cannot move to it
            options = [] if p <= -INF else [(first - q if q > -INF else NEVER, second + p)]
            options += [] if q <= -INF else [(first + q, second - p if p > -INF else NEVER)]
            for f, t in options:
                if new.get(f, -(10**18)) < t:
                    new[f] = t
        if len(new) > 20_000:
            return 10**18
        # a move that is ruled out stays so, whatever comes after
        best = {}
        for f, t in new.items():
            f, t = min(NEVER, f) if f < NEVER // 2 else NEVER, t if t < NEVER // 2 else NEVER
            best[f] = max(best.get(f, t), t)
    return max(min(f, t) for f, t in best.items())


def heavy_edge_single(x: Instance) -> Instance | None:
    """An edge that outweighs everything else around one of its ends is joined."""
    n = len(x)
    for u in range(n):
        for v in range(n):
            if u == v or x.s[u, v] <= 0:
                continue
            clock.check()
            rest = [w for w in range(n) if w not in (u, v)]
            row = np.where(x.s[u, rest] <= -INF, np.maximum(x.s[v, rest], 0), np.abs(x.s[v, rest]))
            if int(row.sum()) <= int(x.s[u, v]):
                return x.merge(u, v)
    return None


def heavy_edge_both(x: Instance) -> Instance | None:
    """An edge whose ends standing alone cost no more than splitting them is joined."""
    p = np.maximum(x.s, 0)
    for u, v in np.argwhere(np.triu(x.s, 1) > 0).tolist():
        clock.check()
        rest = [w for w in range(len(x)) if w not in (u, v)]
        a, b = p[u, rest], p[v, rest]
        if int(a.sum() + b.sum()) <= int(x.s[u, v] + np.minimum(a, b).sum()):
            return x.merge(u, v)
    return None


def heavy_non_edges(x: Instance) -> Instance | None:
    """A negative pair that outweighs the edges of one end is forbidden; all in one pass."""
    p = np.maximum(x.s, 0)
    weight = p.sum(1)
    hit = (x.s < 0) & (x.s > -INF) & (np.minimum.outer(weight, weight) <= -x.s)
    if not hit.any():
        return None
    out = x.copy()
    out.s[hit] = -INF
    return out


def weighted_kernel(x: Instance) -> Instance | None:
    """A closed neighbourhood with little missing inside and little leaving is joined (optional rule)."""
    if (np.abs(x.s) > 1).any():
        return None
    for u in range(len(x)):
        near = [u, *np.flatnonzero(x.s[u] > 0).tolist()]
        if len(near) < 2:
            continue
        inner = x.s[np.ix_(near, near)]
        missing = int((inner[~np.eye(len(near), dtype=bool)] <= 0).sum() // 2)
        out = [w for w in range(len(x)) if w not in near]
        cut = int((x.s[np.ix_(near, out)] > 0).sum())
        if 2 * missing + cut < len(near):
            y, keep = x, set(x.members[u][:1])
            for w in near[1:]:
                a = next(i for i, m in enumerate(y.members) if keep & set(m))
                b = next(i for i, m in enumerate(y.members) if x.members[w][0] in m)
                y = y.merge(a, b)
            return y
    return None


def merge_cliques(x: Instance) -> Instance | None:
    """A complete component is one cluster (optional rule)."""
    for c in x.components():
        if len(c) > 1 and (x.s[np.ix_(c, c)][~np.eye(len(c), dtype=bool)] > 0).all():
            y = x
            first, second = x.members[c[0]][0], x.members[c[1]][0]
            a = next(i for i, m in enumerate(y.members) if first in m)
            b = next(i for i, m in enumerate(y.members) if second in m)
            return y.merge(a, b)
    return None


#: Rules that need no bound, cheap ones first.
RULES = (heavy_non_edges, heavy_edge_single, heavy_edge_both, simple_twins, complex_twins)
