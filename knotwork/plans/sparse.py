"""Local search on one component as adjacency lists: time and memory grow with its edges, not with its pairs.

Nodes move one at a time to the cluster where they cost least, or out of it; then whole clusters do, as
weighted nodes of the contracted graph; then clusters are dissolved and nodes forced to move, and what
follows is kept if it costs less. It ends when a pass over all of these gains nothing. The order is that of the
nodes, so a result is the same in every run.
"""

from __future__ import annotations

from collections import deque

import numpy as np


class Sparse:
    """A component with a clustering. ``near[i]`` holds (node, edges) of node ``i`` that stands for ``size[i]`` nodes."""

    def __init__(self, near: list[list[tuple[int, int]]], size: list[int], label: list[int]):
        self.near, self.size, self.label = near, size, label
        self.held: dict[int, int] = {}
        for i, c in enumerate(label):
            self.held[c] = self.held.get(c, 0) + size[i]
        self.fresh = max(self.held, default=-1) + 1

    def best(self, i: int) -> tuple[int | None, int]:
        """The other cluster that is best for a node, None to be alone, and the change of cost."""
        own, s = self.label[i], self.size[i]
        into: dict[int, int] = {}
        for j, e in self.near[i]:
            c = self.label[j]
            into[c] = into.get(c, 0) + e
        now = s * (self.held[own] - s) - 2 * into.pop(own, 0)
        target, least = None, 0 if self.held[own] > s else now
        for c, e in into.items():
            rating = s * self.held[c] - 2 * e
            if rating < least or (rating == least and target is not None and c < target):
                target, least = c, rating
        return target, least - now

    def move(self, i: int, target: int | None) -> None:
        own = self.label[i]
        self.held[own] -= self.size[i]
        if not self.held[own]:
            del self.held[own]
        if target is None:
            target, self.fresh = self.fresh, self.fresh + 1
        self.label[i] = target
        self.held[target] = self.held.get(target, 0) + self.size[i]

    def settle(self, nodes, log: list | None = None) -> int:
        """Move nodes while that gains, from the given ones on; returns the change of cost. ``log`` takes (node, cluster before)."""
        queue, waiting, change = deque(nodes), set(nodes), 0
        while queue:
            i = queue.popleft()
            waiting.discard(i)
            target, delta = self.best(i)
            if delta >= 0:
                continue
            if log is not None:
                log.append((i, self.label[i]))
            self.move(i, target)
            change += delta
            for j, _ in self.near[i]:
                if j not in waiting and self.label[j] != self.label[i]:
                    waiting.add(j)
                    queue.append(j)
        return change

    def dissolve(self) -> int:
        """Every cluster of two nodes and more is left by all of them, one after another; undone unless it gains."""
        change, members = 0, {}
        for i, c in enumerate(self.label):
            members.setdefault(c, []).append(i)
        for c in sorted(members):
            own = [i for i in members[c] if self.label[i] == c]
            if len(own) < 2:
                continue
            log, delta = [], 0
            for i in own:
                target, d = self.best(i)
                if target is not None or self.held[c] > self.size[i]:
                    log.append((i, c))
                    self.move(i, target)
                    delta += d
            delta += self.settle(own, log)
            if delta < 0:
                change += delta
            else:
                for i, before in reversed(log):
                    self.move(i, before)
        return change

    def force(self) -> int:
        """Every node moves to its best other cluster though that costs; undone unless what follows gains more."""
        change = 0
        for i in range(len(self.near)):
            target, delta = self.best(i)
            if target is None:
                continue
            log, from_ = [(i, self.label[i])], self.label[i]
            self.move(i, target)
            delta += self.settle([j for j, _ in self.near[i] if self.label[j] in (from_, target)], log)
            if delta < 0:
                change += delta
            else:
                for j, before in reversed(log):
                    self.move(j, before)
        return change

    def merge(self) -> int:
        """Clusters move as wholes."""
        names = sorted(self.held)
        place = {c: k for k, c in enumerate(names)}
        links: list[dict[int, int]] = [{} for _ in names]
        for i, around in enumerate(self.near):
            a = place[self.label[i]]
            for j, e in around:
                b = place[self.label[j]]
                if a != b:
                    links[a][b] = links[a].get(b, 0) + e
        top = Sparse([list(x.items()) for x in links], [self.held[c] for c in names], list(range(len(names))))
        change = top.settle(range(len(names)))
        if change:
            self.__init__(self.near, self.size, [top.label[place[c]] for c in self.label])
        return change


def improved(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A clustering of the nodes 0 to ``n`` - 1 with edges ``u``, ``v`` that no step of the search improves."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b in sorted(zip(u.tolist(), v.tolist())):
        near[a].append((b, 1))
        near[b].append((a, 1))
    st = Sparse(near, [1] * n, np.unique(label, return_inverse=True)[1].ravel().tolist())
    while st.settle(range(n)) + st.merge() + st.dissolve() + st.force() < 0:
        pass
    return np.array(st.label, np.int64)
