"""Evolutionary search on one component, and the portfolio that runs it.

Steps decide, so a seed gives the same result on every machine as long as no deadline is met;
a deadline only stops early.
"""

from __future__ import annotations

import logging
import math
import random
import time
from collections import deque
from dataclasses import dataclass, field
from enum import Enum

import numpy as np

from knotwork.plans import refine
from knotwork.plans.instance import Instance
from knotwork.plans.refine import State
from knotwork.sources.config import Settings

log = logging.getLogger("knotwork")


class Mutation(Enum):
    """Kinds of mutation, in the order of the bits that enable them."""

    LARGE_CLUSTERS = 0
    LARGE_CLUSTERS_AND_NEIGHBORS = 1
    ISOLATE_NODES = 2
    MOVE_NODES = 3
    SPLIT_CLUSTERS = 4


class Action(Enum):
    INTENSIFY = 0
    MUTATE = 1


class ActionSelector:
    """Choose in proportion to the gain of the last ``window`` uses; every action gets that many first."""

    def __init__(self, actions, window: int = 5):
        self.recent = {a: deque(maxlen=window) for a in actions}
        self.window = window

    def choose(self, rng: random.Random):
        young = [a for a, r in self.recent.items() if len(r) < self.window]
        if young:
            return rng.choice(young)
        weights = [sum(r) or 1 for r in self.recent.values()]
        return rng.choices(list(self.recent), weights)[0]

    def reward(self, action, gain: int) -> None:
        self.recent[action].append(max(0, gain))


def mutate(st: State, kind: Mutation, p: float, rng: random.Random, threshold: int = 3) -> None:
    """Change a state by one mutation."""
    clusters = np.flatnonzero(st.size > 0).tolist()
    if kind in (Mutation.LARGE_CLUSTERS, Mutation.LARGE_CLUSTERS_AND_NEIGHBORS):
        hit = {c for c in clusters if st.size[c] >= threshold and rng.random() < p}
        if kind is Mutation.LARGE_CLUSTERS_AND_NEIGHBORS:
            hit |= {int(st.label[w]) for u in range(st.n) if st.label[u] in hit for w in np.flatnonzero(st.s[u] > 0)}
        for u in [u for u in range(st.n) if st.label[u] in hit]:
            if st.size[st.label[u]] > 1 and (e := st.empty()) is not None:
                st.move(u, e)
    elif kind is Mutation.ISOLATE_NODES:
        for u in range(st.n):
            if st.size[st.label[u]] > 1 and rng.random() < p and (e := st.empty()) is not None:
                st.move(u, e)
    elif kind is Mutation.MOVE_NODES:
        for u in range(st.n):
            if rng.random() < p:
                near = sorted({int(c) for c in st.label[np.flatnonzero(st.s[u] > 0)]} - {int(st.label[u])})
                if near:
                    st.move(u, rng.choice(near))
    else:
        for c in clusters:
            own = np.flatnonzero(st.label == c)
            if len(own) > 2 and rng.random() < p and (e := st.empty()) is not None:
                u = int(rng.choice(own.tolist()))
                st.move(u, e)
                rest = own[own != u]
                st.move(int(min(rest.tolist(), key=lambda w: (st.delta(w, e), w))), e)


def improve(st: State, cfg: Settings, rng: random.Random, rounds: int, first: bool, special: bool, target: int | None = None) -> int:
    """Label propagation, then swapping, removing and splitting as the situation asks."""
    total = refine.label_propagation(st, rounds, rng, "random" if first or cfg.evo_random_order else cfg.lp_order, cfg.lp_window, cfg.lp_least, target, cfg.lp_target_distance)
    if special or first:
        for _ in range(cfg.first_swap_rounds if first else cfg.swap_rounds):
            d = refine.swap_nodes(st, rng, cfg.swap_largest)
            total += d
            if d == 0:
                break
    if not special and (first or rng.random() < 0.5):
        for step, rounds in ((refine.remove_clusters, cfg.remove_rounds), (refine.split_clusters, cfg.split_rounds)):
            for _ in range(rounds):
                d = step(st, rng)
                total += d
                if d == 0:
                    break
    return total


@dataclass
class Evolution:
    """A pool of states that is intensified and mutated; the worst gives way to better ones."""

    x: Instance
    cfg: Settings
    rng: random.Random
    special: bool = False
    pool: list = field(default_factory=list)
    steps: int = 0

    def start(self, label: np.ndarray | None = None) -> None:
        for _ in range(self.cfg.pool):
            st = State(self.x, label)
            improve(st, self.cfg, self.rng, self.cfg.first_rounds, True, self.special)
            self.pool.append([st.cost(), st.label.copy()])
        self.actions = ActionSelector(list(Action))
        self.kinds = [m for m, bit in zip(Mutation, self.cfg.mutations) if bit == "1"]
        self.mutations = ActionSelector(self.kinds)

    def step(self) -> int:
        """One step; returns the gain over the best."""
        self.steps += 1
        if self.steps == self.cfg.all_mutations_after:
            self.kinds = list(Mutation)
            self.mutations = ActionSelector(self.kinds)
        before = min(c for c, _ in self.pool)
        member = self.rng.choice(self.pool)
        action = self.actions.choose(self.rng) if self.kinds else Action.INTENSIFY
        st = State(self.x, member[1])
        if action is Action.INTENSIFY:
            improve(st, self.cfg, self.rng, self.cfg.intensify_rounds, False, self.special)
            gain = member[0] - st.cost()
            member[0], member[1] = st.cost(), st.label.copy()
        else:
            kind = self.mutations.choose(self.rng)
            low, high = self.cfg.mutation_p[kind.value]
            mutate(st, kind, self.rng.uniform(low, high), self.rng, self.cfg.large_cluster)
            improve(st, self.cfg, self.rng, self.cfg.mutate_rounds, False, self.special, before - st.cost())
            cost = st.cost()
            worst = max(self.pool, key=lambda m: m[0])
            gain = worst[0] - cost
            if cost <= worst[0]:
                worst[0], worst[1] = cost, st.label.copy()
            self.mutations.reward(kind, gain)
        self.actions.reward(action, gain)
        return before - min(c for c, _ in self.pool)


def localized_step(st: State, cfg: Settings, rng: random.Random) -> int:
    """Mutate a few nodes, repair their surroundings, keep the result if it does not cost."""
    saved, delta = st.label.copy(), 0
    u = rng.randrange(st.n)
    touched = []
    for _ in range(rng.randint(cfg.local_least, cfg.local_most)):
        touched.append(u)
        near = np.flatnonzero(st.s[u] > 0)
        options = sorted({int(c) for c in st.label[near]} - {int(st.label[u])})
        e = st.empty()
        if options and (rng.random() < 0.5 or e is None):
            delta += st.move(u, rng.choice(options))
        elif e is not None and st.size[st.label[u]] > 1:
            delta += st.move(u, e)
        u = int(rng.choice(near.tolist())) if len(near) and rng.random() < cfg.local_adjacent else rng.randrange(st.n)
    region, frontier = list(dict.fromkeys(touched)), list(dict.fromkeys(touched))
    for _ in range(cfg.local_distance):
        following = []
        for w in frontier:
            near = np.flatnonzero(st.s[w] > 0).tolist()
            if len(near) > cfg.local_degree:
                near = [v for v in near if rng.random() <= cfg.local_degree / len(near)]
            following += near
        frontier = [v for v in dict.fromkeys(following) if v not in set(region)]
        region += frontier
    for _ in range(cfg.local_rounds):
        now = 0
        for w in region:
            c, d = st.best(w, rng)
            if d < 0:
                now += st.move(w, c)
        delta += now
        if now == 0:
            break
    if delta > 0:
        st.restore(saved)
        return 0
    return delta


def is_special(x: Instance, label: np.ndarray, edges: int = 1_000_000) -> bool:
    """Large and sparse, with tiny clusters: degree below 20, more than ``edges`` edges, and cluster
    sizes of at most 2 at the upper quartile, 4 at the last percentile and 6 at most."""
    degree = (x.s > 0).sum(1)
    if degree.max(initial=0) >= 20 or degree.sum() // 2 <= edges:
        return False
    size = np.sort(np.unique(label, return_counts=True)[1])
    at = lambda q: size[max(0, math.ceil(q * len(size)) - 1)]
    return bool(at(0.75) <= 2 and at(0.99) <= 4 and size[-1] <= 6)


def portfolio(x: Instance, cfg: Settings, seed: int = 1, deadline: float | None = None, label: np.ndarray | None = None, lower: int = 0) -> tuple[np.ndarray, int, list[int]]:
    """Bursts of both evolutions; the one that gained more per step runs next.

    Returns labels, cost, and the best cost after each burst. The first state is the best of
    ``first_tries`` starts, or ``label``. Bursts go on until both evolutions have had their steps,
    the deadline passes or the cost meets ``lower``. Ties go to the pool three times in four. A
    strategy that has been idle for seven bursts is tried again if it gained little last time.
    """
    rng = random.Random(seed)
    evo = Evolution(x, cfg, rng)
    special = lambda own: is_special(x, own, cfg.special_edges) if cfg.special is None else cfg.special
    evo.special = bool(cfg.special) if label is None else special(label)
    best = None
    late = lambda: deadline is not None and time.monotonic() > deadline
    until = time.monotonic() + cfg.first_seconds
    for _ in range(max(1, cfg.first_tries if label is None else 1)):
        evo.pool.clear()
        evo.start(label)
        cost, found = min(evo.pool, key=lambda m: m[0])
        if best is None or cost < best[0]:
            best = (cost, found.copy())
        if best[0] <= lower or time.monotonic() > until or late():
            break
    evo.pool[0] = [best[0], best[1].copy()]
    evo.special = special(best[1])
    history, rate, idle = [best[0]], {"evolution": None, "localized": None}, {"evolution": 0, "localized": 0}
    left = {"evolution": cfg.evo_steps if cfg.use_evolution else 0, "localized": cfg.local_steps if cfg.use_localized else 0}
    size = {"evolution": cfg.burst, "localized": cfg.burst * cfg.local_per_step}
    ends = time.monotonic() + cfg.evo_seconds
    while best[0] > lower and not late():
        if time.monotonic() > ends:
            left["evolution"] = 0
        able = [k for k in rate if left[k] > 0]
        if not able:
            break
        unknown = [k for k in able if rate[k] is None]
        stale = [k for k in able if idle[k] >= 7 and rate[k] is not None and rate[k] < 0.05]
        if unknown or stale:
            pick = (unknown or stale)[0]
        elif len(able) == 2 and rate["evolution"] == rate["localized"]:
            pick = "evolution" if rng.random() < 0.75 else "localized"
        else:
            pick = max(able, key=rate.get)
        before, steps = best[0], min(size[pick], left[pick])
        left[pick] -= steps
        if pick == "evolution":
            for _ in range(steps):
                evo.step()
            cost, found = min(evo.pool, key=lambda m: m[0])
        else:
            st = State(x, best[1])
            for _ in range(steps):
                localized_step(st, cfg, rng)
            cost, found = st.cost(), st.label
            if cost <= best[0]:
                evo.pool[0] = [cost, found.copy()]
        if cost < best[0]:
            best = (cost, found.copy())
        rate[pick] = (before - best[0]) / max(1, steps)
        for k in idle:
            idle[k] = 0 if k == pick else idle[k] + 1
        history.append(best[0])
        if cfg.evo_detailed:
            log.info("%s %d steps: %d", pick, steps, best[0])
    return best[1], best[0], history
