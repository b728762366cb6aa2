"""Kernels against brute force and the subset dynamic program."""

import random
import time
from itertools import combinations

import numpy as np
import pytest

from knotwork.plans import bounds, refine, search
from knotwork.plans.evolve import ActionSelector, Evolution, Mutation, localized_step, mutate, portfolio
from knotwork.plans.instance import (
    INF, RULES, Infeasible, Instance, complex_twins, distance_rule, induced_costs, merge_cliques, pair_costs, weighted_kernel,
)
from knotwork.plans.refine import State
from knotwork.sources.config import Settings


def partitions(n):
    def grow(p, m):
        if len(p) == n:
            yield p
            return
        for g in range(m + 2):
            yield from grow([*p, g], max(m, g))

    yield from grow([0], 0)


def brute(x):
    return min(x.cost_of(np.array(p)) for p in partitions(len(x))) + x.spent


def rand(rng, n, p, w=1):
    s = np.zeros((n, n), int)
    for i, j in combinations(range(n), 2):
        s[i, j] = s[j, i] = rng.randint(1, w) if rng.random() < p else -rng.randint(1, w)
    return Instance(s)


SIX = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


def test_six_node_graph():
    s = search.solve(Instance.from_edges(6, SIX))
    assert s.worked and s.cost == 1 and s.cliques == [[0, 1, 2], [3, 4, 5]]


def test_subset_table_is_the_optimum():
    rng = random.Random(1)
    for _ in range(40):
        x = rand(rng, rng.randint(1, 6), 0.5, 3)
        assert search.subset_table(x).cost == brute(x)


def test_reductions_keep_the_optimum():
    rng = random.Random(2)
    for _ in range(120):
        x = rand(rng, rng.randint(2, 7), rng.choice([0.3, 0.5, 0.7]), rng.choice([1, 3]))
        opt = search.subset_table(x).cost
        for rule in (*RULES, merge_cliques, weighted_kernel, distance_rule):
            y = rule(x)
            assert y is None or search.subset_table(y).cost == opt, rule.__name__
        for rule in (induced_costs, bounds.forced_by, bounds.forced_single_merge, lambda z, b: bounds.forced_by(z, b, bounds.p3_packing)):
            y = rule(x, opt)
            assert y is None or search.subset_table(y).cost == opt


def test_complex_twins_beside_forbidden_pairs():
    rng, joined = random.Random(12), 0
    for _ in range(1500):
        n = rng.randint(3, 6)
        x = rand(rng, n, 0.6, 3)
        for u in range(n):
            for v in range(u):
                if x.s[u, v] < 0 and rng.random() < 0.4:
                    x.s[u, v] = x.s[v, u] = -INF
        opt = search.subset_table(x).cost
        try:
            y = complex_twins(x)
        except Infeasible:
            y = None
        if y is not None:
            joined += 1
            assert search.subset_table(y).cost == opt
    assert joined > 200


def test_bounds_are_below_the_optimum():
    rng = random.Random(3)
    for _ in range(80):
        x = rand(rng, rng.randint(2, 8), 0.5)
        opt = search.subset_table(x).cost
        assert max(bounds.p3_packing(x).value, bounds.star_packing(x).value, bounds.bipartite_bound(x)) <= opt


def test_packing_never_overuses_a_pair():
    rng = random.Random(4)
    x = rand(rng, 12, 0.5, 4)
    for make in (bounds.p3_packing, bounds.star_packing):
        pack = make(x)
        assert (pack.left >= 0).all()
        assert pack.value == sum(w * (len(p[1]) - 1) for p, w in pack.pieces.items())


def test_branch_and_bound(monkeypatch):
    monkeypatch.setattr(search, "TABLE_NODES", 3)
    rng = random.Random(5)
    for _ in range(25):
        x = rand(rng, rng.randint(4, 9), 0.45)
        s = search.solve(x)
        assert s.worked and s.cost == search.subset_table(x).cost == s.lower
        label = np.zeros(len(x), int)
        for k, c in enumerate(s.cliques):
            label[c] = k
        assert sorted(sum(s.cliques, [])) == list(range(len(x))) and x.cost_of(label) == s.cost


def test_effort_limit_gives_a_bounded_answer(monkeypatch):
    monkeypatch.setattr(search, "TABLE_NODES", 3)
    x = rand(random.Random(6), 20, 0.4)
    s = search.solve(x, nodes=2)
    assert not s.worked and s.lower <= s.cost


def test_forbidden_pair_in_complex_twins():
    s = np.array([[0, 1, -INF], [1, 0, 1], [-INF, 1, 0]])
    x = Instance(s, orig=np.array([[0, 1, -1], [1, 0, 1], [-1, 1, 0]]))
    y = complex_twins(x)
    assert y is None or y.spent < INF
    assert search.solve(x).cost == 1


def test_merge_and_forbid():
    x = Instance(np.array([[0, 2, -3], [2, 0, 1], [-3, 1, 0]]))
    y = x.merge(0, 1)
    assert y.spent == 1 and y.s[0, 1] == -2 and y.members[0] == [0, 1]
    assert x.forbid(0, 1).spent == 2
    with pytest.raises(Infeasible):
        x.forbid(0, 1).merge(0, 1)


def test_pair_costs_on_units():
    icf, icp = pair_costs(Instance.from_edges(6, SIX))
    assert icf[0, 1] == 2 and icp[0, 1] == 1 - 1 + 0 + 0 and icf[2, 3] == 1 and icp[2, 3] == 4


def test_degeneracy_and_colors():
    a = Instance.from_edges(6, SIX).positive()
    assert sorted(bounds.degeneracy_order(a)) == list(range(6))
    for c in bounds.greedy_colors(a):
        assert not a[np.ix_(c, c)].any()


def test_refiners_report_their_change():
    rng = random.Random(7)
    for _ in range(30):
        x = rand(rng, 9, 0.4, 2)
        for step in (refine.boundary_fm, refine.localized_fm, refine.remove_clusters, refine.split_clusters, refine.swap_nodes):
            st = State(x, np.array([rng.randrange(9) for _ in range(9)]))
            before = st.cost()
            d = step(st, rng)
            assert d <= 0 and st.cost() == before + d
        st = State(x)
        before = st.cost()
        assert refine.label_propagation(st, 50, rng) + before == st.cost() <= before


def test_lists_are_states():
    rng = random.Random(3)
    for k in range(100):
        n = rng.randrange(3, 25)
        edges = [(i, j) for j in range(n) for i in range(j) if rng.random() < 0.35] or [(0, 1)]
        u, v = map(np.array, zip(*edges))
        label = np.array([rng.randrange(n) for _ in range(n)])
        x = Instance.from_edges(n, edges)
        a, b = State(x, label), refine.Lists(n, u, v, label)
        for _ in range(10):
            held = np.flatnonzero(a.size)
            w, to = rng.randrange(n), int(rng.choice(held.tolist()))
            assert (a.weights(w, held) == b.weights(w, held)).all() and a.empty() == b.empty()
            assert all(a.apart(int(c), 3) == b.apart(int(c), 3) and (a.members(c) == b.members(c)).all() for c in held)
            goes, change = b.best_many(np.arange(n))
            assert all(b.best(i) == (goes[i], change[i]) and a.delta(i, goes[i]) == change[i] for i in range(n))
            assert a.move(w, to) == b.move(w, to) and a.cost() == b.cost()
        for step in (refine.boundary_fm, refine.localized_fm, refine.remove_clusters, refine.split_clusters, refine.swap_nodes):
            st = refine.Lists(n, u, v, label)
            before = st.cost()
            d = step(st, rng)
            assert d <= 0 and st.cost() == before + d == x.cost_of(st.label)


def test_nodes_swap_into_clusters_of_any_size():
    """A clique of 41 nodes, one of them apart."""
    edges = [(i, j) for j in range(41) for i in range(j)]
    u, v = map(np.array, zip(*edges))
    label = np.array([0] * 40 + [1])
    for st in (State(Instance.from_edges(41, edges), label), refine.Lists(41, u, v, label)):
        # nodes of the clique also change places with the one apart, for nothing
        assert sum(refine.swap_nodes(st, random.Random(k)) for k in range(20)) == -40 and st.cost() == 0


def test_evolution_and_portfolio():
    rng = random.Random(8)
    x = rand(rng, 10, 0.35)
    opt = search.subset_table(x).cost
    small = {"first_tries": 2, "evo_steps": 30, "local_steps": 300}
    label, value, history = portfolio(x, Settings(**small), seed=3)
    assert x.cost_of(label) == value >= opt and history == sorted(history, reverse=True)
    assert portfolio(x, Settings(**small), seed=3)[1] == value
    evo = Evolution(x, Settings(pool=3), rng)
    evo.start()
    for _ in range(5):
        worst = max(c for c, _ in evo.pool)
        evo.step()
        assert len(evo.pool) == 3 and max(c for c, _ in evo.pool) <= worst
        assert all(x.cost_of(own) == c for c, own in evo.pool)
    assert portfolio(x, Settings(**small), seed=3, label=label, lower=value)[2] == [value]
    st = State(x, label)
    before = st.cost()
    assert localized_step(st, Settings(), rng) + before == st.cost() <= before
    for kind in Mutation:
        st = State(x, label)
        mutate(st, kind, 0.7, rng)
        assert len(st.label) == 10 and st.size.sum() == 10


def test_action_selector_prefers_gain():
    sel = ActionSelector(["a", "b"], 2)
    for _ in range(2):
        sel.reward("a", 1000)
        sel.reward("b", 0)
    rng = random.Random(1)
    assert sum(sel.choose(rng) == "a" for _ in range(100)) > 90


def test_welford_stops_without_gain():
    w = refine.Welford()
    for _ in range(10):
        w.push(0.0)
    assert w.stop(5)


def test_seconds_hold_for_everything_a_kernel_does():
    """Bounds, first clusterings, reductions and the search share one deadline; what is left is valid."""
    rng = random.Random(9)
    x = Instance.from_edges(300, [(i, j) for j in range(300) for i in range(j) if rng.random() < 0.1])
    began = time.monotonic()
    s = search.solve(x, seconds=2)
    assert time.monotonic() - began < 4 and not s.worked
    assert sorted(i for c in s.cliques for i in c) == list(range(300)) and 0 < s.lower <= s.cost < (x.s > 0).sum() // 2
