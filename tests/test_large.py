"""Set moves, certificates and reductions on tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork import catalog, catalog_large, catalog_solvers
from knotwork.operators import cost, graph, setmoves
from knotwork.plans import refine, regions, search, shrink, solve, sparse
from knotwork.plans.instance import Instance
from knotwork.sources.config import Settings
from knotwork.storage import cut

TWO = "u long, v long"


def random_parts(rng, parts, n, p):
    """Edges of ``parts`` random graphs of ``n`` nodes each."""
    return [(k * n + i, k * n + j) for k in range(parts) for j in range(n) for i in range(j) if rng.random() < p]


@pytest.mark.parametrize("kind", setmoves.KINDS)
def test_deltas_of_set_moves_add_up(spark, kind):
    rng = random.Random(5)
    edges = cut(spark.createDataFrame(random_parts(rng, 4, 14, 0.35), TWO))
    assign = cut(cost.singletons(edges).select("node", (F.col("node") - F.col("node") % 4 * (F.col("node") % 3 % 2)).alias("cluster")))
    before = cost.objectives(edges, assign).first()["edits"]
    after, n, delta = setmoves.set_round(edges, assign, kind, seed=3)
    assert cost.objectives(edges, after).first()["edits"] == before + delta and (delta < 0) == (n > 0)


def test_splitting_cuts_two_triangles_and_merging_joins_a_split_clique(spark, six):
    together = cost.singletons(six).select("node", F.lit(0).cast("long").alias("cluster"))
    end, n, delta = setmoves.set_round(six, cut(together), "split")
    assert (n, delta) == (1, -7) and {frozenset(r.members) for r in cost.members(end).collect()} == {frozenset((0, 1, 2)), frozenset((3, 4, 5))}
    clique = cut(spark.createDataFrame([(i, j) for j in range(6) for i in range(j)], TWO))
    halves = cut(cost.singletons(clique).select("node", F.expr("node div 3").alias("cluster")))
    end, n, delta = setmoves.set_round(clique, halves, "merge")
    assert (n, delta) == (1, -9) and cost.cluster_sizes(end).count() == 1


def test_components_above_the_kernel_are_proved(spark):
    """A ring of 130 cliques of five, 80 of whose edges are missing: one component of 650 nodes."""
    rng, edges, n = random.Random(1), set(), 130
    for k in range(n):
        edges |= {(5 * k + j, 5 * k + i) for i in range(5) for j in range(i)}
    for k in range(n):
        edges.add(tuple(sorted((5 * k + rng.randrange(5), 5 * ((k + 1) % n) + rng.randrange(5)))))
    missing = set()
    while len(missing) < 80:
        k, (i, j) = rng.randrange(n), sorted(rng.sample(range(5), 2))
        if not any(e[0] // 5 == k for e in missing):
            missing.add((5 * k + i, 5 * k + j))
    e = cut(spark.createDataFrame(sorted(edges - missing), TWO))
    planted = cut(cost.singletons(e).select("node", F.expr("node div 5").alias("cluster")))
    found, counters = shrink.solve_tables(e, 600, nodes=200, start=planted)
    assert found.count() == 5 * n and found.where("not proved").count() == 0 and counters["frozen"] > 500
    assert cost.objectives(e, found.select("node", "cluster")).first()["edits"] == n + 80


def test_tables_find_the_optimum_of_every_component(spark):
    rng = random.Random(11)
    parts, n = 30, 9
    rows = random_parts(rng, parts, n, 0.4)
    got = solve.exact(spark.createDataFrame(rows, TWO), nodes_limit=500, most=0).groupBy("comp").agg(F.first("cost").alias("cost"), F.first("proved").alias("proved")).collect()
    assert all(r.proved for r in got)
    want = sum(search.subset_table(Instance.from_edges(n, [(u - k * n, v - k * n) for u, v in rows if u // n == k])).cost for k in range(parts))
    assert sum(r.cost for r in got) == want


def test_reductions_keep_the_optimum(spark):
    """What twins and heavy pairs leave has the optimum of the whole, for contracted nodes of any size."""
    rng = random.Random(2)
    parts, n = 25, 10
    rows = random_parts(rng, parts, n, 0.45)
    x, counters = shrink.reduced(shrink.Shrunk.of(cut(spark.createDataFrame(rows, TWO))))
    assert counters["twins"] and counters["heavy_pairs"]
    groups = {r.node: r.id for r in x.groups.collect()}
    for k in range(parts):
        own = [(u - k * n, v - k * n) for u, v in rows if u // n == k]
        whole = Instance.from_edges(n, own)
        names = [groups.get(k * n + i, -1 - i) for i in range(n)]
        joined, members = whole, [[i] for i in range(n)]
        for name in set(names):
            same = [i for i in range(n) if names[i] == name]
            for i in same[1:]:
                members = joined.members
                a = next(p for p, m in enumerate(members) if same[0] in m)
                b = next(p for p, m in enumerate(members) if i in m)
                joined = joined.merge(a, b)
        assert search.subset_table(joined).cost == search.subset_table(whole).cost


def test_estimates_do_not_grow_over_rounds(spark):
    df = spark.range(50).withColumnRenamed("id", "a")
    for _ in range(12):
        df = cut(df.join(df.select(F.col("a").alias("b")), F.col("a") == F.col("b")).join(df.select(F.col("a").alias("c")), F.col("a") == F.col("c")).select("a"))
    assert df.count() == 50 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 3000


def test_regions_gain_what_they_say_and_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    edges = cut(spark.createDataFrame(random_parts(rng, 3, 30, 0.15), TWO))
    assign = cut(cost.singletons(edges).select("node", (F.col("node") - F.col("node") % 3).alias("cluster")))
    drawn = regions.draw_regions(edges, assign, nodes=24, seed=2)
    assert drawn.groupBy("cluster").count().where("count > 1").count() == 0
    before = cost.objectives(edges, assign).first()["edits"]
    after, n, delta = regions.region_round(edges, assign, steps=30, seed=2, nodes=24)
    assert n > 1 and delta < 0 and cost.objectives(edges, after).first()["edits"] == before + delta
    again, _, other = regions.region_round(edges.repartition(3), assign.repartition(2), steps=30, seed=2, nodes=24)
    assert other == delta and again.exceptAll(after).count() == 0


def test_components_are_searched_as_lists_without_rounds_on_tables(spark, monkeypatch):
    rng = random.Random(12)
    e = cut(spark.createDataFrame(random_parts(rng, 6, 12, 0.4), TWO))
    by_tables = cost.objectives(e, shrink.heuristic_assignment(e, most=0)).first()["edits"]
    monkeypatch.setattr(shrink.moves, "label_propagation", None)
    found = cut(shrink.heuristic_assignment(e))
    assert found.count() == found.select("node").distinct().count() == graph.ends(e).count()
    edits = cost.objectives(e, found).first()["edits"]
    assert edits <= by_tables
    assert cost.objectives(e, shrink.heuristic_assignment(e, found)).first()["edits"] <= edits


def test_steps_of_the_list_search_cost_what_they_say():
    rng = random.Random(13)
    for _ in range(20):
        n = 25
        rows = random_parts(rng, 1, n, 0.3)
        near = [[(v, 1) for v in range(n) if (min(u, v), max(u, v)) in set(rows)] for u in range(n)]
        st = sparse.Sparse(near, [1] * n, [rng.randrange(6) for _ in range(n)])
        value = lambda: sum((st.label[i] == st.label[j]) != ((i, j) in set(rows)) for j in range(n) for i in range(j))
        for step in (st.dissolve, st.force, st.merge, lambda: st.settle(range(n)), st.merge, st.dissolve, st.force):
            before, change = value(), step()
            assert change <= 0 and value() == before + change


def test_a_refuted_certificate_has_a_cheaper_solution():
    rng, refuted = random.Random(14), 0
    for _ in range(150):
        k, n = rng.randint(2, 5), rng.randint(5, 9)
        s = np.zeros((n, n), np.int64)
        for i in range(k):
            for j in range(i + 1, n):
                s[i, j] = s[j, i] = 1 if rng.random() < 0.45 else -1
        put = int((np.triu(s[:k, :k], 1) < 0).sum() + (s[:k, k:] > 0).sum())
        if put and shrink.cheaper_apart(s, k, put):
            refuted += 1
            assert search.Search().within(Instance(s.copy()), put - 1) is not None
    assert refuted > 50


def test_a_round_reaches_every_small_component(spark):
    """Two hundred paths of four nodes, each cut off at both ends: a start of twice the least cost."""
    edges = cut(spark.createDataFrame([(4 * k + i, 4 * k + i + 1) for k in range(200) for i in range(3)], TWO))
    start = cut(cost.singletons(edges).select("node", F.expr("node - if(node % 4 = 2, 1, 0)").alias("cluster")))
    drawn = regions.draw_regions(edges, start)
    assert drawn.count() == drawn.select("cluster").distinct().count() == 600
    end, n, delta = regions.region_round(edges, start, steps=20)
    assert 100 < n == -delta <= 200 and cost.objectives(edges, end).first()["edits"] == 400 + delta


def test_a_start_that_is_least_need_not_gain(spark, monkeypatch):
    """Of pairs and triples of nodes no clustering costs less than the first one."""
    rows = [(10 * k, 10 * k + 1) for k in range(30)] + [(0, 5)]
    monkeypatch.setattr(catalog, "_part", lambda *_: cut(spark.createDataFrame(rows, TWO)))
    for query in ("region_round", "refine_sets"):
        assert [tuple(r) for r in catalog.queries()[query](spark, "").collect()] == [(61, True, True)]
    assert not catalog_large._gains(catalog._part(), 2, 0)


@pytest.mark.parametrize("step", ["boundary_fm", "localized_fm", "remove_clusters", "split_clusters", "swap_nodes"])
def test_refiners_do_the_same_on_components_of_any_size(spark, monkeypatch, step):
    """A ring of 130 cliques of five nodes: more nodes than a dense kernel takes."""
    rows = [(5 * k + i, 5 * k + j) for k in range(130) for j in range(5) for i in range(j)] + [tuple(sorted((5 * k, (5 * k + 6) % 650))) for k in range(130)]
    monkeypatch.setattr(solve, "_large", None)
    got = solve.refined(spark.createDataFrame(rows, TWO), step).collect()
    u, v = map(np.array, zip(*rows))
    rng, st = random.Random(0), refine.Lists(650, u, v)
    refine.label_propagation(st, 100, rng)
    getattr(refine, step)(st, rng)
    assert len(got) == 650 and {r.cost for r in got} == {st.cost()}
    assert {r.node: r.cluster for r in got} == {i: int(np.flatnonzero(st.label == c)[0]) for i, c in enumerate(st.label)}


def test_set_moves_go_on_while_they_gain(spark, monkeypatch):
    """Thirty rounds gain, made up and one for one, whatever their kinds."""
    monkeypatch.setattr(catalog, "_part", lambda *_: cut(spark.createDataFrame([(0, 1)], TWO)))
    monkeypatch.setattr(catalog_large, "_gains", lambda *_: True)
    monkeypatch.setattr(setmoves.moves, "round_of_moves", lambda e, now, *_: (now, 0, 0))
    left = [1] * 30
    monkeypatch.setattr(setmoves, "set_round", lambda e, now, *_: (now, 1, -left.pop()) if left else (now, 0, 0))
    monkeypatch.setattr(catalog_large.moves, "label_propagation", lambda e, **_: (cost.singletons(e), []))
    assert catalog.queries()["refine_sets"](spark, "").first().nodes == 2 and not left


def _unsolved(spark, monkeypatch):
    """A path of three nodes with a proof, and a cycle of five whose solution has none."""
    rows = [(0, 1), (1, 2)] + [(10 + i, 10 + i + 1) for i in range(4)] + [(10, 14)]
    monkeypatch.setattr(catalog, "_emb", lambda *_: cut(spark.createDataFrame(rows, TWO)))
    exact = solve.exact
    monkeypatch.setattr(solve, "exact", lambda *a, **k: exact(*a, **k).withColumn("proved", F.col("comp") == 0))


def test_edits_without_a_proof_are_no_minimum(spark, monkeypatch):
    _unsolved(spark, monkeypatch)
    rows = {(r.comp, r.edits, r.cliques) for r in catalog.queries()["exact_edits"](spark, "").collect()}
    assert rows == {(0, 1, True), (10, None, True)}
    found = catalog_solvers.minimum_edits(spark, "").collect()
    assert len(found) == 4 and all(r.proved == (r.u < 10) for r in found)


def test_a_verified_cost_without_a_proof_is_no_optimum(spark, monkeypatch):
    _unsolved(spark, monkeypatch)
    assert [tuple(r) for r in catalog.queries()["exact_verified"](spark, "").collect()] == [(0, 0, None, True)]


def test_bounds_without_a_proof_have_no_optimum(spark, monkeypatch):
    _unsolved(spark, monkeypatch)
    rows = {(r.comp, r.optimum, r.below, r.positive) for r in catalog.queries()["lower_bounds"](spark, "").collect()}
    assert rows == {(0, 1, True, True), (10, None, True, True)}


def test_core_numbers(spark):
    rng = random.Random(6)
    rows = random_parts(rng, 2, 40, 0.15) + [(100, 101)]
    got = {r.node: r.core for r in graph.core_numbers(spark.createDataFrame(rows, TWO)).collect()}
    near = {}
    for u, v in rows:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want, k, left = {}, 0, set(near)
    while left:
        low = [u for u in left if len(near[u] & left) <= k]
        if low:
            want |= dict.fromkeys(low, k)
            left -= set(low)
        else:
            k += 1
    assert got == want


def test_the_whole_graph_decides_on_the_configuration(spark):
    """Forty paths of three nodes are special once that many edges suffice; with a clique of eight they are not."""
    paths = [(3 * k, 3 * k + 1) for k in range(40)] + [(3 * k + 1, 3 * k + 2) for k in range(40)]
    clique = [(200 + i, 200 + j) for j in range(8) for i in range(j)]
    few = Settings(special_edges=50)
    assert solve.configured(cut(spark.createDataFrame(paths, TWO)), few).special is True
    assert solve.configured(cut(spark.createDataFrame(paths + clique, TWO)), few).special is False
    assert solve.configured(cut(spark.createDataFrame(paths, TWO)), Settings()).special is False
    best = solve.heuristic(spark.createDataFrame(paths + clique, TWO), Settings(special=True, first_tries=2, evo_steps=10, local_steps=100), replicas=1)
    assert sum(r.cost for r in best.groupBy("comp").agg(F.first("cost").alias("cost")).collect()) == 40


def test_small_components_are_solved_without_the_large_ones(spark, monkeypatch):
    """Of a triangle with a tail and a path of 40 nodes only the first is handed to the solver."""
    rows = [(0, 1), (0, 2), (1, 2), (2, 3)] + [(k, k + 1) for k in range(10, 49)]
    given, exact = [], solve.exact
    monkeypatch.setattr(catalog, "_emb", lambda *_: cut(spark.createDataFrame(rows, TWO)))
    monkeypatch.setattr(solve, "exact", lambda e, **options: given.append(e.count()) or exact(e, **options))
    assert [tuple(r) for r in catalog_solvers.exact_cost_small(spark, "").collect()] == [(0, 1)] and given == [4]
