"""DataFrame operators on hand-made graphs."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions.quartiles import statistics
from knotwork import storage
from knotwork.operators import cost, graph, measure, moves
from knotwork.operators.components import component_labels, connected_components
from knotwork.plans import solve
from knotwork.sources import derive
from knotwork.sources.config import Settings


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_basic_facts(six):
    assert six.count() == 7 and graph.arcs(six).count() == 14
    assert rows(graph.degrees(six)) == [(0, 2), (1, 2), (2, 3), (3, 3), (4, 2), (5, 2)]
    assert measure.triangle_count(six).first() == (2, 4)
    assert measure.p3_list(six).count() == 4
    assert cost.objectives(six, cost.singletons(six)).first()["edits"] == 7
    one = graph.ends(six).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cluster"))
    assert cost.objectives(six, one).first()["edits"] == 8


def test_optimum_and_edits(six, spark):
    best = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, cluster long")
    assert rows(cost.edit_list(six, best)) == [(2, 3, "delete")]
    v = cost.verify(six, spark.range(6), best, 1).first()
    assert v["ok"] and not cost.verify(six, spark.range(7), best, 1).first()["ok"]
    r = solve.exact(six)
    assert {x["cost"] for x in r.collect()} == {1} and r.where("proved").count() == 6
    assert rows(solve.lower_bounds(six), "p3", "star") == [(1, 1)]


def test_set_algebra(spark):
    sets = {"u": range(3, 12), "v": [1, 4, 6, 9, 11, 15], "fu": [4, 5, 9, 20], "fv": [5, 6, 20, 21]}
    df = spark.createDataFrame([tuple(list(x) for x in sets.values())], "u array<long>, v array<long>, fu array<long>, fv array<long>")
    both = graph.set_operation("intersect", F.col("u"), F.col("v"))
    left = graph.set_operation("except", graph.set_operation("except", both, F.col("fu")), F.col("fv"))
    assert df.select(left).first()[0] == [11]
    assert df.select(graph.set_operation("symmetric", F.col("fu"), F.col("fv"))).first()[0] == [4, 6, 9, 21]
    assert df.select(graph.set_operation("union", F.col("fu"), F.col("fv"))).first()[0] == [4, 5, 6, 9, 20, 21]


def test_wedges_of_a_hub_in_parts(spark):
    import itertools
    import random

    rng = random.Random(4)
    e = {(0, i) for i in range(1, 40)} | {tuple(sorted(rng.sample(range(1, 40), 2))) for _ in range(50)}
    near = {u: {b if a == u else a for a, b in e if u in (a, b)} for u in range(40)}
    df = spark.createDataFrame(sorted(e), "u long, v long")
    want = sorted((c, v, w) for c in near for v, w in itertools.combinations(sorted(near[c]), 2))
    for part in (1024, 7):
        assert rows(graph.wedges(df, part)) == want
    assert rows(graph.edge_triangles(df)) == sorted((u, v, len(near[u] & near[v])) for u, v in e)
    conflicts = [(c, v, w) for c, v, w in want if (v, w) not in e]
    assert rows(measure.p3_list(df)) == conflicts
    count = {}
    for c, v, w in conflicts:
        for p in ((c, v), (c, w), (v, w)):
            count[tuple(sorted(p))] = count.get(tuple(sorted(p)), 0) + 1
    assert rows(measure.p3_per_pair(df)) == sorted((*p, n) for p, n in count.items())


def test_components_of_a_hub(spark, monkeypatch):
    from knotwork.operators import skew

    from knotwork.operators import components

    monkeypatch.setattr(components, "ONE_TASK", 50)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    e = [(i, 1000 + i % 3) for i in range(300)] + [(i, i + 1) for i in range(2000, 2040)] + [(1000, 1002)]
    got = dict(rows(connected_components(spark.createDataFrame(e, "u long, v long").repartition(7))))
    assert {got[i] for i in range(300) if i % 3 != 1} == {0} and {got[i] for i in range(1, 300, 3)} == {1} and got[2040] == 2000


def test_hops_and_start_solutions(six, spark):
    far = {(r.source, r.node): r.hops for r in graph.hop_distances(six, spark.range(6)).collect()}
    assert far[0, 5] == 3 and far[0, 3] == 2 and far[4, 4] == 0 and len(far) == 36
    assert graph.hop_distances(six, spark.range(1), 1).count() == 3
    none = Settings(first_tries=1, evo_steps=0, local_steps=0, first_rounds=0, first_swap_rounds=0, remove_rounds=0, split_rounds=0)
    start = spark.createDataFrame([(i, i // 3 + 7) for i in range(5)], "node long, cluster long")
    assert {r.cost for r in solve.heuristic(six, none, 1, start=start).collect()} == {3}
    best, costs = solve.restarts(six, Settings(first_tries=1, evo_steps=5, local_steps=20, repetitions=6, fruitless=2, at_once=2), start=start)
    assert {r.cost for r in best.collect()} == {1} and costs[-1] == 1 and len(costs) <= 3


def test_large_components_have_a_bound(six, spark):
    r = solve.exact(six, most=3)
    row = r.first()
    assert r.count() == 6 and 0 < row.lower <= row.cost and row.counters == "label_propagation"
    assert solve.lower_bounds(six, most=3).first().star == 1
    chain = spark.range(9).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    row = solve.exact(chain, table=1).first()
    assert row.proved and row.cost == 4


@pytest.mark.parametrize("once", [1, 1 << 20])
def test_components(spark, monkeypatch, once):
    from knotwork.operators import components

    monkeypatch.setattr(components, "ONE_TASK", once)
    path = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    extra = spark.createDataFrame([(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = rows(connected_components(path.unionByName(extra)))
    assert got == sorted([(i, 1) for i in range(1, 61)] + [(100, 100), (101, 100)])
    assert rows(component_labels(spark.range(3), spark.createDataFrame([(0, 2)], "u long, v long")), "node", "comp") == [(0, 0), (1, 1), (2, 0)]
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_add_up(six, spark):
    start = spark.createDataFrame([(i, i % 2) for i in range(6)], "node long, cluster long")
    before = cost.objectives(six, start).first()["edits"]
    after, n, delta = moves.round_of_moves(six, start)
    assert n > 0 and cost.objectives(six, after).first()["edits"] == before + delta
    end, costs = moves.label_propagation(six)
    assert costs == sorted(costs, reverse=True) and cost.objectives(six, end).first()["edits"] == costs[-1] == 1


def test_contraction_matches_merging(spark):
    import random

    import numpy as np

    from knotwork.plans.instance import Instance

    rng = random.Random(3)
    for _ in range(3):
        n = 5
        s = np.zeros((n, n), int)
        data = []
        for u in range(n):
            for v in range(u + 1, n):
                s[u, v] = s[v, u] = rng.choice([-3, -2, -1, 1, 2, 3])
                data.append((u, v, int(s[u, v]), int(s[u, v])))
        pairs = spark.createDataFrame(data, "u long, v long, s long, o long")
        groups = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)], "node long, group long")
        got = moves.contract(pairs, groups)
        x = Instance(s).merge(0, 1)
        i = next(k for k, m in enumerate(x.members) if m == [2])
        x = x.merge(0, i)
        assert got.agg(F.sum("cost")).first()[0] == x.spent
        name = {tuple(sorted(m)): k for k, m in enumerate(x.members)}
        of = {0: name[(0, 1, 2)], 3: name[(3,)], 4: name[(4,)]}
        assert all(x.s[of[r["u"]], of[r["v"]]] == r["s"] for r in got.where("u <> v").collect())


def test_statistics_definition(spark):
    for values, want in (([5], (5, 0, 5, 0, 5)), ([1, 2, 3, 4], (1, 1, 2, 3, 4)), ([1, 2, 3, 4, 6, 9], (1, 2, 3, 6, 9)), ([3, 3, 8], (3, 3, 3, 3, 8))):
        got = statistics(spark.createDataFrame([(v,) for v in values], "x long"), "x", "x").first()
        assert tuple(got[:3]) == want[:3] and got["x_max"] == want[4]


def test_mutations_keep_every_node(six, spark):
    a = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, cluster long")
    for b in (moves.isolate_large(a, 3), moves.isolate_large_and_neighbors(six, a, 3, 1.0), moves.isolate_nodes(a, 0.9), moves.move_nodes(six, a, 1.0), moves.split_clusters(six, a, 1.0)):
        assert sorted(r[0] for r in b.select("node").collect()) == list(range(6))
    assert moves.isolate_large(a, 3).select("cluster").distinct().count() == 6
    assert moves.isolate_nodes(a, 1.0).groupBy("cluster").count().count() == 6


def test_far_pairs_twins_and_heavy(six, spark):
    comps = spark.createDataFrame([(i, 0) for i in range(6)], "node long, comp long")
    assert rows(measure.far_pairs(six, comps), "u", "v") == [(0, 4), (0, 5), (1, 4), (1, 5)]
    assert rows(measure.twins(six)) == [(0, 0), (1, 0), (4, 4), (5, 4)]
    assert rows(measure.branching_edges(six, comps)) == [(0, 2, 3, 4)]
    assert measure.p3_packing(six).count() >= 1


def test_similarity_edges_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if unit[i] @ unit[j] >= 0.4)
    monkeypatch.setattr(derive, "BLOCK", 7)
    assert rows(derive.similarity_edges(df, "id", "x", 0.4)) == want


def test_induced_and_local(six, spark):
    gone = spark.createDataFrame([(2,)], "id long")
    assert rows(graph.without_nodes(six, gone)) == [(0, 1), (3, 4), (3, 5), (4, 5)]
    w = six.withColumn("s", F.lit(1))
    assert rows(graph.around_cluster(w, gone)) == [(0, 1, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 4, 0), (3, 5, 0), (4, 5, 0)]
    assert rows(graph.bounded_reach(six, gone, 1)) == [(0, 1), (1, 1), (2, 0), (3, 1)]
    assert graph.forbidden_count(w).first()[0] == 0
    assert rows(graph.random_neighbor(six, 3)) == rows(graph.random_neighbor(six, 3))
    assert [r.node for r in moves.node_order(spark.range(6), six, "degree_decreasing").orderBy("key", "node").collect()][:2] == [2, 3]


def test_heuristic_is_between_bound_and_singletons(six):
    r = solve.heuristic(six, Settings(first_tries=2, evo_steps=12, local_steps=60), replicas=2)
    assert r.agg(F.max("cost")).first()[0] == 1
    c = solve.Clusterer(six)
    assert c.edits(c.exact()).count() == 1


def test_hop_distances_write_every_pair_once(spark, monkeypatch):
    path, written = spark.createDataFrame([(k, k + 1) for k in range(12)], "u long, v long"), []
    for name in ("cut", "table"):
        write = getattr(storage, name)
        monkeypatch.setattr(graph, name, lambda df, write=write: written.append(df.count()) or write(df), raising=False)
    got = {(r.source, r.node): r.hops for r in graph.hop_distances(path, spark.range(13)).collect()}
    assert got == {(a, b): abs(a - b) for a in range(13) for b in range(13)}
    assert sum(written) == len(got) + 2 * 12


@pytest.mark.parametrize("cells", [1 << 28, 200])
def test_pairs_of_large_clusters_go_by_strips(spark, monkeypatch, cells):
    """Absent and far pairs and twins by brute force, in one strip and in many; no join lists all pairs."""
    from knotwork.operators import strips

    monkeypatch.setattr(strips, "CELLS", cells)
    rng = random.Random(8)
    e = {(u, v) for u in range(60) for v in range(u + 1, 60) if rng.random() < (0.05 if v < 50 else 0.02)} | {(70, 71), (70, 72), (71, 72), (72, 73), (80, 81)} | {(0, x) for x in range(1, 60)} - {(0, 7), (0, 9)}
    df = storage.cut(spark.createDataFrame(sorted(e), "u long, v long"))
    comps = storage.cut(connected_components(df))
    comp = {r.node: r.comp for r in comps.collect()}
    near = {n: {n} | {v for u, v in e if u == n} | {u for u, v in e if v == n} for n in comp}
    pairs = [(u, v) for u in comp for v in comp if u < v and comp[u] == comp[v]]
    far, edits = measure.far_pairs(df, comps), cost.edit_list(df, comps.withColumnRenamed("comp", "cluster"))
    assert rows(far) == sorted((comp[u], u, v) for u, v in pairs if not near[u] & near[v])
    assert rows(edits) == sorted((u, v, "insert") for u, v in pairs if v not in near[u])
    assert not any("LeftAnti" in x._jdf.queryExecution().toString() for x in (far, edits))
    twin = {n: min(m for m in comp if near[m] == near[n]) for n in comp}
    many = {t: sum(x == t for x in twin.values()) for t in set(twin.values())}
    want = [(u, v, (1 if v in near[u] else -1) * many[u] * many[v], 0) for u, v in pairs if u in many and v in many] + [(t, t, 0, 0) for t, k in many.items() if k > 1]
    assert rows(moves.contract_twins(df, comps, measure.twins(df))) == sorted(want) and max(many.values()) > 1


def test_similarity_in_many_blocks(spark, monkeypatch):
    """Every pair once over an odd and an even number of blocks, and each vector goes to about half of them."""
    rng = random.Random(4)
    made = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = [(i, j) for i, a in made for j, b in made if i < j and dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 >= 0.4]
    df = spark.createDataFrame(made, "id long, x array<double>")
    for least in (11, 10):
        monkeypatch.setattr(derive, "BLOCK", least)
        monkeypatch.setattr(derive, "STRIP", 3)
        assert rows(derive.similarity_edges(df, "id", "x", 0.4)) == want
        monkeypatch.setattr(derive, "MOST", 7)
        assert rows(derive.similarity_edges(df, "id", "x", 0.4)) == want
