"""Registered queries of the graph operators and their SQL.

Most run on the graph of parts that are together in two orders, or on the graph of embeddings
with cosine 0.4; the name says which. SQL builds the same graph on its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.quartiles import statistics, statistics_sql
from knotwork.functions.ranks import ranked
from knotwork.operators import cost, graph, measure, moves
from knotwork.operators.components import component_labels, connected_components
from knotwork.sources import derive, files
from knotwork.storage import cut, read_table, shared_dir

EMB = 0.4
_E = derive.EMB_SQL.format(least=EMB)
_P = derive.PART_SQL.format(least=2)
_P3 = derive.PART_SQL.format(least=3)
_ARCS = "a AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e)"
_DEG = f"{_ARCS}, d AS (SELECT src AS node, count(*) AS degree FROM a GROUP BY 1)"
_COMMON = "c AS (SELECT x.dst AS u, y.dst AS v, count(*) AS common FROM a x JOIN a y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2)"
_NEAR = f"""{_DEG}, {_COMMON}, n AS (SELECT q.u, q.v, q.edge, q.common, x.degree AS du, y.degree AS dv FROM
  (SELECT coalesce(e.u, c.u) AS u, coalesce(e.v, c.v) AS v, CASE WHEN e.u IS NULL THEN 0 ELSE 1 END AS edge, coalesce(common, 0) AS common
   FROM e FULL JOIN c ON e.u = c.u AND e.v = c.v) q JOIN d x ON x.node = q.u JOIN d y ON y.node = q.v)"""
_WEDGE = f"{_ARCS}, p3 AS (SELECT x.src AS center, x.dst AS v, y.dst AS w FROM a x JOIN a y ON x.src = y.src AND x.dst < y.dst WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = x.dst AND e.v = y.dst))"
_COMP = f"""{_ARCS}, r AS (SELECT src AS node, src AS reach FROM a UNION SELECT r.node, a.dst FROM r JOIN a ON a.src = r.reach),
comp AS (SELECT node, min(reach) AS comp FROM r GROUP BY 1)"""


def _rec(graph_sql: str, rest: str) -> str:
    return f"WITH RECURSIVE {graph_sql}, {_COMP}{rest}"


def _with(graph_sql: str, rest: str) -> str:
    return f"WITH {graph_sql}, {rest}"


_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _emb(spark, sf_dir) -> DataFrame:
    return cut(derive.emb_graph(spark, sf_dir, EMB))


def _part(spark, sf_dir, least: int = 2) -> DataFrame:
    return cut(derive.part_graph(spark, sf_dir, least))


def _comps(edges: DataFrame) -> DataFrame:
    return cut(connected_components(edges))


def _as_assign(comps: DataFrame) -> DataFrame:
    return comps.withColumnRenamed("comp", "cluster")


@_query(_with(_E, "z AS (SELECT 1) SELECT u, v FROM e"))
def graph_edges_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.emb_graph(spark, sf_dir, EMB)


@_query(_with(_P, "z AS (SELECT 1) SELECT u, v FROM e"))
def graph_edges_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.part_graph(spark, sf_dir)


@_query(_with(_P, f"{_DEG} SELECT node, degree FROM d"))
def degrees(spark, sf_dir):
    return graph.degrees(derive.part_graph(spark, sf_dir))


@_query(_with(_P, f"{_DEG} {statistics_sql('d', 'degree', 'degree')}"))
def degree_stats(spark, sf_dir):
    return statistics(graph.degrees(derive.part_graph(spark, sf_dir)), "degree", "degree")


@_query(_with(_P, f"{_ARCS} SELECT src AS node, array_to_string(list(dst ORDER BY dst), ',') AS neighbors FROM a GROUP BY 1"))
def neighbors_list(spark, sf_dir):
    return graph.neighbors(derive.part_graph(spark, sf_dir)).select("node", F.array_join("neighbors", ",").alias("neighbors"))


@_query(_with(_P, f"{_ARCS}, {_COMMON} SELECT u, v, common FROM c"))
def common_neighbors(spark, sf_dir):
    return graph.common_neighbors(_part(spark, sf_dir))


@_query(_with(_P, f"{_ARCS}, g AS (SELECT DISTINCT src AS id FROM a WHERE src % 3 = 0) SELECT u, v FROM e WHERE u NOT IN (SELECT id FROM g) AND v NOT IN (SELECT id FROM g)"))
def induced_subgraph(spark, sf_dir):
    e = _part(spark, sf_dir)
    return graph.without_nodes(e, graph.ends(e).where("id % 3 = 0"))


@_query(_with(_P, f"{_ARCS}, s AS (SELECT min(src) AS id FROM a), h1 AS (SELECT DISTINCT dst AS node FROM a JOIN s ON src = id), h2 AS (SELECT DISTINCT a.dst AS node FROM a JOIN h1 ON a.src = h1.node) SELECT node, min(depth) AS depth FROM (SELECT id AS node, 0 AS depth FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY 1"))
def bounded_reach(spark, sf_dir):
    e = _part(spark, sf_dir)
    return graph.bounded_reach(e, graph.arcs(e).agg(F.min("src").alias("id")), 2)


@_query(_with(_P, f"{_WEDGE} SELECT center, v, w FROM p3"))
def p3_list(spark, sf_dir):
    return measure.p3_list(_part(spark, sf_dir))


_PAIRS3 = "q AS (SELECT least(center, v) AS u, greatest(center, v) AS v FROM p3 UNION ALL SELECT least(center, w), greatest(center, w) FROM p3 UNION ALL SELECT v, w FROM p3)"


@_query(_with(_P, f"{_WEDGE}, {_PAIRS3} SELECT u, v, count(*) AS p3 FROM q GROUP BY 1, 2"))
def p3_count_per_pair(spark, sf_dir):
    return measure.p3_per_pair(_part(spark, sf_dir))


@_query(_with(_P, f"{_WEDGE} SELECT (SELECT count(*) FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v) AS triangles, (SELECT count(*) FROM p3) AS p3"))
def triangle_count(spark, sf_dir):
    return measure.triangle_count(_part(spark, sf_dir))


_ICF = f"{_NEAR}, i AS (SELECT u, v, CAST(edge + common AS BIGINT) AS icf, CAST(1 - edge + du + dv - 2 * common - 2 * edge AS BIGINT) AS icp FROM n)"


@_query(_with(_P, f"{_ICF} SELECT u, v, icf, icp FROM i"))
def icf_icp(spark, sf_dir):
    return measure.icf_icp(_part(spark, sf_dir))


@_query(_with(_P, f"{_ICF} SELECT * FROM (SELECT u, v, CASE WHEN least(icf, icp) > 6 THEN 'infeasible' WHEN icf > 6 THEN 'merge' WHEN icp > 6 THEN 'forbid' END AS decision FROM i) WHERE decision IS NOT NULL"))
def icx_decisions(spark, sf_dir):
    return measure.icx_decisions(_part(spark, sf_dir), 6)


@_query(_rec(_E, f", {_COMMON} SELECT x.comp, x.node AS u, y.node AS v FROM comp x JOIN comp y ON x.comp = y.comp AND x.node < y.node WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = x.node AND e.v = y.node) AND NOT EXISTS (SELECT 1 FROM c WHERE c.u = x.node AND c.v = y.node)"))
def distance3_forbidden(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return measure.far_pairs(e, _comps(e))


_TWIN = f"{_ARCS}, t AS (SELECT src, list(dst ORDER BY dst) AS l FROM (SELECT src, dst FROM a UNION ALL SELECT DISTINCT src, src FROM a) GROUP BY 1), tw AS (SELECT src AS node, min(src) OVER (PARTITION BY l) AS twin, count(*) OVER (PARTITION BY l) AS many FROM t)"


@_query(_with(_P, f"{_TWIN} SELECT node, twin FROM tw WHERE many > 1"))
def twins(spark, sf_dir):
    return measure.twins(_part(spark, sf_dir))


@_query(_with(_P, f"{_NEAR} SELECT u, v FROM n WHERE edge = 1 AND du + dv - 2 <= 1 + common"))
def heavy_edge_pairs(spark, sf_dir):
    return measure.heavy_edges(_part(spark, sf_dir))


_W = derive.PART_WEIGHT_SQL.format(least=2)


@_query(_with(_W, "t AS (SELECT n, sum(s) AS t FROM (SELECT u AS n, s FROM e UNION ALL SELECT v, s FROM e) GROUP BY 1) SELECT u, v FROM e JOIN t x ON x.n = u JOIN t y ON y.n = v WHERE 2 * s >= least(x.t, y.t)"))
def heavy_edge_single(spark, sf_dir):
    """On parts weighted by the orders that they share."""
    return measure.heavy_edges_single(derive.part_weights(spark, sf_dir))


@_query(_with(_P, f"{_NEAR} SELECT u, v FROM n WHERE edge = 0 AND least(du, dv) <= 1"))
def heavy_non_edges(spark, sf_dir):
    return measure.heavy_non_edges(_part(spark, sf_dir))


@_query(_with(_P, f"""{_DEG}, m AS (SELECT src AS c, dst AS x FROM a UNION ALL SELECT DISTINCT src, src FROM a),
k AS (SELECT c, count(*) AS size FROM m GROUP BY 1), i AS (SELECT x.c, count(*) AS inner_ FROM m x JOIN m y ON x.c = y.c AND x.x < y.x JOIN e ON e.u = x.x AND e.v = y.x GROUP BY 1),
o AS (SELECT m.c, sum(d.degree) AS around FROM m JOIN d ON d.node = m.x GROUP BY 1)
SELECT node, size, deficiency, cut FROM (SELECT k.c AS node, size, CAST(size * (size - 1) // 2 - inner_ AS BIGINT) AS deficiency, CAST(around - 2 * inner_ AS BIGINT) AS cut FROM k JOIN i ON k.c = i.c JOIN o ON k.c = o.c) WHERE 2 * deficiency + cut < size"""))
def kernel_candidates(spark, sf_dir):
    return measure.kernel_candidates(_part(spark, sf_dir))


_SIM = f"{_NEAR}, s AS (SELECT u, v, CAST(1 + common - (du + dv - 2 - 2 * common) AS BIGINT) AS score FROM n WHERE edge = 1)"


@_query(_with(_P, f"{_SIM} SELECT u, v, score FROM s ORDER BY score DESC, u DESC, v DESC LIMIT 10"))
def similarity_topk(spark, sf_dir):
    return measure.top_similar(_part(spark, sf_dir), 10)


@_query(_rec(_E, f""", p3 AS (SELECT x.src AS center, x.dst AS v, y.dst AS w FROM a x JOIN a y ON x.src = y.src AND x.dst < y.dst WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = x.dst AND e.v = y.dst)),
{_PAIRS3}, h AS (SELECT comp.comp, e.u, e.v, count(*) AS p3 FROM q JOIN e ON q.u = e.u AND q.v = e.v JOIN comp ON comp.node = e.u GROUP BY 1, 2, 3)
SELECT comp, u, v, p3 FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY p3 DESC, u, v) AS r FROM h) WHERE r = 1"""))
def branching_edge(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return measure.branching_edges(e, _comps(e))


@_query(_with(_P, f"{_WEDGE} SELECT center, min(v) AS v, CAST(min_by(w, v * 1000000 + w) AS BIGINT) AS w FROM p3 GROUP BY 1"))
def stars(spark, sf_dir):
    return measure.star_list(_part(spark, sf_dir)).select("center", F.col("leaves")[0].alias("v"), F.col("leaves")[1].alias("w"))


@_query(_rec(_P, " SELECT node, comp FROM comp"))
def components(spark, sf_dir):
    return connected_components(derive.part_graph(spark, sf_dir))


_SIZES = ", z AS (SELECT comp, count(*) AS n FROM comp GROUP BY 1), m AS (SELECT comp, count(*) AS k FROM e JOIN comp ON e.u = comp.node GROUP BY 1)"


@_query(_rec(_P, f"{_SIZES} SELECT z.comp, k = n * (n - 1) // 2 AS is_clique FROM z JOIN m ON z.comp = m.comp"))
def component_is_clique(spark, sf_dir):
    e = _part(spark, sf_dir)
    return cost.is_cluster_graph(e, _comps(e))


@_query(_rec(_P, f"{_SIZES} SELECT count(*) AS clusters, CAST(sum(n * (n - 1) // 2 - k) AS BIGINT) AS insertions, CAST(0 AS BIGINT) AS deletions, CAST(sum(n * (n - 1) // 2 - k) AS BIGINT) AS edits FROM z JOIN m ON z.comp = m.comp"))
def edit_cost_components(spark, sf_dir):
    e = _part(spark, sf_dir)
    return cost.objectives(e, _as_assign(_comps(e)))


@_query(_with(_P, f"{_ARCS} SELECT (SELECT count(DISTINCT src) FROM a) AS clusters, CAST(0 AS BIGINT) AS insertions, count(*) AS deletions, count(*) AS edits FROM e"))
def edit_cost_singletons(spark, sf_dir):
    e = _part(spark, sf_dir)
    return cost.objectives(e, cost.singletons(e))


# clusters by the id modulo 97: every kind of edge occurs
_MOD = f"{_ARCS}, g AS (SELECT DISTINCT src AS node, src % 97 AS cluster FROM a), x AS (SELECT e.u, e.v, p.cluster AS cu, q.cluster AS cv FROM e JOIN g p ON p.node = e.u JOIN g q ON q.node = e.v)"
_TABLE = f"""{_MOD}, ct AS (SELECT s.cluster, s.size, coalesce(i.n, 0) AS internal, coalesce(o.n, 0) AS external FROM (SELECT cluster, count(*) AS size FROM g GROUP BY 1) s
LEFT JOIN (SELECT cu AS cluster, count(*) AS n FROM x WHERE cu = cv GROUP BY 1) i ON i.cluster = s.cluster
LEFT JOIN (SELECT cluster, count(*) AS n FROM (SELECT cu AS cluster FROM x WHERE cu <> cv UNION ALL SELECT cv FROM x WHERE cu <> cv) GROUP BY 1) o ON o.cluster = s.cluster)"""


def _modular(edges: DataFrame, modulus: int = 97) -> DataFrame:
    return graph.ends(edges).select(F.col("id").alias("node"), (F.col("id") % modulus).alias("cluster"))


@_query(_with(_P, f"{_TABLE} SELECT cluster, size, internal, external, CAST(size * (size - 1) // 2 - internal + external AS BIGINT) AS cost FROM ct"))
def cluster_table(spark, sf_dir):
    e = _part(spark, sf_dir)
    a = _modular(e)
    return cost.cluster_table(e, a).join(cost.put_together_cost(e, a), "cluster")


@_query(_with(_P, f"{_TABLE}, s1 AS ({statistics_sql('ct', 'size', 'size')}), s2 AS ({statistics_sql('ct', 'internal', 'internal')}), s3 AS ({statistics_sql('ct', 'external', 'external')}) SELECT * FROM s1, s2, s3"))
def cluster_stats(spark, sf_dir):
    e = _part(spark, sf_dir)
    return cost.cluster_statistics(e, _modular(e))


@_query(_with(_P, f"{_MOD} SELECT u, v, 'delete' AS op FROM x WHERE cu <> cv UNION ALL SELECT p.node, q.node, 'insert' FROM g p JOIN g q ON p.cluster = q.cluster AND p.node < q.node WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = p.node AND e.v = q.node)"))
def edit_list_modular(spark, sf_dir):
    e = _part(spark, sf_dir)
    return cost.edit_list(e, _modular(e))


@_query(_rec(_E, " SELECT p.node AS u, q.node AS v, 'insert' AS op FROM comp p JOIN comp q ON p.comp = q.comp AND p.node < q.node WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = p.node AND e.v = q.node)"))
def edit_list_components(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return cost.edit_list(e, _as_assign(_comps(e)))


@_query(_with(_P, f"{_MOD} SELECT s.cluster, count(DISTINCT s.node) AS size FROM (SELECT cluster, node FROM g UNION ALL SELECT g.cluster, a.dst FROM g JOIN a ON a.src = g.node) s GROUP BY 1"))
def closed_neighborhoods(spark, sf_dir):
    e = _part(spark, sf_dir)
    return graph.closed_neighborhood_sizes(e, _modular(e))


@_query(_with(_P, f"{_MOD}, w AS (SELECT cluster FROM g GROUP BY 1) SELECT node AS cluster FROM g WHERE node NOT IN (SELECT cluster FROM w)"))
def empty_clusters(spark, sf_dir):
    return cost.empty_clusters(_modular(_part(spark, sf_dir)))


@_query(_with(_P, f"{_MOD} SELECT cluster, array_to_string(list(node ORDER BY node), ',') AS members FROM g GROUP BY 1"))
def cluster_members(spark, sf_dir):
    return cost.members(_modular(_part(spark, sf_dir))).select("cluster", F.array_join("members", ",").alias("members"))


@_query(_with(_E, f"{_DEG}, f AS (SELECT max(degree) AS d, count(*) AS n FROM d), m AS (SELECT count(*) AS m FROM e) SELECT x.least, d < 20 AND m > x.least AS special FROM f, m, (VALUES (10), (1000000)) x(least)"))
def special_instance(spark, sf_dir):
    """The embedding graph with every node alone, for two bounds on the edges."""
    e = _emb(spark, sf_dir)
    each = [cost.special_instance(e, cost.singletons(e), n).select(F.lit(n).alias("least"), "special") for n in (10, 1_000_000)]
    return each[0].unionByName(each[1])


_RATE = f"""{_DEG}, g AS (SELECT node, node % 97 AS cluster FROM d), z AS (SELECT cluster, count(*) AS n FROM g GROUP BY 1),
w AS (SELECT node, target, sum(weight) AS weight FROM (SELECT a.src AS node, g.cluster AS target, 1 AS weight FROM a JOIN g ON g.node = a.dst UNION ALL SELECT node, cluster, 0 FROM g) GROUP BY 1, 2),
ra AS (SELECT w.node, g.cluster, w.target, CAST(w.weight AS BIGINT) AS weight, CAST(z.n - CASE WHEN g.cluster = w.target THEN 1 ELSE 0 END + d.degree - 2 * w.weight AS BIGINT) AS rating
  FROM w JOIN g ON g.node = w.node JOIN d ON d.node = w.node JOIN z ON z.cluster = w.target)"""
_BEST = f"""{_RATE}, op AS (SELECT node, target, rating FROM ra WHERE target <> cluster UNION ALL SELECT d.node, NULL, d.degree FROM d JOIN g ON g.node = d.node JOIN z ON z.cluster = g.cluster WHERE z.n > 1),
bo AS (SELECT * FROM (SELECT node, target, rating, row_number() OVER (PARTITION BY node ORDER BY rating, target NULLS LAST) AS r FROM op) WHERE r = 1),
bm AS (SELECT bo.node, ra.cluster AS source, bo.target, CAST(bo.rating - ra.rating AS BIGINT) AS delta FROM bo JOIN ra ON ra.node = bo.node AND ra.target = ra.cluster WHERE bo.rating < ra.rating)"""
_ACC = f"""{_BEST}, tc AS (SELECT node, source, target, delta, source AS c FROM bm UNION ALL SELECT node, source, target, delta, target FROM bm WHERE target IS NOT NULL),
ac AS (SELECT node, source, target, delta FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY delta, node) AS r FROM tc) GROUP BY ALL HAVING max(r) = 1)""".replace("GROUP BY ALL", "GROUP BY node, source, target, delta")


@_query(_with(_P, f"{_RATE} SELECT * FROM ra"))
def move_ratings(spark, sf_dir):
    e = _part(spark, sf_dir)
    return moves.ratings(e, _modular(e))


@_query(_with(_P, f"{_BEST} SELECT * FROM bm"))
def best_moves(spark, sf_dir):
    e = _part(spark, sf_dir)
    return moves.best_moves(e, _modular(e))


@_query(_with(_P, f"""{_ACC} SELECT g.node, CASE WHEN ac.node IS NULL THEN g.cluster WHEN ac.target IS NOT NULL THEN ac.target
WHEN ac.node IN (SELECT cluster FROM g) THEN (SELECT max(node) FROM g) + 1 + ac.node ELSE ac.node END AS cluster FROM g LEFT JOIN ac ON ac.node = g.node"""))
def lp_round_1(spark, sf_dir):
    e = _part(spark, sf_dir)
    a = _modular(e)
    return moves.apply_moves(a, moves.accepted_moves(moves.best_moves(e, a)))


@_query(_with(_P, f"{_TABLE} SELECT cluster, CAST(2 * internal - size * (size - 1) // 2 AS BIGINT) AS delta FROM ct WHERE size > 1"))
def dissolve_scores(spark, sf_dir):
    e = _part(spark, sf_dir)
    return moves.dissolve_scores(e, _modular(e))


@_query(_with(_P, f"{_MOD} SELECT g.node, CASE WHEN s.n >= 20 THEN g.node ELSE g.cluster END AS cluster FROM g JOIN (SELECT cluster, count(*) AS n FROM g GROUP BY 1) s ON s.cluster = g.cluster"))
def mutate_large_isolate(spark, sf_dir):
    return moves.isolate_large(_modular(_part(spark, sf_dir)), 20)


@_query(f"""WITH RECURSIVE {_E}, {_COMP}, {_TWIN[len(_ARCS) + 2 :]}, gr AS (SELECT comp.node, comp.comp, coalesce(tw.twin, comp.node) AS g FROM comp LEFT JOIN tw ON tw.node = comp.node AND tw.many > 1),
pr AS (SELECT p.g AS gu, q.g AS gv, CASE WHEN e.u IS NULL THEN -1 ELSE 1 END AS s FROM gr p JOIN gr q ON p.comp = q.comp AND p.node < q.node LEFT JOIN e ON e.u = p.node AND e.v = q.node)
SELECT least(gu, gv) AS u, greatest(gu, gv) AS v, CAST(sum(CASE WHEN gu = gv THEN 0 ELSE s END) AS BIGINT) AS s,
CAST(CASE WHEN max(CASE WHEN gu = gv THEN 1 ELSE 0 END) = 1 THEN sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) ELSE (sum(abs(s)) - abs(sum(s))) // 2 END AS BIGINT) AS cost FROM pr GROUP BY 1, 2""")
def contract_twins(spark, sf_dir):
    """The exact solver's weighted instance of every component, twins contracted."""
    e = _emb(spark, sf_dir)
    return moves.contract_twins(e, _comps(e), measure.twins(e))


@_query(_with(_P, f"{_ARCS} SELECT count(DISTINCT src) AS nodes, CAST(0 AS BIGINT) AS moves_left, TRUE AS no_worse FROM a"))
def lp_converged(spark, sf_dir):
    """Label propagation to the end: nodes with a label, moves that would still gain, and whether it beats singletons."""
    e = _part(spark, sf_dir)
    end, costs = moves.label_propagation(e)
    end = cut(end)
    left = moves.best_moves(e, end).agg(F.count("*").alias("moves_left"))
    now = cost.objectives(e, end).select((F.col("edits") <= F.lit(costs[0])).alias("no_worse"))
    return end.agg(F.count_distinct("node").alias("nodes")).join(left).join(now)


@_query(_with(_P, f"{_WEDGE} SELECT count(*) > 0 AS any_taken, TRUE AS conflicts, TRUE AS disjoint FROM p3"))
def p3_packing(spark, sf_dir):
    """The packing, judged: whether all its triples are conflicts and no two share a pair."""
    e = _part(spark, sf_dir)
    taken = cut(measure.p3_packing(e))
    good = taken.join(measure.p3_list(e), ["center", "v", "w"], "left_semi").agg(F.count("*").alias("good"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    held = taken.select(F.explode(F.array(pair("center", "v"), pair("center", "w"), pair("v", "w"))).alias("p")).agg(F.count("*").alias("pairs"), F.count_distinct("p").alias("different"))
    return taken.agg(F.count("*").alias("n")).join(good).join(held).select((F.col("n") > 0).alias("any_taken"), (F.col("n") == F.col("good")).alias("conflicts"), (F.col("pairs") == F.col("different")).alias("disjoint"))


@_query(_with(_P, f"{_ARCS} SELECT src AS node, TRUE AS adjacent FROM a GROUP BY 1"))
def random_neighbor(spark, sf_dir):
    """Every node with whether its drawn neighbour is one."""
    e = _part(spark, sf_dir)
    drawn = graph.random_neighbor(e, 1)
    return drawn.join(graph.arcs(e).select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), F.lit(True).alias("hit")), ["node", "neighbor"], "left").select("node", F.coalesce("hit", F.lit(False)).alias("adjacent"))


@_query(f"WITH RECURSIVE {_E}, {_ARCS}, r AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM a UNION SELECT r.source, a.dst, r.hops + 1 FROM r JOIN a ON a.src = r.node WHERE r.hops < 12) SELECT source, node, min(hops) AS hops FROM r GROUP BY 1, 2")
def hop_distances(spark, sf_dir):
    """Shortest distances of all pairs of a component."""
    e = _emb(spark, sf_dir)
    return graph.hop_distances(e, graph.ends(e), 12)


@_query(_SQL["bounded_reach"])
def sampled_reach(spark, sf_dir):
    """Reach with sampling above a degree that no node has, which must lose nothing."""
    e = _part(spark, sf_dir)
    return graph.bounded_reach(e, graph.arcs(e).agg(F.min("src").alias("id")), 2, degree_limit=1_000_000)


def _place(spark) -> str:
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


@_query(_with(_E, "z AS (SELECT 1) SELECT u, v FROM e"))
def scan_graph_file(spark, sf_dir):
    """The embedding graph, written as a graph file and read back."""
    e, path = _emb(spark, sf_dir), _place(spark)
    top = e.agg(F.max("v")).first()[0] or 0
    files.write_gr(spark.range(top + 1), e, path)
    return files.read_gr(spark, path)[1]


@_query(_with(_P, "z AS (SELECT 1) SELECT u, v FROM e"))
def scan_adjacency(spark, sf_dir):
    """The graph of parts from its adjacency lists."""
    return derive.adjacency_edges(graph.neighbors(_part(spark, sf_dir)), "node", "neighbors")


@_query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS node, CAST(p_size AS BIGINT) AS cluster FROM part")
def scan_solution(spark, sf_dir):
    """Sizes of parts as clusters, written as a solution file and read back."""
    path = _place(spark)
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("cluster"))
    files.write_solution(ranked(parts, "p_partkey").select(F.col("rank").alias("node"), "cluster"), path)
    return files.read_solution(spark, path)


@_query(_with(_P, f"{_MOD} SELECT (u + 1) || ' ' || (v + 1) AS line FROM x WHERE cu <> cv UNION ALL SELECT (p.node + 1) || ' ' || (q.node + 1) FROM g p JOIN g q ON p.cluster = q.cluster AND p.node < q.node WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = p.node AND e.v = q.node)"))
def edit_sink(spark, sf_dir):
    """Lines of the edit list, written and read back."""
    e, path = _part(spark, sf_dir), _place(spark)
    files.write_edits(cost.edit_list(e, _modular(e)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def queries() -> dict:
    """Every registered query."""
    from knotwork import catalog_large, catalog_solvers

    return _QUERIES | catalog_solvers.queries() | catalog_large.queries()


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that have one."""
    from knotwork import catalog_large, catalog_solvers

    return _SQL | catalog_solvers.oracle_sql() | catalog_large.oracle_sql()
