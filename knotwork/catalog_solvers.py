"""Registered queries of the solvers, judged by SQL.

Optimal clusterings need not be unique, so most queries return for each component its cost, the
cost recomputed from the clusters, and what must hold. SQL finds the optimum on its own, by a
dynamic program over the subsets of a component. It can do so for components of up to 12
nodes, which at the scale of the comparison are all of them; Spark has no such limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import catalog
from knotwork.operators import cost, moves
from knotwork.operators.components import connected_components
from knotwork.operators.graph import ends
from knotwork.plans import solve
from knotwork.sources import derive
from knotwork.sources.config import Settings
from knotwork.storage import cut

#: A threshold at which components reach 12 nodes at the smallest scales.
DENSE = 0.375
#: Effort for a component, after which it is returned unproved: seconds and search nodes.
SECONDS, NODES = 3.0, 2000
#: Steps of the heuristics that the queries run.
QUICK = Settings(first_tries=10, evo_steps=60, local_steps=1200)


def _optimum(graph_sql: str, rest: str) -> str:
    """SQL over ``best(comp, n, m, cost)``: nodes, edges and optimal cost of every component."""
    return f"""WITH RECURSIVE {graph_sql}, {catalog._COMP},
k AS (SELECT comp, node, row_number() OVER (PARTITION BY comp ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY comp) AS n FROM comp),
ed AS (SELECT x.comp, x.i AS a, y.i AS b FROM e JOIN k x ON x.node = e.u JOIN k y ON y.node = e.v),
m AS (SELECT comp, count(*) AS m FROM ed GROUP BY 1), sz AS (SELECT DISTINCT comp, n FROM k WHERE n <= 12),
masks AS (SELECT comp, unnest(range(1, (1 << n)::BIGINT)) AS s FROM sz),
w AS (SELECT masks.comp, s, bit_count(s)::BIGINT * (bit_count(s)::BIGINT - 1) // 2 - 2 * count(ed.a) AS w FROM masks LEFT JOIN ed ON ed.comp = masks.comp AND (s >> a) & 1 = 1 AND (s >> b) & 1 = 1 GROUP BY 1, 2),
st AS (SELECT comp, (1 << n)::BIGINT - 1 AS rest, 0::BIGINT AS c FROM sz
  UNION ALL SELECT st.comp, st.rest - w.s, min(st.c + w.w) FROM st JOIN w ON w.comp = st.comp AND w.s & st.rest = w.s AND w.s & (st.rest & -st.rest) <> 0 WHERE st.rest > 0 GROUP BY 1, 2),
best AS (SELECT st.comp, sz.n, m.m, CAST(min(c) + m.m AS BIGINT) AS cost FROM st JOIN sz ON sz.comp = st.comp JOIN m ON m.comp = st.comp WHERE rest = 0 GROUP BY 1, 2, 3)
{rest}"""


def _dense(spark, sf_dir) -> DataFrame:
    return cut(derive.emb_graph(spark, sf_dir, DENSE))


_D = derive.EMB_SQL.format(least=DENSE)
_SQL: dict[str, str] = {}
_QUERIES: dict = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _judged(edges: DataFrame, result: DataFrame) -> DataFrame:
    """(comp, n, m, cost, recomputed, lower, proved): a solver's claims and the cost of its clusters."""
    r = cut(result)
    flat = r.select("node", "cluster")
    of = r.select("cluster", "comp").distinct()
    table = cost.cluster_table(edges, flat).join(of, "cluster").groupBy("comp").agg(F.sum(F.col("size") * (F.col("size") - 1) / 2 - F.col("internal") + F.col("external") / 2).cast("long").alias("recomputed"))
    m = edges.join(r.select(F.col("node").alias("u"), "comp"), "u").groupBy("comp").agg(F.count("*").alias("m"))
    return r.groupBy("comp").agg(F.count("*").alias("n"), F.max("cost").alias("cost"), F.max("lower").alias("lower"), F.bool_and("proved").alias("proved"), F.max("counters").alias("counters")).join(table, "comp").join(m, "comp")


@_query(_optimum(catalog._E, "SELECT comp, cost FROM best WHERE n <= 8"))
def exact_cost_small(spark, sf_dir):
    """Optimal cost of every component of at most 8 nodes."""
    e = catalog._emb(spark, sf_dir)
    # a component is solved by itself, so those that the result leaves out need no solution
    small = cut(solve.component_edges(e, cut(connected_components(e)), 8)[0].select("u", "v"))
    return _judged(small, solve.exact(small, nodes_limit=NODES, seconds=SECONDS)).select("comp", "cost")


@_query(_optimum(_D, "SELECT comp, n, cost, cost AS recomputed, TRUE AS proved FROM best"))
def exact_cost_dense(spark, sf_dir):
    """Every component of the denser graph by reductions, bounds and branching alone, without the subset table."""
    e = _dense(spark, sf_dir)
    return _judged(e, solve.exact(e, nodes_limit=NODES, seconds=SECONDS, table=1)).select("comp", "n", "cost", "recomputed", "proved")


@_query(_optimum(_D, "SELECT comp, TRUE AS searched FROM best WHERE m < n * (n - 1) // 2"))
def exact_counters(spark, sf_dir):
    """Components that are no cliques, and whether rules, certificates or the search were counted there."""
    e = _dense(spark, sf_dir)
    return _judged(e, solve.exact(e, nodes_limit=NODES, seconds=SECONDS, table=1)).where("m < n * (n - 1) / 2").select("comp", (F.col("counters") != "").alias("searched"))


@_query(_optimum(catalog._E, "SELECT comp, n, cost, cost AS recomputed, TRUE AS proved FROM best"))
def exact_assignment(spark, sf_dir):
    """Optimal clusters of the embedding graph, judged by component."""
    e = catalog._emb(spark, sf_dir)
    return _judged(e, solve.exact(e, nodes_limit=NODES, seconds=SECONDS)).select("comp", "n", "cost", "recomputed", "proved")


def minimum_edits(spark, sf_dir) -> DataFrame:
    """(u, v, op, proved): an edit list of the embedding graph, and whether no shorter one does for the edit's component."""
    e = catalog._emb(spark, sf_dir)
    best = cut(solve.exact(e, nodes_limit=NODES, seconds=SECONDS).select("node", "cluster", "proved"))
    return cost.edit_list(e, best.select("node", "cluster")).join(best.select(F.col("node").alias("u"), "proved"), "u").select("u", "v", "op", "proved")


@_query(_optimum(catalog._E, "SELECT comp, cost AS edits, TRUE AS cliques FROM best WHERE cost > 0"))
def exact_edits(spark, sf_dir):
    """The minimum edit list, applied: its edits in every component, and whether cliques are left.

    Where the search ended without a proof the least number of edits is not known, and ``edits`` is null."""
    e = catalog._emb(spark, sf_dir)
    comps = cut(connected_components(e))
    edits = cut(minimum_edits(spark, sf_dir))
    after = cut(e.join(edits.where("op = 'delete'"), ["u", "v"], "left_anti").select("u", "v").unionByName(edits.where("op = 'insert'").select("u", "v")))
    bad = cost.is_cluster_graph(after, cut(connected_components(after))).where("not is_clique").join(comps.select(F.col("node").alias("comp"), F.col("comp").alias("of")), "comp").groupBy("of").agg(F.count("*").alias("bad"))
    many = edits.join(comps.select(F.col("node").alias("u"), "comp"), "u").groupBy("comp").agg(F.when(F.bool_and("proved"), F.count("*")).alias("edits"))
    return many.join(bad.withColumnRenamed("of", "comp"), "comp", "left").select("comp", "edits", F.col("bad").isNull().alias("cliques"))


@_query(_optimum(catalog._E, "SELECT CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS overlapping, CAST(sum(cost) AS BIGINT) AS edits, TRUE AS ok FROM best"))
def exact_verified(spark, sf_dir):
    """The verifier's row for the optimal clustering; ``edits`` is null where a component has no proof, as
    the optimum is not known then."""
    e = catalog._emb(spark, sf_dir)
    best = cut(solve.exact(e, nodes_limit=NODES, seconds=SECONDS).select("node", "cluster", "proved"))
    proved = best.agg(F.coalesce(F.bool_and("proved"), F.lit(True)).alias("proved"))
    row = cost.verify(e, ends(e), best.select("node", "cluster")).join(proved)
    return row.select("uncovered", "overlapping", F.when(F.col("proved"), F.col("edits")).alias("edits"), "ok")


@_query(_optimum(catalog._E, "SELECT comp, cost AS optimum, TRUE AS below, cost > 0 AS positive FROM best"))
def lower_bounds(spark, sf_dir):
    """Packing bounds of every component against its optimum: none above it, none 0 where it is not.

    Without a proof the optimum is not known and null, and bounds are held against the least cost found."""
    e = catalog._emb(spark, sf_dir)
    best = _judged(e, solve.exact(e, nodes_limit=NODES, seconds=SECONDS)).select("comp", "cost", F.when(F.col("proved"), F.col("cost")).alias("optimum"))
    top = F.greatest("p3", "star", "bipartite")
    return solve.lower_bounds(e).join(best, "comp").select("comp", "optimum", (top <= F.col("cost")).alias("below"), (F.least("p3", "star", "bipartite") > 0).alias("positive"))


@_query(_optimum(catalog._E, "SELECT comp, n, cost, cost AS recomputed FROM best"))
def heuristic_portfolio(spark, sf_dir):
    """The portfolio's cost of every component, which on small ones is the optimum."""
    e = catalog._emb(spark, sf_dir)
    return _judged(e, solve.heuristic(e, QUICK)).select("comp", "n", "cost", "recomputed")


@_query(_optimum(catalog._E, "SELECT comp, cost FROM best"))
def heuristic_restarts(spark, sf_dir):
    """Restarts until none has gained for a while, from a solution that leaves every node alone."""
    e = catalog._emb(spark, sf_dir)
    settings = Settings(first_tries=2, evo_steps=20, local_steps=200, repetitions=12, fruitless=4, at_once=2)
    return _judged(e, solve.restarts(e, settings, start=cost.singletons(e))[0]).select("comp", "cost")


def _refiner(step):
    @_query(_optimum(catalog._E, "SELECT comp, n, TRUE AS consistent, TRUE AS no_worse, TRUE AS above_optimum FROM best"))
    def query(spark, sf_dir):
        e = catalog._emb(spark, sf_dir)
        # without a proof a refiner may find less than the solver did, but never less than its bound
        best = _judged(e, solve.exact(e, nodes_limit=NODES, seconds=SECONDS)).select("comp", F.when(F.col("proved"), F.col("cost")).otherwise(F.col("lower")).alias("optimum"))
        got = _judged(e, solve.refined(e, step)).join(best, "comp")
        return got.select("comp", "n", (F.col("cost") == F.col("recomputed")).alias("consistent"), (F.col("cost") <= F.col("m")).alias("no_worse"), (F.col("cost") >= F.col("optimum")).alias("above_optimum"))

    _QUERIES[f"refine_{step}"], _SQL[f"refine_{step}"] = _QUERIES.pop("query"), _SQL.pop("query")
    _QUERIES[f"refine_{step}"].__name__ = f"refine_{step}"


for _step in ("boundary_fm", "localized_fm", "remove_clusters", "split_clusters", "swap_nodes"):
    _refiner(_step)


@_query(f"WITH {catalog._E}, {catalog._ARCS}, k AS (SELECT count(DISTINCT src) AS nodes FROM a) SELECT x.mutation, nodes, TRUE AS whole FROM k, (VALUES ('large'), ('large_neighbors'), ('isolate'), ('move'), ('split')) x(mutation)")
def mutations(spark, sf_dir):
    """All five mutations of the components of the embedding graph, which must leave a clustering."""
    e = catalog._emb(spark, sf_dir)
    a = cut(connected_components(e).withColumnRenamed("comp", "cluster"))
    made = {
        "large": moves.isolate_large(a, 3, 0.5, 1), "large_neighbors": moves.isolate_large_and_neighbors(e, a, 3, 0.5, 1), "isolate": moves.isolate_nodes(a, 0.25, 1),
        "move": moves.move_nodes(e, moves.isolate_nodes(a, 0.5, 2), 0.25, 1), "split": moves.split_clusters(e, a, 0.5, 1),
    }
    out = None
    for name, b in made.items():
        b = cut(b)
        row = cost.verify(e, ends(e), b).join(b.agg(F.count("*").alias("nodes"))).select(F.lit(name).alias("mutation"), "nodes", F.col("ok").alias("whole"))
        out = row if out is None else out.unionByName(row)
    return out


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
