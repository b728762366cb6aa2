"""Measurements over a graph: conflict triples, closeness of pairs, reduction tables.

A conflict triple (P3) is a centre with two neighbours that are not adjacent. A graph is a
disjoint union of cliques iff it has none. Wedges are joined on their centre, a hub's in parts
of bounded size. What concerns edges only needs triangles, which are listed along edges directed
from lower to higher (degree, id); conflict triples of a pair follow from degrees and common
neighbours, and their number is ``sum of C(degree, 2) - 3 * triangles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.operators.graph import arcs, common_neighbors, degrees, edge_triangles, ends, triangles, wedges
from knotwork.operators.strips import apart
from knotwork.storage import cut


def p3_list(edges: DataFrame) -> DataFrame:
    """(center, v, w) with v < w of every conflict triple."""
    return wedges(edges).join(edges.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_anti").select("center", "v", "w")


def p3_per_pair(edges: DataFrame) -> DataFrame:
    """(u, v, p3): conflict triples that hold each pair.

    An edge is in one with every neighbour of one end only, another pair with every common one.
    """
    around = F.when(F.col("edge") == 1, F.col("du") + F.col("dv") - 2 - 2 * F.col("common")).otherwise(F.col("common"))
    return near_pairs(edges).select("u", "v", around.cast("long").alias("p3")).where("p3 > 0")


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row: triangles and conflict triples."""
    closed = triangles(edges).agg(F.count("*").alias("triangles"))
    pairs = degrees(edges).agg(F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0)).cast("long").alias("wedges"))
    return closed.join(pairs).select("triangles", (F.col("wedges") - 3 * F.col("triangles")).alias("p3"))


def close_edges(edges: DataFrame) -> DataFrame:
    """(u, v, common, du, dv) of every edge."""
    d = degrees(edges)
    return edge_triangles(edges).join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v").select("u", "v", "common", "du", "dv")


def near_pairs(edges: DataFrame) -> DataFrame:
    """(u, v, edge, common, du, dv) for adjacent pairs and pairs with a shared neighbour."""
    d = degrees(edges)
    both = edges.withColumn("e", F.lit(1)).join(common_neighbors(edges), ["u", "v"], "full")
    return (
        both.select("u", "v", F.coalesce("e", F.lit(0)).alias("edge"), F.coalesce("common", F.lit(0)).alias("common"))
        .join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
        .select("u", "v", "edge", "common", "du", "dv")
    )


def icf_icp(edges: DataFrame) -> DataFrame:
    """(u, v, icf, icp): least cost of separating and of joining a pair, for near pairs."""
    return near_pairs(edges).select(
        "u", "v", (F.col("edge") + F.col("common")).cast("long").alias("icf"),
        (1 - F.col("edge") + F.col("du") + F.col("dv") - 2 * F.col("common") - 2 * F.col("edge")).cast("long").alias("icp"),
    )


def icx_decisions(edges: DataFrame, budget: int) -> DataFrame:
    """(u, v, decision) under a remaining budget: infeasible, merge or forbid."""
    low = F.least("icf", "icp")
    what = F.when(low > budget, F.lit("infeasible")).when(F.col("icf") > budget, F.lit("merge")).when(F.col("icp") > budget, F.lit("forbid"))
    return icf_icp(edges).select("u", "v", what.alias("decision")).where("decision is not null")


def far_pairs(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, u, v): pairs of one component at distance 3 or more, given comps(node, comp).

    The result is quadratic by definition; it is written strip by strip, without a join of all pairs.
    """
    return apart(edges, comps.select("node", F.col("comp").alias("cluster")), 2).select(F.col("cluster").alias("comp"), "u", "v")


def twins(edges: DataFrame) -> DataFrame:
    """(node, twin): nodes with equal closed neighbourhoods, with the smallest of their class.

    Classes of one node are left out. Nodes meet by a 128-bit digest of the neighbourhood.
    """
    near = arcs(edges).unionByName(ends(edges).select(F.col("id").alias("src"), F.col("id").alias("dst")))
    # sums of two hashes over the set, with its size: aggregates with map-side combine
    closed = near.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.xxhash64("dst").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(7), "dst")).alias("x"))
    low = closed.groupBy("n", "h", "x").agg(F.min("src").alias("twin"), F.count("*").alias("many")).where("many > 1")
    return closed.join(low, ["n", "h", "x"]).select(F.col("src").alias("node"), "twin")


def heavy_edges(edges: DataFrame) -> DataFrame:
    """(u, v): adjacent pairs that may be merged because standing alone costs no more than splitting."""
    return close_edges(edges).where("du + dv - 2 <= 1 + common").select("u", "v")


def heavy_edges_single(pairs: DataFrame) -> DataFrame:
    """(u, v): positive pairs of ``pairs(u, v, s)`` that weigh at least as much as all other weights at
    one end together, in absolute value. Pairs that are not listed weigh nothing."""
    both = pairs.select("u", "s").unionByName(pairs.select(F.col("v").alias("u"), "s"))
    total = both.groupBy("u").agg(F.sum(F.abs("s")).alias("t"))
    held = pairs.where("s > 0").join(total.withColumnRenamed("t", "tu"), "u").join(total.select(F.col("u").alias("v"), F.col("t").alias("tv")), "v")
    return held.where("2 * s >= least(tu, tv)").select("u", "v")


def heavy_non_edges(edges: DataFrame) -> DataFrame:
    """(u, v): non-adjacent pairs at distance 2 with an end of degree 1; they may be forbidden.

    Pairs further apart that qualify are forbidden by distance already. Only the arcs around the one
    neighbour of such an end are joined, so a graph's other wedges are never listed.
    """
    a = arcs(edges)
    leaves = a.join(degrees(edges).where("degree = 1").select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("leaf"), F.col("dst").alias("src"))
    beyond = leaves.join(a, "src").where("dst <> leaf")
    return beyond.select(F.least("leaf", "dst").alias("u"), F.greatest("leaf", "dst").alias("v")).distinct()


def kernel_candidates(edges: DataFrame) -> DataFrame:
    """(node, size, deficiency, cut): closed neighbourhoods with 2 * deficiency + cut < size."""
    a = arcs(edges)
    d = degrees(edges)
    # edges among the neighbours of a node are its triangles
    tri = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("inside"))
    spread = a.join(d.select(F.col("node").alias("dst"), "degree"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("degree").alias("around"))
    size = F.col("degree") + 1
    inner = F.col("degree") + F.coalesce("inside", F.lit(0))
    rows = d.join(spread, "node").join(tri, "node", "left").select(
        "node", size.alias("size"), (size * (size - 1) / 2 - inner).cast("long").alias("deficiency"),
        (F.col("degree") + F.col("around") - 2 * inner).cast("long").alias("cut"),
    )
    return rows.where("2 * deficiency + cut < size")


def similarity(edges: DataFrame) -> DataFrame:
    """(u, v, score) of adjacent pairs: 1 + common neighbours - conflict triples that hold the pair."""
    return close_edges(edges).select("u", "v", (1 + F.col("common") - (F.col("du") + F.col("dv") - 2 - 2 * F.col("common"))).cast("long").alias("score"))


def top_similar(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar pairs, ties by larger ids first."""
    return similarity(edges).orderBy(F.desc("score"), F.desc("u"), F.desc("v")).limit(k)


def branching_edges(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, u, v, p3): for each component the edge in most conflict triples, first in order on ties."""
    counted = close_edges(edges).select("u", "v", (F.col("du") + F.col("dv") - 2 - 2 * F.col("common")).cast("long").alias("p3")).where("p3 > 0")
    held = counted.join(comps.select(F.col("node").alias("u"), "comp"), "u")
    best = held.groupBy("comp").agg(F.min_by(F.struct("u", "v", "p3"), F.struct(-F.col("p3"), "u", "v")).alias("b"))
    return best.select("comp", "b.u", "b.v", "b.p3")


def star_list(edges: DataFrame) -> DataFrame:
    """(center, leaves): for each node a greedy set of pairwise non-adjacent neighbours is a star's leaves.

    Here the simplest valid star: the two smallest non-adjacent neighbours.
    """
    t = p3_list(edges)
    return t.groupBy("center").agg(F.min(F.struct("v", "w")).alias("x")).select("center", F.array("x.v", "x.w").alias("leaves"))


def p3_packing(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(center, v, w): conflict triples that share no pair, by rounds of local minima.

    In a round a triple is taken if it is the smallest, by hash, on all of its three pairs;
    triples that touch a taken pair drop out. Their number is a lower bound of the edits.
    """
    rest = p3_list(edges).withColumn("h", F.xxhash64("center", "v", "w"))
    taken = None
    pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    for _ in range(rounds):
        rest = cut(rest)
        flat = rest.withColumn("p", F.explode(F.array(pair("center", "v"), pair("center", "w"), pair("v", "w"))))
        first = flat.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h", "center", "v", "w")))
        now = cut(first.groupBy("center", "v", "w").agg(F.max("r").alias("r")).where("r = 1").select("center", "v", "w"))
        taken = now if taken is None else taken.unionByName(now)
        used = now.select(F.explode(F.array(pair("center", "v"), pair("center", "w"), pair("v", "w"))).alias("p")).distinct()
        hit = flat.join(used, "p", "left_semi").select("center", "v", "w").distinct()
        rest = rest.join(hit, ["center", "v", "w"], "left_anti")
    return taken
