"""Scans, projections and filters over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.storage import cut, table


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (src, dst)."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("a")).select("a.*")


def ends(edges: DataFrame) -> DataFrame:
    """Nodes that have an edge: (id)."""
    return arcs(edges).select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree), with isolated nodes of ``nodes`` at 0."""
    d = arcs(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    if nodes is None:
        return d
    return nodes.select(F.col("id").alias("node")).join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbors(edges: DataFrame) -> DataFrame:
    """(node, neighbors) with a sorted list for each node."""
    return arcs(edges).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def neighbors_by_cluster(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(node, cluster, dst): each adjacency range in order of the neighbours' clusters when written sorted."""
    return arcs(edges).join(assign.select(F.col("node").alias("dst"), "cluster"), "dst").select(F.col("src").alias("node"), "cluster", "dst").sortWithinPartitions("node", "cluster", "dst")


def random_neighbor(edges: DataFrame, seed: int) -> DataFrame:
    """(node, neighbor): a neighbour drawn by a hash, the same in every run."""
    return arcs(edges).groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.struct(F.xxhash64(F.lit(seed), "src", "dst"), "dst")).alias("neighbor"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of the graph induced by the nodes that are not in ``gone(id)``."""
    return edges.join(gone.select(F.col("id").alias("u")), "u", "left_anti").join(gone.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")


def around_cluster(pairs: DataFrame, cluster: DataFrame) -> DataFrame:
    """``pairs(u, v, s)`` with the weight kept only where an end is in ``cluster(id)``, else 0."""
    mark = lambda end: cluster.select(F.col("id").alias(end)).distinct().withColumn(f"in_{end}", F.lit(True))
    return (
        pairs.join(mark("u"), "u", "left").join(mark("v"), "v", "left")
        .select("u", "v", F.when(F.col("in_u").isNotNull() | F.col("in_v").isNotNull(), F.col("s")).otherwise(F.lit(0)).cast("long").alias("s"))
    )


def closed_neighborhood_sizes(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, size) of each cluster together with its neighbours."""
    near = assign.join(arcs(edges).select(F.col("src").alias("node"), "dst"), "node").select("cluster", F.col("dst").alias("node"))
    return near.unionByName(assign.select("cluster", "node")).groupBy("cluster").agg(F.count_distinct("node").alias("size"))


def forbidden_count(pairs: DataFrame, forbidden: int = -(10**9)) -> DataFrame:
    """One row with the number of forbidden pairs of ``pairs(u, v, s)``."""
    return pairs.agg(F.count_if(F.col("s") == forbidden).alias("forbidden"))


def set_operation(kind: str, a: Column, b: Column) -> Column:
    """Union, intersection, difference or symmetric difference of two sorted id arrays, sorted."""
    made = {
        "union": lambda: F.array_union(a, b),
        "intersect": lambda: F.array_intersect(a, b),
        "except": lambda: F.array_except(a, b),
        "symmetric": lambda: F.array_union(F.array_except(a, b), F.array_except(b, a)),
    }[kind]
    return F.array_sort(made())


def wedges(edges: DataFrame, part: int = 1024) -> DataFrame:
    """(center, v, w) with v < w for every pair of neighbours of a node.

    The neighbours of a node are dealt over parts of about ``part``, and every pair of its parts
    meets on its own, so a hub of degree d is (d / part) ** 2 groups of bounded size.
    """
    a = arcs(edges).join(degrees(edges).select(F.col("node").alias("src"), F.ceil(F.col("degree") / part).cast("int").alias("parts")), "src")
    own, others = F.pmod(F.xxhash64("dst"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = a.select("src", F.col("dst").alias("v"), own.alias("i"), others.alias("j"))
    right = a.select("src", F.col("dst").alias("w"), own.alias("j"), others.alias("i"))
    return left.join(right, ["src", "i", "j"]).where("v < w").select(F.col("src").alias("center"), "v", "w")


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z): every triangle once, listed at its end of lowest (degree, id), so hubs list few."""
    d = degrees(edges)
    ranked = edges.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = ranked.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = out.join(out.select("x", F.col("y").alias("z")), "x").where("y < z")
    return wedge.join(edges.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"]).select("x", "y", "z")


def edge_triangles(edges: DataFrame) -> DataFrame:
    """(u, v, common) of every edge: the common neighbours of its ends."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    held = triangles(edges).select(F.explode(F.array(pair("x", "y"), pair("x", "z"), pair("y", "z"))).alias("p")).groupBy("p.u", "p.v").agg(F.count("*").alias("common"))
    return edges.select("u", "v").join(held, ["u", "v"], "left").select("u", "v", F.coalesce("common", F.lit(0)).alias("common"))


def common_neighbors(edges: DataFrame) -> DataFrame:
    """(u, v, common) for pairs with a shared neighbour, adjacent or not."""
    return wedges(edges).groupBy(F.col("v").alias("u"), F.col("w").alias("v")).agg(F.count("*").alias("common"))


def hop_distances(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, hops): shortest distances from every node of ``start(id)``, 0 to itself.

    Breadth first from all sources at once, a join and an anti-join a hop, until no pair is new
    or ``most`` hops are reached. The result has a row for every pair within reach. A neighbour of a
    node at one distance is as far, one nearer or one further, so what is new follows from the last
    two hops, and every pair is written once, as Parquet.
    """
    a = cut(arcs(edges))
    front = table(start.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct())
    seen, known, hops = front, front, 0
    while most is None or hops < most:
        hops += 1
        following = front.select("source", F.col("node").alias("src")).join(a, "src").select("source", F.col("dst").alias("node")).distinct()
        last, front = front, table(following.join(known.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen, known = seen.unionByName(front), last.unionByName(front)
    return seen


def bounded_reach(edges: DataFrame, start: DataFrame, depth: int, degree_limit: int | None = None, seed: int = 0) -> DataFrame:
    """(node, depth) of nodes within ``depth`` hops of ``start(id)``.

    Above ``degree_limit`` a node passes each neighbour on with probability limit / degree,
    drawn by a hash of seed, round and arc.
    """
    a = arcs(edges)
    if degree_limit is not None:
        a = a.join(degrees(edges).withColumnRenamed("node", "src"), "src")
    seen = start.select(F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, depth + 1):
        hop = frontier.select(F.col("node").alias("src")).join(a, "src")
        if degree_limit is not None:
            draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "src", "dst"), F.lit(1 << 53)) / F.lit(float(1 << 53))
            hop = hop.where(draw * F.col("degree") <= degree_limit)
        frontier = cut(hop.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def core_numbers(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, core): the largest k such that a subgraph of degrees of at least k holds the node.

    From the degree downwards, a round replaces every node's number by the largest h such that h
    neighbours have at least h; the fixpoint is the core. Neighbours are counted by number, capped by
    the node's own, with map-side combine, so a hub brings as many rows as it has distinct numbers.
    Raises if ``rounds`` do not suffice.
    """
    a = cut(arcs(edges))
    now = cut(degrees(edges).select("node", F.col("degree").alias("core")))
    down = W.partitionBy("node").orderBy(F.desc("n"))
    for _ in range(rounds):
        seen = a.join(now.select(F.col("node").alias("dst"), F.col("core").alias("n")), "dst").join(now.withColumnRenamed("node", "src"), "src")
        counts = seen.groupBy(F.col("src").alias("node"), "core", F.least("n", "core").alias("n")).agg(F.count("*").alias("m"))
        ranked = counts.withColumn("many", F.sum("m").over(down))
        next_ = cut(ranked.groupBy("node", "core").agg(F.max(F.least("n", "many")).alias("h")))
        if next_.where("h < core").isEmpty():
            return now
        now = next_.select("node", F.col("h").alias("core"))
    raise RuntimeError(f"core numbers have not settled after {rounds} rounds")


def degeneracy_order(edges: DataFrame) -> DataFrame:
    """(node, core, key): nodes by falling core number, then degree and id; ``key`` sorts them so."""
    return core_numbers(edges).join(degrees(edges), "node").select("node", "core", F.struct(-F.col("core"), -F.col("degree"), "node").alias("key"))
