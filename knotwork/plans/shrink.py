"""Exact solution of components of any size on tables: certificates, reductions, then kernels.

A cluster of a heuristic solution is frozen if it is part of an optimum whatever the rest does, which
only its closed neighbourhood decides; all neighbourhoods are small groups that are solved side by
side. Freezing many at once is sound: taking a frozen cluster out of any solution never costs, and
clusters of one solution do not share nodes. What is left is contracted. Groups of nodes that some
optimum has together become one node; ``pairs(u, v, e)`` counts the edges between two nodes and ``sizes``
the nodes in each, so a pair weighs ``2 * e - size * size``, and pairs without an edge need no row.
Joined pairs are merged by components, in rounds, until no rule applies. Components over
positive weights that are small enough by then go to a kernel as weighted instances.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import moves, setmoves
from knotwork.operators.components import connected_components
from knotwork.operators.cost import cluster_sizes, singletons
from knotwork.operators.graph import arcs, closed_neighborhood_sizes, ends, triangles, without_nodes
from knotwork.plans import search, sparse
from knotwork.plans.instance import Instance
from knotwork.storage import cut, spread

#: Largest closed neighbourhood of a certificate, and the search nodes that it may take.
NEIGHBORHOOD, EFFORT = 50, 40
#: Edges of a component that one group searches as adjacency lists: a few hundred megabytes.
LIST_EDGES = 1 << 20


def cheaper_apart(s: np.ndarray, k: int, put: int) -> bool:
    """Whether the neighbourhood ``s`` of a cluster, its first ``k`` nodes, has a plain solution below ``put``.

    Tried are the cluster together, all its nodes apart, and each node apart from the others, where
    every node around joins the part that it costs least with. One that is found refutes the
    certificate without a search.
    """
    inside, around = s[:k, :k] > 0, (s[:k, k:] > 0).astype(np.int64)
    degree = around.sum(0)

    def cost(parts: list[np.ndarray]) -> int:
        held = np.array([around[p].sum(0) for p in parts])
        joined = np.array([len(p) for p in parts])[:, None] - 2 * held
        same = np.zeros((k, k), bool)
        for p in parts:
            same[np.ix_(p, p)] = True
        return int(np.triu(inside != same, 1).sum() + (degree + np.minimum(joined.min(0), 0)).sum())

    every = np.arange(k)
    return cost([every]) < put or cost([every[i : i + 1] for i in every]) < put or (k > 2 and any(cost([every[i : i + 1], np.delete(every, i)]) < put for i in every))


def certified_clusters(edges: DataFrame, assign: DataFrame, most: int = NEIGHBORHOOD, effort: int = EFFORT, among: DataFrame | None = None) -> DataFrame:
    """(cluster): clusters of two and more nodes, and ``among(cluster)`` if given, that are part of an optimal clustering.

    The instance of a cluster holds its closed neighbourhood of up to ``most`` nodes, and only
    pairs with an end in the cluster weigh anything. If no solution of it is cheaper than putting the
    cluster together and cutting it off, that is optimal. A search that runs out of ``effort``
    search nodes certifies nothing.
    """
    able = cluster_sizes(assign).where("size > 1").join(closed_neighborhood_sizes(edges, assign).where(F.col("size") <= most), "cluster", "left_semi").select("cluster")
    able = able if among is None else able.join(among, "cluster", "left_semi")
    rows = arcs(edges).join(assign.join(able, "cluster", "left_semi").withColumnRenamed("node", "src"), "src").select("cluster", "src", "dst")

    def run(key, pdf):
        u, v = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        own = np.unique(u)
        ids = np.concatenate([own, np.setdiff1d(v, own)])
        place = {int(x): i for i, x in enumerate(ids)}
        s = np.zeros((len(ids), len(ids)), np.int64)
        s[: len(own)] = s[:, : len(own)] = -1
        for a, b in zip(u.tolist(), v.tolist()):
            s[place[a], place[b]] = s[place[b], place[a]] = 1
        np.fill_diagonal(s, 0)
        inside = s[: len(own), : len(own)]
        put = int((np.triu(inside, 1) < 0).sum() + (s[: len(own), len(own) :] > 0).sum())
        try:
            ok = put == 0 or not cheaper_apart(s, len(own), put) and search.Search(effort).within(Instance(s), put - 1) is None
        except search.OutOfEffort:
            ok = False
        return pd.DataFrame({"cluster": [key[0]] if ok else []}, dtype="int64")

    return spread(rows, "cluster").groupBy("cluster").applyInPandas(run, "cluster long")


def freeze(edges: DataFrame, assign: DataFrame, rounds: int = 10, most: int = NEIGHBORHOOD, effort: int = EFFORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, cluster, round) of certified clusters, and the edges and the assignment of what is left.

    A frozen cluster leaves the graph, which makes the neighbourhoods around it smaller, so what
    failed in one round may succeed in the next; clusters beside no frozen one are as they were.
    """
    rest, now = cut(edges), cut(assign)
    frozen, beside = cut(now.limit(0).withColumn("round", F.lit(0))), None
    for k in range(1, rounds + 1):
        # nodes without an edge left stay alone, which costs nothing
        live = cut(now.join(ends(rest).withColumnRenamed("id", "node"), "node", "left_semi"))
        found = cut(live.join(certified_clusters(rest, live, most, effort, beside), "cluster", "left_semi").select("node", "cluster").withColumn("round", F.lit(k)))
        if found.isEmpty():
            return frozen, rest, live
        frozen = cut(frozen.unionByName(found))
        beside = cut(arcs(rest).join(found.select(F.col("node").alias("src")), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst").select("cluster").distinct())
        rest = cut(without_nodes(rest, found.select(F.col("node").alias("id"))))
        now = cut(live.join(found, "node", "left_anti"))
    return frozen, rest, cut(now.join(ends(rest).withColumnRenamed("id", "node"), "node", "left_semi"))


@dataclass
class Shrunk:
    """Contracted graph: ``groups(node, id)``, ``sizes(id, size)``, ``pairs(u, v, e)`` with u < v."""

    groups: DataFrame
    sizes: DataFrame
    pairs: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> "Shrunk":
        nodes = cut(ends(edges))
        one = F.lit(1).cast("long")
        return cls(nodes.select(F.col("id").alias("node"), "id"), nodes.select("id", one.alias("size")), cut(edges.select("u", "v", one.alias("e"))))

    def weighted(self) -> DataFrame:
        """(u, v, e, su, sv, s): pairs with an edge, the sizes of their ends, and their weights."""
        side = lambda end: self.sizes.select(F.col("id").alias(end), F.col("size").alias(f"s{end}"))
        return self.pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "e", "su", "sv", (2 * F.col("e") - F.col("su") * F.col("sv")).alias("s"))


def twin_pairs(x: Shrunk) -> DataFrame:
    """(u, v): pairs of weight 0 and more whose weights to all other nodes are proportional to their sizes.

    The edges of a node to the others, divided by its size, are hashed into one name that does
    not depend on their order; the pair's own edge is taken out of both names again.
    """
    w = x.weighted()
    names = lambda to, e, size: [F.xxhash64(F.lit(k), to, e / size) for k in (1, 2)]
    both = w.select(F.col("u").alias("id"), *(h.alias(f"h{k}") for k, h in enumerate(names(F.col("v"), F.col("e"), F.col("su"))))).unionByName(
        w.select(F.col("v").alias("id"), *(h.alias(f"h{k}") for k, h in enumerate(names(F.col("u"), F.col("e"), F.col("sv")))))
    )
    name = both.groupBy("id").agg(*(F.bit_xor(f"h{k}").alias(f"n{k}") for k in range(2)))
    side = lambda end: name.select(F.col("id").alias(end), *(F.col(f"n{k}").alias(f"{end}{k}") for k in range(2)))
    own = list(zip(names(F.col("v"), F.col("e"), F.col("su")), names(F.col("u"), F.col("e"), F.col("sv"))))
    held = w.where("s >= 0").join(side("u"), "u").join(side("v"), "v")
    return held.where(" and ".join(f"u{k} is not null" for k in range(2))).where((F.col("u0").bitwiseXOR(own[0][0]) == F.col("v0").bitwiseXOR(own[0][1])) & (F.col("u1").bitwiseXOR(own[1][0]) == F.col("v1").bitwiseXOR(own[1][1]))).select("u", "v")


def heavy_pairs(x: Shrunk) -> DataFrame:
    """(u, v): positive pairs that cost no more to set apart from all others than to separate.

    Setting apart cuts the positive weights around both, separating cuts the pair and, for each
    common neighbour, the smaller of two weights.
    """
    pos = cut(x.weighted().where("s > 0").select("u", "v", "s"))
    total = pos.select("u", "s").unionByName(pos.select(F.col("v").alias("u"), "s")).groupBy("u").agg(F.sum("s").alias("t"))
    # an end that is too heavy already needs no look at common neighbours: each counts the lesser weight
    near = pos.join(total.withColumnRenamed("t", "tu"), "u").join(total.select(F.col("u").alias("v"), F.col("t").alias("tv")), "v")
    near = cut(near.withColumn("lacks", F.col("tu") + F.col("tv") - 3 * F.col("s")).where(F.col("lacks") <= F.least("tu", "tv") - F.col("s")))
    pair = lambda a, b: (F.least(a, b), F.greatest(a, b))
    tri = triangles(pos.select("u", "v"))
    for name, a, b in (("xy", "x", "y"), ("xz", "x", "z"), ("yz", "y", "z")):
        low, high = pair(a, b)
        tri = tri.withColumn("u", low).withColumn("v", high).join(pos.withColumnRenamed("s", name), ["u", "v"]).drop("u", "v")
    each = F.array(*(F.struct(pair(a, b)[0].alias("u"), pair(a, b)[1].alias("v"), F.least(p, q).alias("m")) for a, b, p, q in (("x", "y", "xz", "yz"), ("x", "z", "xy", "yz"), ("y", "z", "xy", "xz"))))
    common = tri.select(F.explode(each).alias("c")).groupBy("c.u", "c.v").agg(F.sum("c.m").alias("common"))
    return near.join(common, ["u", "v"], "left").where(F.col("lacks") <= F.coalesce("common", F.lit(0))).select("u", "v")


def matching(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(u, v): pairs that are first, by a hash, at both of their ends."""
    order = F.struct(F.xxhash64(F.lit(seed), "u", "v").alias("h"), "u", "v")
    flat = pairs.select(F.explode(F.array("u", "v")).alias("id"), order.alias("k"))
    first = flat.groupBy("id").agg(F.min("k").alias("k"))
    return first.groupBy("k").agg(F.count("*").alias("n")).where("n = 2").select("k.u", "k.v")


def contract(x: Shrunk, joined: DataFrame) -> Shrunk:
    """The graph with joined pairs as one node, named by the smallest."""
    comps = cut(connected_components(joined).select(F.col("node").alias("id"), F.col("comp").alias("to")))
    new = lambda df, c: df.join(comps.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    pairs = new(new(x.pairs, "u"), "v").where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("e").alias("e"))
    return Shrunk(cut(new(x.groups, "id")), cut(new(x.sizes, "id").groupBy("id").agg(F.sum("size").alias("size"))), cut(pairs))


def reduced(x: Shrunk, rounds: int = 100) -> tuple[Shrunk, Counter]:
    """Twins and heavy pairs joined until no rule applies, and how many pairs each rule joined.

    Twins are joined by classes. Of heavy pairs a round takes a matching: each of its pairs can be set
    apart without a loss, and setting one apart leaves the others alone.
    """
    counters: Counter = Counter()
    for k in range(rounds):
        found = cut(twin_pairs(x))
        if not found.isEmpty():
            counters["twins"] += found.count()
            x = contract(x, found)
            continue
        found = cut(matching(heavy_pairs(x), k))
        if found.isEmpty():
            break
        counters["heavy_pairs"] += found.count()
        x = contract(x, found)
    return x, counters


def solved_groups(x: Shrunk, most: int, nodes: int | None = None, seconds: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, proved) of components over positive weights of up to ``most`` nodes, and the (id) of larger ones.

    Weights that are not positive never join components, so nodes without a positive weight are alone.
    """
    w = cut(x.weighted())
    comps = cut(connected_components(w.where("s > 0").select("u", "v")))
    small = comps.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("comp")
    side = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
    rows = w.join(side("u"), "u").join(side("v"), "v").where("cu = cv").withColumnRenamed("cu", "comp").join(small, "comp", "left_semi").select("comp", "u", "v", "e", "su", "sv")

    def run(key, pdf):
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        ids, first = np.unique(np.concatenate([u, v]), return_index=True)
        size = np.concatenate([pdf["su"].to_numpy(), pdf["sv"].to_numpy()])[first]
        s = -np.multiply.outer(size, size)
        i, j = np.searchsorted(ids, u), np.searchsorted(ids, v)
        s[i, j] += 2 * pdf["e"].to_numpy()
        s[j, i] += 2 * pdf["e"].to_numpy()
        done = search.solve(Instance(s), nodes=nodes, seconds=seconds, seed=seed)
        label = np.zeros(len(ids), np.int64)
        for c in done.cliques:
            label[c] = ids[c].min()
        return pd.DataFrame({"id": ids, "cluster": label, "proved": done.worked or done.cost == done.lower})

    solved = spread(rows, "comp").groupBy("comp").applyInPandas(run, "id long, cluster long, proved boolean")
    alone = x.sizes.select("id").join(comps.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("id").alias("cluster"), F.lit(True).alias("proved"))
    return solved.unionByName(alone), comps.join(small, "comp", "left_anti").select(F.col("node").alias("id"))


def heuristic_assignment(edges: DataFrame, start: DataFrame | None = None, cycles: int = 1, rounds: int = 3, most: int | None = None) -> DataFrame:
    """(node, cluster) from ``start`` or from single nodes. Components of up to ``most`` edges are searched
    as adjacency lists, each in a group of its own; larger ones by moves of single nodes, then
    cycles of moves of sets, on tables."""
    e = cut(edges)
    comps = cut(connected_components(e))
    held = cut(e.join(comps.select(F.col("node").alias("u"), "comp"), "u"))
    fits = cut(held.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") <= (LIST_EDGES if most is None else most)).select("comp"))
    named = comps if start is None else comps.join(start, "node", "left")
    first = named.select("node", F.coalesce(*([] if start is None else ["cluster"]), "node").alias("cluster"))
    side = lambda end: first.select(F.col("node").alias(end), F.col("cluster").alias(f"c{end}"))

    def run(key, pdf):
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        ids, at = np.unique(np.concatenate([u, v]), return_index=True)
        label = sparse.improved(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v), np.concatenate([pdf["cu"].to_numpy(), pdf["cv"].to_numpy()])[at])
        named = np.full(len(ids), np.iinfo(np.int64).max)
        place = np.unique(label, return_inverse=True)[1].ravel()
        np.minimum.at(named, place, ids)
        return pd.DataFrame({"node": ids, "cluster": named[place]})

    done = cut(spread(held.join(fits, "comp", "left_semi").join(side("u"), "u").join(side("v"), "v"), "comp").groupBy("comp").applyInPandas(run, "node long, cluster long"))
    rest = cut(held.join(fits, "comp", "left_anti").select("u", "v"))
    if rest.isEmpty():
        return done
    inside = cut(first.join(ends(rest).withColumnRenamed("id", "node"), "node", "left_semi"))
    now, _ = moves.label_propagation(rest, inside, seed=1)
    return done.unionByName(setmoves.refine_sets(rest, now, cycles, rounds)[0])


def solve_tables(edges: DataFrame, most: int, nodes: int | None = None, seconds: float | None = None, seed: int = 1, start: DataFrame | None = None) -> tuple[DataFrame, Counter]:
    """(node, cluster, proved) for every node with an edge, and counters of what was frozen and joined.

    ``proved`` tells that the node's part was solved exactly; a component whose nodes all are has an
    optimal clustering. What is left of a component above ``most`` contracted nodes keeps the
    heuristic's clusters.
    """
    e = cut(edges)
    assign = cut(singletons(e) if start is None else start)
    assign = cut(heuristic_assignment(e, assign))
    frozen, rest, left = freeze(e, assign)
    x, counters = reduced(Shrunk.of(rest))
    counters["frozen"] = frozen.count()
    solved, large = solved_groups(x, most, nodes, seconds, seed)
    named = cut(x.groups.join(solved, "id").select("node", "cluster", "proved"))
    # names of clusters must not clash: a part's clusters are named by its smallest node
    named = setmoves.named_by_smallest(named.select("node", "cluster")).join(named.select("node", "proved"), "node")
    kept = setmoves.named_by_smallest(left.join(x.groups.join(large, "id", "left_semi").select("node"), "node", "left_semi")).withColumn("proved", F.lit(False))
    done = cut(setmoves.named_by_smallest(frozen.select("node", "cluster")).withColumn("proved", F.lit(True)).unionByName(named).unionByName(kept))
    alone = ends(e).select(F.col("id").alias("node")).join(done.select("node"), "node", "left_anti").select("node", F.col("node").alias("cluster"), F.lit(True).alias("proved"))
    return cut(done.unionByName(alone)), counters
