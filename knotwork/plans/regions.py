"""Evolution of large components in regions, side by side.

A region is a set of whole clusters around a seed cluster. If the nodes of a region move among its own
clusters and new ones only, the cost changes by exactly what it changes inside: edges that leave the
region stay cut. Regions share no cluster, so their changes add up, and each is a group of bounded
size that a kernel mutates and repairs like a small component. Seeds are drawn by a hash, so a round is
the same for any partitioning, and the next round draws other regions.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.cost import classified, cluster_sizes
from knotwork.operators.setmoves import named_by_smallest
from knotwork.plans import refine
from knotwork.plans.evolve import localized_step
from knotwork.plans.instance import Instance
from knotwork.plans.refine import State
from knotwork.sources.config import Settings
from knotwork.storage import cut

#: Nodes that a region aims at.
NODES = 300


def cluster_graph(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(a, b): adjacent clusters, both ways."""
    c = classified(edges, assign).where("cu <> cv").select("cu", "cv").distinct()
    return c.select(F.col("cu").alias("a"), F.col("cv").alias("b")).unionByName(c.select(F.col("cv").alias("a"), F.col("cu").alias("b"))).distinct()


def draw_regions(edges: DataFrame, assign: DataFrame, hops: int = 2, nodes: int = NODES, seed: int = 0) -> DataFrame:
    """(cluster, region): disjoint sets of clusters of about ``nodes`` nodes at most.

    One cluster in about ``nodes / 4`` nodes' worth is a seed, by a hash. Clusters join the first
    region, by the hash, that reaches them, hop by hop. A region that would be too large
    keeps a share of what joins, by the hash again, so its size is bounded though a hub may have
    any number of neighbours. Clusters that no seed reaches, as in most small components, then make
    regions of their own around those that come first, by the hash, among their neighbours. Clusters
    above ``nodes`` nodes belong to no region.
    """
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = cut(cluster_sizes(assign).where(F.col("size") <= nodes))
    near = cut(cluster_graph(edges, assign))

    def spread(held: DataFrame, free: DataFrame) -> DataFrame:
        for hop in range(hops):
            reach = held.select(F.col("cluster").alias("a"), "region").join(near, "a").groupBy(F.col("b").alias("cluster")).agg(F.min_by("region", F.struct(h(F.col("region")), "region")).alias("region"))
            new = cut(reach.join(held.select("cluster"), "cluster", "left_anti").join(free, "cluster").select("cluster", "region", "size"))
            room = held.groupBy("region").agg((F.lit(nodes) - F.sum("size")).alias("room"))
            wanted = new.groupBy("region").agg(F.sum("size").alias("wanted"))
            rate = room.join(wanted, "region").select("region", (F.col("room") / F.col("wanted")).alias("rate"))
            fits = new.join(rate, "region").where(h(F.lit(hop), F.col("cluster")) < F.col("rate")).select("cluster", "region", "size")
            held = cut(held.unionByName(fits))
        return held

    share = F.greatest(F.col("size") / F.lit(nodes / 4), F.lit(1e-9))
    held = spread(cut(sizes.where(h(F.col("cluster")) < share).select("cluster", F.col("cluster").alias("region"), "size")), sizes)
    free = cut(sizes.join(held.select("cluster"), "cluster", "left_anti"))
    key = lambda c: F.struct(h(F.col(c)).alias("h"), F.col(c).alias("c"))
    beside = near.join(free.select(F.col("cluster").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("cluster")).agg(F.min(key("a")).alias("first"))
    seeds = free.join(beside, "cluster", "left").where(F.col("first").isNull() | (key("cluster") < F.col("first")))
    return held.unionByName(spread(cut(seeds.select("cluster", F.col("cluster").alias("region"), "size")), free)).select("cluster", "region")


def region_round(edges: DataFrame, assign: DataFrame, steps: int = 200, seed: int = 0, hops: int = 2, nodes: int = NODES, settings: Settings | None = None) -> tuple[DataFrame, int, int]:
    """One round: the new assignment, the regions that gained, and the sum of their changes of cost.

    In a region, a pass of FM is followed by ``steps`` mutations of a few nodes, each repaired around
    them and kept if it does not cost.
    """
    cfg = settings or Settings()
    regions = cut(draw_regions(edges, assign, hops, nodes, seed))
    inside = cut(assign.join(regions, "cluster"))
    side = lambda end: inside.select(F.col("node").alias(end), F.col("cluster").alias(f"c{end}"), F.col("region").alias(f"r{end}"))
    rows = edges.join(side("u"), "u").join(side("v"), "v").where("ru = rv").select(F.col("ru").alias("region"), "u", "v", "cu", "cv")
    # a pair of a node with itself brings nodes without an edge inside
    rows = rows.unionByName(inside.select("region", F.col("node").alias("u"), F.col("node").alias("v"), F.col("cluster").alias("cu"), F.col("cluster").alias("cv")))

    def run(key, pdf):
        pdf = pdf.sort_values(["u", "v"])
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        ids, first = np.unique(np.concatenate([u, v]), return_index=True)
        start = np.concatenate([pdf["cu"].to_numpy(), pdf["cv"].to_numpy()])[first]
        x = Instance.from_edges(len(ids), zip(np.searchsorted(ids, u[u != v]), np.searchsorted(ids, v[u != v])))
        rng = random.Random(int(key[0]) * 7919 + seed)
        st = State(x, start)
        before = st.cost()
        if before == 0:
            return pd.DataFrame({"region": [], "node": [], "cluster": [], "delta": []}, dtype="int64")
        refine.boundary_fm(st, rng, least=len(ids), passes=2)
        for _ in range(steps):
            localized_step(st, cfg, rng)
        change = st.cost() - before
        if change >= 0:
            return pd.DataFrame({"region": [], "node": [], "cluster": [], "delta": []}, dtype="int64")
        # negative names are new, and no two regions share a node
        named = np.zeros(len(ids), np.int64)
        for c in np.unique(st.label):
            named[st.label == c] = -1 - ids[st.label == c].min()
        return pd.DataFrame({"region": int(key[0]), "node": ids, "cluster": named, "delta": change})

    found = cut(rows.groupBy("region").applyInPandas(run, "region long, node long, cluster long, delta long"))
    n, delta = found.groupBy("region").agg(F.first("delta").alias("delta")).agg(F.count("*"), F.coalesce(F.sum("delta"), F.lit(0))).first()
    if not n:
        return assign, 0, 0
    goes = found.select("node", F.col("cluster").alias("to"))
    moved = assign.join(goes, "node", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))
    return cut(named_by_smallest(moved)), int(n), int(delta)


def evolve_regions(edges: DataFrame, assign: DataFrame, rounds: int = 10, fruitless: int = 3, **options) -> tuple[DataFrame, list[int]]:
    """Rounds with other regions each time, until ``fruitless`` of them in a row gain nothing, and their gains."""
    e, now, gains, idle = cut(edges), cut(named_by_smallest(assign)), [], 0
    for k in range(rounds):
        now, _, delta = region_round(e, now, seed=k, **options)
        gains.append(-delta)
        idle = 0 if delta else idle + 1
        if idle >= fruitless:
            break
    return now, gains
