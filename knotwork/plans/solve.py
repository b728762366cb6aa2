"""Spark plans of the solvers.

The cost separates over connected components, so a component is the unit of parallel work:
components are labelled, their edges meet by component, and a kernel solves each. Components
above ``KERNEL_NODES`` are handled on tables, whatever their size: moves of nodes and of sets of
nodes, certificates of clusters and reductions, until kernels can take what is left. Heuristic replicas are rows too: every component takes its own best one.
"""

from __future__ import annotations

import logging
import random
import time
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import cost, moves
from knotwork.operators.components import connected_components
from knotwork.operators.graph import degrees, ends
from knotwork.operators.measure import p3_packing
from knotwork.plans import bounds, clock, refine, search, shrink
from knotwork.plans.evolve import portfolio
from knotwork.plans.instance import Instance
from knotwork.sources.config import Settings
from knotwork.storage import cut, spread

log = logging.getLogger("knotwork")

#: Largest component that a kernel takes: a dense matrix of that many nodes.
KERNEL_NODES = 600


def component_edges(edges: DataFrame, comps: DataFrame, most: int = KERNEL_NODES, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(comp, u, v) of components up to ``most`` nodes, and the (comp) of larger ones.

    With ``start(node, cluster)`` also the clusters ``su`` and ``sv`` of the ends; a node that it
    leaves out starts alone.
    """
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    with_comp, cols = edges.join(comps.select(F.col("node").alias("u"), "comp"), "u"), ["comp", "u", "v"]
    if start is not None:
        for end in "uv":
            own = start.select(F.col("node").alias(end), F.col("cluster").alias(f"s{end}"))
            # clusters are told apart from nodes that are alone by their sign
            with_comp = with_comp.join(own, end, "left").withColumn(f"s{end}", F.coalesce(f"s{end}", -1 - F.col(end)))
        cols += ["su", "sv"]
    return with_comp.join(sizes.where(F.col("n") <= most).select("comp"), "comp", "left_semi").select(*cols), sizes.where(F.col("n") > most).select("comp")


def local_instance(pdf: pd.DataFrame) -> tuple[Instance, np.ndarray]:
    """Unit instance of a component's edges, and the ids of its nodes."""
    u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
    ids = np.unique(np.concatenate([u, v]))
    return Instance.from_edges(len(ids), zip(np.searchsorted(ids, u), np.searchsorted(ids, v))), ids


_RESULT = "comp long, node long, cluster long, cost long, lower long, proved boolean, counters string"


def _rows(comp: int, ids: np.ndarray, label: np.ndarray, value: int, lower: int, proved: bool, counters: str) -> pd.DataFrame:
    place = np.unique(label, return_inverse=True)[1].ravel()
    named = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(named, place, ids)
    named = named[place]
    return pd.DataFrame({"comp": comp, "node": ids, "cluster": named, "cost": value, "lower": lower, "proved": proved, "counters": counters})


def exact(edges: DataFrame, nodes_limit: int | None = None, seconds: float | None = None, seed: int = 1, most: int = KERNEL_NODES, table: int | None = None) -> DataFrame:
    """(comp, node, cluster, cost, lower, proved, counters): an optimal clustering of every component.

    Every component of up to ``most`` nodes is searched until it is proved, or for ``nodes_limit``
    search nodes and ``seconds``, if given. One whose effort runs out has the better of the
    search's and the portfolio's clustering and a lower bound, and is proved only if both agree.
    Larger components, and with ``most`` 0 all of them, are frozen and reduced on tables first, and
    only what is left goes to kernels; one that stays too large keeps its best clustering, unproved
    unless a packing bound meets it. Only nodes with an edge appear.
    """
    e = cut(edges)
    comps = cut(connected_components(e))
    small, large = component_edges(e, comps, most)

    def run(key, pdf):
        x, ids = local_instance(pdf)
        s = search.solve(x, nodes=nodes_limit, seconds=None if seconds is None else 0.7 * seconds, seed=seed, table=table)
        label, value, lower, proved = np.zeros(len(ids), int), s.cost, s.lower, s.worked
        for k, c in enumerate(s.cliques):
            label[c] = k
        if not proved:
            rest = None if seconds is None else 0.3 * seconds
            with clock.deadline(rest):
                lower = max(lower, bounds.lower_bound(x, seed=seed))
                found, cost_, _ = portfolio(x, Settings(first_tries=4, evo_steps=60, local_steps=1200), seed, None if rest is None else time.monotonic() + rest, label, lower)
            if cost_ < value:
                label, value = found, cost_
            proved = lower == value
        counters = ",".join(f"{k}={v}" for k, v in sorted(s.counters.items()))
        return _rows(int(key[0]), ids, label, value, lower, proved, counters)

    proving = {"most": KERNEL_NODES if most == 0 else most, "nodes": nodes_limit, "seconds": seconds, "seed": seed}
    return spread(small, "comp").groupBy("comp").applyInPandas(run, _RESULT).unionByName(_large(e, comps, large, proving=proving))


def _large(edges: DataFrame, comps: DataFrame, large: DataFrame, start: DataFrame | None = None, proving: dict | None = None) -> DataFrame:
    """Components beyond the kernels: moves of nodes and of sets on tables, and a packing bound.

    With ``proving`` (options of ``shrink.solve_tables``) also certificates and reductions; a component
    that they solve altogether is proved.
    """
    empty = comps.limit(0).select("comp", "node", F.col("node").alias("cluster"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("lower"), F.lit(False).alias("proved"), F.lit("").alias("counters"))
    if large.limit(1).count() == 0:
        return empty
    inside = cut(comps.join(large, "comp", "left_semi"))
    part = cut(edges.join(inside.select(F.col("node").alias("u"), "comp"), "u").select("u", "v", "comp"))
    flat = part.select("u", "v")
    first = None if start is None else cut(inside.join(start, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster")))
    if proving is None:
        assign, counters = cut(shrink.heuristic_assignment(flat, first)).withColumn("proved", F.lit(False)), "set_moves"
    else:
        assign, found = shrink.solve_tables(flat, start=first, **proving)
        counters = ",".join(f"{k}={v}" for k, v in sorted(found.items()))
    held = inside.join(assign, "node")
    table = cost.cluster_table(flat, assign.select("node", "cluster")).join(held.groupBy("cluster").agg(F.min("comp").alias("comp")), "cluster")
    value = table.groupBy("comp").agg(F.sum(F.col("size") * (F.col("size") - 1) / 2 - F.col("internal") + F.col("external") / 2).cast("long").alias("cost"))
    packed = p3_packing(flat).join(comps.select(F.col("node").alias("center"), "comp"), "center").groupBy("comp").agg(F.count("*").alias("bound"))
    exactly = held.groupBy("comp").agg(F.bool_and("proved").alias("all"))
    bound = F.when(F.col("all"), F.col("cost")).otherwise(F.coalesce("bound", F.lit(0))).cast("long")
    both = value.join(exactly, "comp").join(packed, "comp", "left").select("comp", "cost", bound.alias("lower"))
    return held.select("node", "cluster", "comp").join(both, "comp").select("comp", "node", "cluster", "cost", "lower", (F.col("cost") == F.col("lower")).alias("proved"), F.lit(counters).alias("counters"))


def lower_bounds(edges: DataFrame, most: int = KERNEL_NODES) -> DataFrame:
    """(comp, p3, star, bipartite): packing bounds of every component.

    A component that no kernel takes has the distributed packing of triples as all three.
    """
    e = cut(edges)
    comps = cut(connected_components(e))
    small, large = component_edges(e, comps, most)

    def run(key, pdf):
        x, _ = local_instance(pdf)
        return pd.DataFrame({"comp": [key[0]], "p3": [bounds.p3_packing(x).value], "star": [bounds.star_packing(x).value], "bipartite": [bounds.bipartite_bound(x)]})

    out = spread(small, "comp").groupBy("comp").applyInPandas(run, "comp long, p3 long, star long, bipartite long")
    if large.limit(1).count() == 0:
        return out
    inside = comps.join(large, "comp", "left_semi")
    held = p3_packing(cut(e.join(inside.select(F.col("node").alias("u")), "u"))).join(inside.select(F.col("node").alias("center"), "comp"), "center").groupBy("comp").agg(F.count("*").alias("p3"))
    return out.unionByName(large.join(held, "comp", "left").select("comp", *(F.coalesce("p3", F.lit(0)).alias(c) for c in ("p3", "star", "bipartite"))))


def _replicated(edges: DataFrame, replicas: int, kernel, most: int, start: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Run ``kernel(instance, seed, label) -> (label, cost, lower)`` on every component and replica,
    numbered from ``first``; keep the best of each component. ``label`` is that of ``start`` or None."""
    e = cut(edges)
    comps = cut(connected_components(e))
    small, large = component_edges(e, comps, most, start)
    started = start is not None

    def run(key, pdf):
        x, ids = local_instance(pdf)
        given = None
        if started:
            given = np.zeros(len(ids), np.int64)
            for end in "uv":
                given[np.searchsorted(ids, pdf[end].to_numpy())] = pdf[f"s{end}"].to_numpy()
        label, value, lower = kernel(x, int(key[0]) * 1009 + int(key[1]), given)
        return _rows(int(key[0]), ids, label, value, lower, value == lower, "").assign(replica=int(key[1]))

    rows = cut(spread(small.withColumn("replica", F.explode(F.sequence(F.lit(first), F.lit(first + replicas - 1)))), "comp", "replica").groupBy("comp", "replica").applyInPandas(run, _RESULT + ", replica int"))
    best = rows.groupBy("comp").agg(F.min_by("replica", F.struct("cost", "replica")).alias("replica"))
    return rows.join(best, ["comp", "replica"], "left_semi").drop("replica").unionByName(_large(e, comps, large, start))


def configured(edges: DataFrame, settings: Settings) -> Settings:
    """Settings for the whole graph: its size decides on steps, and aggregates on whether it is special.

    A special instance is very large and sparse, and label propagation leaves only tiny clusters.
    """
    n, m = ends(edges).count(), edges.count()
    cfg = settings.for_size(n, m)
    if cfg.special is None:
        top = degrees(edges).agg(F.max("degree")).first()[0] if m > cfg.special_edges else None
        cfg.special = top is not None and top < 20 and bool(cost.special_instance(edges, cut(moves.label_propagation(edges, seed=1)[0]), cfg.special_edges).first()["special"])
    return cfg


def heuristic(edges: DataFrame, settings: Settings | None = None, replicas: int = 2, most: int = KERNEL_NODES, start: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Portfolio of evolutions on every component; the columns of ``exact``.

    Every replica obeys the settings' steps and seconds, and ends at once where its cost meets
    the component's packing bound. It starts from ``start(node, cluster)`` if given.
    """
    edges = cut(edges)
    cfg = configured(edges, settings or Settings())
    tasks, many = edges.sparkSession.sparkContext.defaultParallelism, max(1, edges.count())

    def kernel(x: Instance, seed: int, label):
        # without a number of steps to end it, a component has its share of the time
        share = 1.0 if cfg.evo_steps < 2**62 else min(1.0, tasks * int((x.s > 0).sum() // 2) / many)
        lower = bounds.lower_bound(x)
        if not (cfg.use_evolution or cfg.use_localized):
            st = refine.State(x, label)
            rng = random.Random(cfg.seed + seed)
            if cfg.use_lp:
                refine.label_propagation(st, cfg.lp_rounds, rng, "random" if cfg.lp_shuffle else cfg.lp_order, cfg.lp_window, cfg.lp_least)
            if cfg.use_boundary_fm:
                refine.boundary_fm(st, rng, cfg.fm_fruitless, passes=cfg.fm_rounds, window=cfg.fm_window, gain=cfg.fm_least)
            if cfg.use_localized_fm:
                refine.localized_fm(st, rng, cfg.fm_seeds)
            return st.label, st.cost(), lower
        label, value, _ = portfolio(x, cfg, cfg.seed + seed, time.monotonic() + share * cfg.seconds, label, lower)
        return label, value, lower

    return _replicated(edges, replicas, kernel, most, start, first)


def restarts(edges: DataFrame, settings: Settings, most: int = KERNEL_NODES, start: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """The best of repeated runs of ``heuristic`` for every component, and the cost after each restart.

    ``at_once`` restarts run side by side. It ends after ``repetitions`` of them, after
    ``fruitless`` ones without a gain, after ``seconds``, or when every component is proved.
    """
    e, best, costs, done, idle, until = cut(edges), None, [], 0, 0, time.monotonic() + settings.seconds
    while done < max(1, settings.repetitions):
        now = min(settings.at_once, max(1, settings.repetitions) - done)
        cfg = replace(settings, seconds=max(0.0, until - time.monotonic()))
        got = cut(heuristic(e, cfg, now, most, start, done))
        if best is not None:
            both = best.withColumn("old", F.lit(0)).unionByName(got.withColumn("old", F.lit(1)))
            better = both.groupBy("comp").agg(F.min_by("old", F.struct("cost", "old")).alias("old"))
            got = cut(both.join(better, ["comp", "old"], "left_semi").drop("old"))
        best, done = got, done + now
        total, open_ = best.groupBy("comp").agg(F.first("cost").alias("cost"), F.first("proved").alias("proved")).agg(F.coalesce(F.sum("cost"), F.lit(0)), F.count_if(~F.col("proved"))).first()
        idle = 0 if not costs or total < costs[-1] else idle + now
        costs.append(int(total))
        log.info("restart %d of %d: %d edits, %d components open", done, settings.repetitions, total, open_)
        if idle >= settings.fruitless or not open_ or time.monotonic() > until:
            break
    return best, costs


def refined(edges: DataFrame, step: str, seed: int = 0) -> DataFrame:
    """One refiner after label propagation: boundary_fm, localized_fm, remove_clusters, split_clusters or swap_nodes.

    Every component, whatever its size, is a group that works on adjacency lists, so the same is done
    for all; the columns of ``exact``.
    """
    refiner = {f.__name__: f for f in (refine.boundary_fm, refine.localized_fm, refine.remove_clusters, refine.split_clusters, refine.swap_nodes)}[step]
    e = cut(edges)
    comps = cut(connected_components(e))

    def run(key, pdf):
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        ids = np.unique(np.concatenate([u, v]))
        rng = random.Random(int(key[0]) * 1009 + seed)
        st = refine.Lists(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))
        refine.label_propagation(st, 100, rng)
        refiner(st, rng)
        return _rows(int(key[0]), ids, st.label, st.cost(), 0, st.cost() == 0, "")

    return spread(e.join(comps.select(F.col("node").alias("u"), "comp"), "u").select("comp", "u", "v"), "comp").groupBy("comp").applyInPandas(run, _RESULT)


class Clusterer:
    """A graph and what can be asked of it: ``Clusterer(edges).exact()``, ``.heuristic()``, ``.edits(result)``."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges, self.nodes = cut(edges), nodes

    def exact(self, **options) -> DataFrame:
        return exact(self.edges, **options)

    def heuristic(self, **options) -> DataFrame:
        return heuristic(self.edges, **options)

    def restarts(self, settings: Settings, **options) -> DataFrame:
        return restarts(self.edges, settings, **options)[0]

    def assignment(self, result: DataFrame) -> DataFrame:
        """assign(node, cluster), with isolated nodes of the graph by themselves."""
        own = result.select("node", "cluster")
        if self.nodes is None:
            return own
        return self.nodes.select(F.col("id").alias("node")).join(own, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))

    def edits(self, result: DataFrame) -> DataFrame:
        """(u, v, op) of the clustering."""
        return cost.edit_list(self.edges, cut(result.select("node", "cluster")))
