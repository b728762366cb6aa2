"""Moves of sets of nodes: dissolving, merging and splitting clusters, and swapping nodes.

A proposal moves some nodes at once; ``(prop, node, source, target)`` has a row for each of them. A
target that no cluster has, written ``-1 - node``, is a new cluster. What a proposal changes
depends on the clusters that it touches only: the sizes of these, and the edges of its moved
nodes. So its exact delta comes from joins with the arcs of the moved nodes, and proposals that
touch no cluster in common add up exactly. A round takes every proposal that gains and is first,
by delta, on all clusters it touches. Nothing here depends on the size of a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import moves
from knotwork.operators.cost import cluster_sizes, cluster_table
from knotwork.operators.graph import arcs
from knotwork.storage import cut


def touched_clusters(proposals: DataFrame) -> DataFrame:
    """(prop, cluster, gained): every cluster that a proposal touches, and by how many nodes it grows."""
    return proposals.select("prop", F.explode(F.array(F.struct(F.col("source").alias("cluster"), F.lit(-1).alias("d")), F.struct(F.col("target").alias("cluster"), F.lit(1).alias("d")))).alias("x")).groupBy("prop", "x.cluster").agg(F.sum("x.d").alias("gained"))


def proposal_deltas(edges: DataFrame, assign: DataFrame, proposals: DataFrame) -> DataFrame:
    """(prop, delta): the exact change of cost if all nodes of a proposal move.

    The cost is the edges plus, over the clusters, size * (size - 1) / 2 - 2 * edges inside. Arcs
    of moved nodes tell which edges come inside or leave; between two moved nodes both arcs do.
    """
    s, d = F.coalesce("size", F.lit(0)), F.col("gained")
    sizes = touched_clusters(proposals).join(cluster_sizes(assign), "cluster", "left").select("prop", (((s + d) * (s + d - 1) - s * (s - 1)) / 2).cast("long").alias("part"))
    other = proposals.select("prop", F.col("node").alias("dst"), F.col("target").alias("goes"))
    seen = (
        proposals.join(arcs(edges).withColumnRenamed("src", "node"), "node")
        .join(assign.select(F.col("node").alias("dst"), F.col("cluster").alias("is")), "dst").join(other, ["prop", "dst"], "left")
    )
    came = (F.col("target") == F.coalesce("goes", "is")).cast("long") - (F.col("source") == F.col("is")).cast("long")
    inside = seen.select("prop", (-came * F.when(F.col("goes").isNull(), 2).otherwise(1)).cast("long").alias("part"))
    return sizes.unionByName(inside).groupBy("prop").agg(F.sum("part").cast("long").alias("delta"))


def independent(deltas: DataFrame, touched: DataFrame, most: int = -1, seed: int = 0) -> DataFrame:
    """(prop, delta) of the proposals of at most ``most`` that are first on every cluster they touch."""
    order = F.struct("delta", F.xxhash64(F.lit(seed), "prop").alias("h"), "prop")
    able = touched.join(deltas.where(F.col("delta") <= most), "prop").select("prop", "cluster", "delta", order.alias("k"))
    first = able.groupBy("cluster").agg(F.min("k").alias("first"))
    return able.join(first, "cluster").groupBy("prop", "delta").agg(F.bool_and(F.col("k.prop") == F.col("first.prop")).alias("wins")).where("wins").select("prop", "delta")


def named_by_smallest(assign: DataFrame) -> DataFrame:
    """The assignment with every cluster named by its smallest node."""
    return assign.join(assign.groupBy("cluster").agg(F.min("node").alias("name")), "cluster").select("node", F.col("name").alias("cluster"))


def dissolve_proposals(edges: DataFrame, assign: DataFrame, seed: int = 0) -> DataFrame:
    """Every cluster of two and more nodes, with each of them in its best other cluster or alone."""
    best = moves.best_moves(edges, assign, stay=True)
    large = cluster_sizes(assign).where("size > 1").select(F.col("cluster").alias("source"))
    return best.join(large, "source", "left_semi").select(F.col("source").alias("prop"), "node", "source", F.coalesce("target", -1 - F.col("node")).alias("target"))


def merge_proposals(edges: DataFrame, assign: DataFrame, seed: int = 0) -> DataFrame:
    """Every cluster in the adjacent cluster that it best goes to as a whole; of two equal ones the smaller name."""
    side = lambda n, c: assign.select(F.col("node").alias(n), F.col("cluster").alias(c))
    between = arcs(edges).join(side("src", "source"), "src").join(side("dst", "target"), "dst").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("w"))
    sizes = cluster_sizes(assign)
    rated = between.join(sizes.select(F.col("cluster").alias("source"), F.col("size").alias("a")), "source").join(sizes.select(F.col("cluster").alias("target"), F.col("size").alias("b")), "target")
    best = rated.groupBy("source").agg(F.min_by("target", F.struct(F.col("a") * F.col("b") - 2 * F.col("w"), "target")).alias("target"))
    return assign.select("node", F.col("cluster").alias("source")).join(best, "source").select(F.col("source").alias("prop"), "node", "source", "target")


def split_proposals(edges: DataFrame, assign: DataFrame, seed: int = 0) -> DataFrame:
    """Every cluster of three and more nodes with a missing edge, cut in two around a non-adjacent pair.

    The first of the pair has the fewest neighbours inside, the second the most of those that are
    not adjacent to it; ``seed`` breaks ties. All others go where they have more of: the seed
    itself (two), and neighbours that are adjacent to that seed only. Ties stay with the first.
    """
    sizes = cluster_table(edges, assign).where("size > 2 and internal < size * (size - 1) / 2").select("cluster")
    part = assign.join(sizes, "cluster", "left_semi")
    side = lambda n: part.select(F.col("node").alias(n), F.col("cluster").alias(f"c{n}"))
    inner = cut(arcs(edges).join(side("src"), "src").join(side("dst"), "dst").where("csrc = cdst").select("src", "dst", F.col("csrc").alias("cluster")))
    inside = part.join(inner.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("w")), "node", "left").select("node", "cluster", F.coalesce("w", F.lit(0)).alias("w"))
    tie = F.xxhash64(F.lit(seed), "node") if seed else F.col("node")
    first = inside.groupBy("cluster").agg(F.min_by("node", F.struct("w", tie.alias("t"), "node")).alias("first"))
    mark = lambda ends, to: inner.select(F.col("src").alias(ends), F.col("dst").alias("node"), F.lit(1).alias(to))
    far = inside.join(first, "cluster").where("node <> first").join(mark("first", "n"), ["first", "node"], "left").where("n is null")
    second = far.groupBy("cluster").agg(F.min_by("node", F.struct(-F.col("w"), tie.alias("t"), "node")).alias("second"))
    # with the seeds' own neighbours first: 1 for the first's, -1 for the second's, 0 for both's or none's
    seeds = first.join(second, "cluster")
    near = inside.join(seeds, "cluster").join(mark("first", "x"), ["first", "node"], "left").join(mark("second", "y"), ["second", "node"], "left")
    lean = cut(near.select("cluster", "first", "second", "node", F.when(F.col("node") == F.col("first"), 2).when(F.col("node") == F.col("second"), -2).otherwise(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("lean")))
    pulled = inner.join(lean.select(F.col("node").alias("dst"), F.signum("lean").alias("pull")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("pull").alias("pull"))
    goes = (F.col("node") != F.col("first")) & ((F.col("node") == F.col("second")) | (F.coalesce("pull", F.lit(0)) + F.col("lean") < 0))
    return lean.join(pulled, "node", "left").where(goes).select(F.col("cluster").alias("prop"), "node", F.col("cluster").alias("source"), (-1 - F.col("second")).alias("target"))


def swap_proposals(edges: DataFrame, assign: DataFrame, seed: int = 0, most: int = 32) -> DataFrame:
    """For every cluster of at most ``most`` nodes the node that best enters it, though that may cost,
    with every member that then does not lose by going to its best other cluster or alone.

    Candidates are tried in order of cost and, with a ``seed``, of a hash of the node.
    """
    small = cluster_sizes(assign).where(F.col("size") <= most).select(F.col("cluster").alias("target"))
    tie = F.xxhash64(F.lit(seed), "node") if seed else F.col("node")
    enters = moves.best_moves(edges, assign, isolate=False, stay=True).join(small, "target", "left_semi")
    first = enters.groupBy("target").agg(F.min_by(F.struct("node", "source"), F.struct("delta", tie.alias("t"), "node")).alias("x")).select("target", F.col("x.node").alias("prop"), F.col("x.source").alias("from"))
    linked = arcs(edges).select(F.col("src").alias("prop"), F.col("dst").alias("node"), F.lit(1).alias("adjacent"))
    inside = moves.best_moves(edges, assign, stay=True).select("node", F.col("source").alias("at"), F.col("target").alias("to"), "delta")
    held = inside.join(first, F.col("at") == F.col("target")).join(linked, ["prop", "node"], "left")
    # the newcomer makes the cluster one larger, and the cluster that it left one smaller
    worse = 1 - 2 * F.coalesce("adjacent", F.lit(0))
    after = F.col("delta") - worse - F.when(F.col("to") == F.col("from"), worse).otherwise(F.lit(0))
    leaves = held.where(after <= 0).select("prop", "node", F.col("at").alias("source"), F.coalesce("to", -1 - F.col("node")).alias("target"))
    return first.select("prop", F.col("prop").alias("node"), F.col("from").alias("source"), "target").unionByName(leaves)


KINDS: dict[str, Callable[..., DataFrame]] = {"merge": merge_proposals, "dissolve": dissolve_proposals, "split": split_proposals, "swap": swap_proposals}


def set_round(edges: DataFrame, assign: DataFrame, kind: str, seed: int = 0, sideways: bool = False) -> tuple[DataFrame, int, int]:
    """One round of proposals of a kind: the new assignment, the proposals taken, the sum of their deltas.

    ``sideways`` also takes proposals that change nothing, as a way out of plateaus.
    """
    proposed = cut(KINDS[kind](edges, assign, seed))
    taken = cut(independent(proposal_deltas(edges, assign, proposed), touched_clusters(proposed).select("prop", "cluster"), 0 if sideways else -1, seed))
    n, delta = taken.agg(F.count("*"), F.coalesce(F.sum("delta"), F.lit(0))).first()
    if not n:
        return assign, 0, 0
    goes = proposed.join(taken.select("prop"), "prop", "left_semi").select("node", F.col("target").alias("to"))
    # new clusters have negative names that nothing else has
    moved = assign.join(goes, "node", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))
    return cut(named_by_smallest(moved)), int(n), int(delta)


def refine_sets(edges: DataFrame, assign: DataFrame, cycles: int | None = 10, rounds: int | None = 20, seed: int = 0, kinds: tuple[str, ...] = tuple(KINDS)) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Rounds of all kinds, each until it gains no more, with moves of single nodes in between.

    Returns the assignment and (step, gain) of every step that gained; ends when a whole cycle does not.
    ``cycles`` and ``rounds`` of a kind in a cycle may be None, for no limit: every step gains, so it ends.
    """
    e, now, history = cut(edges), cut(named_by_smallest(assign)), []
    for cycle in itertools.count() if cycles is None else range(cycles):
        before = len(history)
        for kind in kinds:
            gained = False
            for k in itertools.count() if rounds is None else range(rounds):
                now, n, delta = set_round(e, now, kind, seed + cycle * (rounds or 0) + k)
                if not n:
                    break
                history.append((kind, -delta))
                gained = True
            while gained:
                now, n, delta = moves.round_of_moves(e, now, len(history))
                if not n:
                    break
                history.append(("move", -delta))
            now = cut(named_by_smallest(now)) if gained else now
        if len(history) == before:
            break
    return now, history
