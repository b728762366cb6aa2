"""Connected components by local contraction and alternating star contractions.

First every partition replaces its edges by a spanning forest of stars, so at most one edge
for each of its nodes goes on. A forest of at most ``ONE_TASK`` edges, which is a few dozen
megabytes whatever the input, is finished by one task in the same way. A larger one goes through
rounds of stars: each is two aggregations with map-side combine, so a hub costs one partial
minimum per map task and never a collected neighbour list. The number of rounds grows with the
logarithm of the component size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.skew import lookup
from knotwork.storage import cut


#: Edges that one task contracts at once.
ONE_TASK = 1 << 20


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest node, node) of the components of some edges."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    up = np.arange(len(ids))
    while True:
        # each root takes the smallest root across its edges, then paths are halved to the end
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(up, high[open_], low[open_])
        while True:
            over = up[up]
            if np.array_equal(over, up):
                break
            up = over
    moved = up != np.arange(len(ids))
    return ids[up[moved]], ids[moved]


def _contract_partitions(e: DataFrame, block: int | None = None) -> DataFrame:
    """A forest for each partition; complete if the partition has at most ``block`` edges."""
    block = block or ONE_TASK

    def run(batches):
        u, v, held = [], [], 0
        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > block:
                p, q = local_forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [p], [q], 0
                if len(p) > block // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["u", "v"])
                    u, v = [], []
        if u:
            p, q = local_forest(np.concatenate(u), np.concatenate(v))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["u", "v"])

    return e.mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame, many: int, most: int) -> DataFrame:
    """For every node, link its larger neighbours to the smallest node around it."""
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        e.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    joined = lookup(both.where("b > a"), low, ["a"], "n", 2 * many, most)
    return joined.select(F.col("m").alias("u"), F.col("b").alias("v")).where("u < v").distinct()


def _small_star(e: DataFrame, many: int, most: int) -> DataFrame:
    """For every node, link it and its smaller neighbours to the smallest of them."""
    low = e.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    joined = lookup(e, low, ["v"], "n", 2 * many, most)
    return (
        joined.select(F.col("m").alias("u"), F.col("u").alias("v"))
        .unionByName(low.select(F.col("m").alias("u"), "v"))
        .where("u < v")
        .distinct()
    )


def _state(e: DataFrame) -> tuple[bool, int, int]:
    """Whether every node hangs on exactly one other, which hangs on none; the edges, and the
    most edges of a node."""
    seen = e.select(F.col("v").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        e.select(F.col("u").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    each = seen.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"), F.count("*").alias("degree"))
    open_, many, most = each.agg(F.bool_or((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))), F.sum("hangs"), F.max("degree")).first()
    return not open_, many or 0, most or 0


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges(u, v)`` to ``(node, comp)`` with comp the smallest node of the component.

    Only nodes with an edge appear. Self loops and repeated edges are ignored, null
    ends too; no edges give no rows. Converged when every node hangs on exactly one
    root and no root hangs on another node; raises if that takes more than ``max_rounds``.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")
    )
    e = cut(_contract_partitions(e).distinct())
    if e.count() <= ONE_TASK:
        e = cut(_contract_partitions(e.coalesce(1)))
        return _labels(e)
    for _ in range(max_rounds + 1):
        done, many, most = _state(e)
        if done:
            break
        e = cut(_small_star(_large_star(e, many, most), 2 * many, 2 * many))
    else:
        raise RuntimeError(f"components have not converged after {max_rounds} rounds")
    return _labels(e)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(
        stars.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct()
    )


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)`` with every node labelled, isolated ones by themselves: ``(node, comp)``."""
    comp = connected_components(edges)
    return nodes.join(comp, nodes["id"] == comp["node"], "left").select(
        F.col("id").alias("node"), F.coalesce("comp", "id").alias("comp")
    )
