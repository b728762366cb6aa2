"""Cost of a clustering assign(node, cluster): edits, edit list, statistics, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.quartiles import statistics
from knotwork.operators.graph import ends
from knotwork.operators.strips import apart


def singletons(edges: DataFrame) -> DataFrame:
    """Every node in a cluster of its own."""
    return ends(edges).select(F.col("id").alias("node"), F.col("id").alias("cluster"))


def classified(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(u, v, cu, cv): edges with their ends' clusters."""
    side = lambda n, c: assign.select(F.col("node").alias(n), F.col("cluster").alias(c))
    return edges.join(side("u", "cu"), "u").join(side("v", "cv"), "v").select("u", "v", "cu", "cv")


def cluster_sizes(assign: DataFrame) -> DataFrame:
    """(cluster, size)."""
    return assign.groupBy("cluster").agg(F.count("*").alias("size"))


def empty_clusters(assign: DataFrame) -> DataFrame:
    """(cluster): node ids that no cluster uses, free to be allocated."""
    return assign.select(F.col("node").alias("cluster")).join(assign.select("cluster"), "cluster", "left_anti")


def members(assign: DataFrame) -> DataFrame:
    """(cluster, members) with sorted members."""
    return assign.groupBy("cluster").agg(F.sort_array(F.collect_list("node")).alias("members"))


def cluster_table(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, size, internal, external): edges inside, and edges that leave, seen from each side."""
    c = classified(edges, assign)
    inside = c.where("cu = cv").groupBy(F.col("cu").alias("cluster")).agg(F.count("*").alias("internal"))
    out = c.where("cu <> cv").select(F.explode(F.array("cu", "cv")).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("external"))
    return (
        cluster_sizes(assign).join(inside, "cluster", "left").join(out, "cluster", "left")
        .select("cluster", "size", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external"))
    )


def objectives(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row: clusters, insertions, deletions, edits."""
    t = cluster_table(edges, assign)
    return t.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum(F.col("size") * (F.col("size") - 1) / 2 - F.col("internal")), F.lit(0)).cast("long").alias("insertions"),
        F.coalesce(F.sum("external") / 2, F.lit(0)).cast("long").alias("deletions"),
    ).withColumn("edits", F.col("insertions") + F.col("deletions"))


def put_together_cost(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, cost): missing inside and leaving edges of each cluster."""
    return cluster_table(edges, assign).select("cluster", (F.col("size") * (F.col("size") - 1) / 2 - F.col("internal") + F.col("external")).cast("long").alias("cost"))


def edit_list(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(u, v, op): edges to delete and pairs to insert, each unordered pair once.

    Pairs to insert are the output itself; they are written strip by strip, only for clusters that
    miss an edge.
    """
    gone = classified(edges, assign).where("cu <> cv").select("u", "v", F.lit("delete").alias("op"))
    loose = cluster_table(edges, assign).where("internal < size * (size - 1) / 2").select("cluster")
    part = assign.join(loose, "cluster", "left_semi")
    return gone.unionByName(apart(edges, part).select("u", "v", F.lit("insert").alias("op")))


def is_cluster_graph(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, is_clique) for comps(node, comp): all pairs of the component are edges."""
    return cluster_table(edges, comps.withColumnRenamed("comp", "cluster")).select(F.col("cluster").alias("comp"), (F.col("internal") == (F.col("size") * (F.col("size") - 1) / 2).cast("long")).alias("is_clique"))


def weighted_cost(pairs: DataFrame, assign: DataFrame) -> DataFrame:
    """One row with the cost of a clustering on ``pairs(u, v, s)``: |s| where togetherness contradicts the sign."""
    c = classified(pairs, assign).join(pairs, ["u", "v"])
    wrong = ((F.col("cu") == F.col("cv")) & (F.col("s") < 0)) | ((F.col("cu") != F.col("cv")) & (F.col("s") > 0))
    return c.agg(F.coalesce(F.sum(F.when(wrong, F.abs("s"))), F.lit(0)).cast("long").alias("cost"))


def cluster_statistics(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row of seven numbers each for sizes, internal and external edges of the clusters."""
    t = cluster_table(edges, assign)
    out = statistics(t, "size", "size")
    for c in ("internal", "external"):
        out = out.join(statistics(t, c, c))
    return out


def special_instance(edges: DataFrame, assign: DataFrame, least: int = 1_000_000) -> DataFrame:
    """One row: ``special``, true for very large sparse graphs whose clusters are tiny.

    Degree below 20, more than ``least`` edges, and cluster sizes of at most 2 at the upper
    quartile, 4 at the last percentile and 6 at most.
    """
    from knotwork.operators.graph import degrees

    top = degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("d"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).alias("m"))
    sizes = cluster_sizes(assign).agg(F.coalesce(F.max("size"), F.lit(0)).alias("x"), F.expr("percentile_disc(0.75) within group (order by size)").alias("q"), F.expr("percentile_disc(0.99) within group (order by size)").alias("p"))
    return top.join(sizes).select(((F.col("d") < 20) & (F.col("m") > least) & (F.col("q") <= 2) & (F.col("p") <= 4) & (F.col("x") <= 6)).alias("special"))


def verify(edges: DataFrame, nodes: DataFrame, assign: DataFrame, claimed: int | None = None) -> DataFrame:
    """One row: nodes without and with several clusters, the cost, and whether all is well."""
    held = nodes.join(assign.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    cover = held.agg(F.count_if(F.col("n").isNull()).alias("uncovered"), F.count_if(F.col("n") > 1).alias("overlapping"))
    out = cover.join(objectives(edges, assign).select("edits"))
    good = (F.col("uncovered") == 0) & (F.col("overlapping") == 0)
    return out.withColumn("ok", good if claimed is None else good & (F.col("edits") == claimed))
