"""A stream of edges as Structured Streaming: running degrees, and edges ready for a solver.

The solvers read a graph to its end. A graph that arrives in files can still be measured as
it comes, and each batch can be folded into a table that the solvers read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, path: str, delay: str | None = None) -> DataFrame:
    """edges(u, v), normalised and distinct, from Parquet files that appear below ``path``.

    Telling all edges ever seen apart keeps a state of the size of the graph. With ``delay`` the
    files have a time ``at``, and an edge is told apart from its repeats of that long before
    only, so the state holds the edges of that time; the time stays in the result.
    """
    raw = spark.readStream.schema("u long, v long" + (", at timestamp" if delay else "")).parquet(path)
    ends = raw.where("u is not null and v is not null and u <> v").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    if delay is None:
        return ends.dropDuplicates(["u", "v"])
    return ends.withWatermark("at", delay).dropDuplicatesWithinWatermark(["u", "v"])


def degrees_by_window(edges: DataFrame, size: str) -> DataFrame:
    """(start, node, degree): degrees among the edges of each window of time, for a stream with ``at``."""
    both = edges.select(F.explode(F.array("u", "v")).alias("node"), "at")
    return both.groupBy(F.window("at", size), "node").agg(F.count("*").alias("degree")).select(F.col("window.start").alias("start"), "node", "degree")


def running_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of all edges so far."""
    both = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))
