"""Text sources and sinks: graphs, solutions, coordinates, partitions, edits, drawings.

Graph files have comment lines starting with ``c``, a header ``p <word> <n> <m>`` and edge
lines ``u v``; ids are 1-based in files and 0-based in tables.
"""

from __future__ import annotations

import colorsys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.functions.ranks import ranked
from knotwork.sources.derive import normalise
from knotwork.storage import partitions


class BadFile(ValueError):
    """A file is not in the expected form."""


def read_gr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id), edges(u, v)) of a graph file; loops and repeated edges are dropped.

    Raises ``BadFile`` without exactly one header, or for an edge line that is not two ids
    within the header's range.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not line like 'c%'")
    heads = lines.where("line like 'p%'").limit(2).collect()
    if len(heads) != 1 or len(heads[0].line.split()) != 4:
        raise BadFile(f"{path}: one header 'p <word> <n> <m>' is needed")
    n = int(heads[0].line.split()[2])
    parts = lines.where("not line like 'p%'").select(F.split("line", r"\s+").alias("x"))
    ends = parts.select(F.size("x").alias("k"), (F.try_element_at("x", F.lit(1)).try_cast("long") - 1).alias("u"), (F.try_element_at("x", F.lit(2)).try_cast("long") - 1).alias("v"))
    wrong = f"k <> 2 or u is null or v is null or u not between 0 and {n - 1} or v not between 0 and {n - 1}"
    if ends.where(wrong).limit(1).count():
        raise BadFile(f"{path}: a line is not an edge between 1 and {n}")
    return spark.range(n), normalise(ends.select("u", "v"))


def numbered_graph(folder: str, number: int) -> str:
    """Path of a numbered benchmark graph: odd numbers 1 to 199."""
    if number % 2 == 0 or not 1 <= number <= 199:
        raise ValueError("graphs have odd numbers from 1 to 199")
    return f"{folder}/exact{number:03d}.gr"


def _write_sorted(rows: DataFrame, path: str, value: str, *order: str) -> None:
    """Write one column as text, in order over all parts: part files are ranges of the order."""
    n = partitions(rows.sparkSession)
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(value).write.mode("overwrite").text(path)


def write_gr(nodes: DataFrame, edges: DataFrame, path: str, word: str = "cep") -> None:
    """Write a graph: header first, then the edges in order, in parts whose names are in order."""
    n, m = nodes.count(), edges.count()
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(f"p {word} {n} {m}").alias("line"))
    body = edges.select(F.lit(1).alias("k"), "u", "v", F.concat_ws(" ", F.col("u") + 1, F.col("v") + 1).alias("line"))
    _write_sorted(head.unionByName(body), path, "line", "k", "u", "v")


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """assign(node, cluster) of a solution file, or a folder of parts in order of their names.

    The number of a line is its node. A part is read whole, since a split file has no line
    numbers; parts are numbered through by their numbers of lines.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\s*\n").alias("x"))
    parts = whole.where("size(x) > 1 or trim(x[0]) <> ''").withColumn("n", F.size("x"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    lines = parts.join(F.broadcast(starts), "file").select("start", F.posexplode("x").alias("at", "line"))
    return lines.select((F.col("start") + F.col("at")).cast("long").alias("node"), F.trim("line").cast("long").alias("cluster")).where("cluster is not null")


def write_solution(assign: DataFrame, path: str) -> None:
    """Inverse of ``read_solution``: one cluster id a line, in order of nodes from 0."""
    if not path:
        raise ValueError("no file name")
    _write_sorted(assign.select("node", F.col("cluster").cast("string").alias("line")), path, "line", "node")


def read_coordinates(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """(node, x, y); nodes that the file leaves out are at 0, 0."""
    rows = spark.read.text(path).where("not value like '%\\%%' escape '\\\\' and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    at = rows.select((F.col("p")[0].cast("long") - 1).alias("node"), F.col("p")[1].cast("double").alias("x"), F.col("p")[2].cast("double").alias("y"))
    every = nodes.select(F.col("id").alias("node")).unionByName(at.select("node")).distinct()
    return every.join(at, "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def read_partition(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """(node, part); nodes that the file leaves out are in part 0."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    at = rows.select((F.col("p")[0].cast("long") - 1).alias("node"), F.col("p")[1].cast("long").alias("part"))
    return nodes.select(F.col("id").alias("node")).join(at, "node", "left").select("node", F.coalesce("part", F.lit(0)).alias("part"))


def edit_lines(edits: DataFrame) -> DataFrame:
    """Lines of the edit list, 1-based: (line, u, v) to be written in order of u, v."""
    return edits.select(F.concat_ws(" ", F.col("u") + 1, F.col("v") + 1).alias("line"), "u", "v")


def write_edits(edits: DataFrame, path: str) -> None:
    """Write the edit list as text, in order over all parts."""
    _write_sorted(edit_lines(edits), path, "line", "u", "v")


def result_line(graph: str, nodes: int, edges: int, seed: int, seconds: float, insertions: int, deletions: int, timings: dict[str, float] | None = None) -> str:
    """The RESULT line; the number of edges counts both directions."""
    more = "".join(f" {k}={v:.6f}" for k, v in (timings or {}).items())
    return (
        f"RESULT graph={graph} numNodes={nodes} numEdges={2 * edges} seed={seed} totalTime={seconds:.6f}{more}"
        f" insertions={insertions} deletions={deletions} modifications={insertions + deletions}"
    )


def csv_line(graph: str, edits: int, seconds: float) -> str:
    """``file,edits,seconds``."""
    return f"{graph},{edits},{seconds:.6f}"


def cluster_color(i: int) -> str:
    """A colour for a cluster: hues by the golden angle."""
    r, g, b = colorsys.hsv_to_rgb(i * 0.61803398875 % 1, 0.65, 0.85)
    return f"{r:.3f} {g:.3f} {b:.3f}"


def drawing_primitives(edges: DataFrame, assign: DataFrame, places: DataFrame) -> DataFrame:
    """(layer, x1, y1, x2, y2, cluster, pen): grey lines between clusters, coloured ones inside, then points."""
    ranks = ranked(assign.select("cluster").distinct(), "cluster")
    named = places.join(assign, "node").join(ranks, "cluster")
    a = named.select(F.col("node").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("rank").alias("ru"))
    b = named.select(F.col("node").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("rank").alias("rv"))
    same = F.col("ru") == F.col("rv")
    lines = edges.join(a, "u").join(b, "v").select(
        F.when(same, F.lit(1)).otherwise(F.lit(0)).alias("layer"), "x1", "y1", "x2", "y2", F.when(same, F.col("ru")).alias("cluster"), F.when(same, F.lit(1.2)).otherwise(F.lit(0.4)).alias("pen")
    )
    points = named.select(F.lit(2).alias("layer"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("rank").alias("cluster"), F.lit(0.0).alias("pen"))
    return lines.unionByName(points)


def ipe_page(primitives: DataFrame, most: int = 200_000) -> str:
    """The drawing as an Ipe document, built from rows that come to the driver one partition at a time.

    For a picture only: raises above ``most`` primitives, which nobody could look at.
    """
    if primitives.limit(most + 1).count() > most:
        raise ValueError(f"a picture of more than {most} primitives")
    out = ['<?xml version="1.0"?>', '<!DOCTYPE ipe SYSTEM "ipe.dtd">', '<ipe version="70206" creator="knotwork">', "<page>", '<layer name="edges"/>', '<layer name="nodes"/>']
    for r in primitives.orderBy("layer", "x1", "y1", "x2", "y2").toLocalIterator():
        color = "0.6 0.6 0.6" if r.cluster is None else cluster_color(int(r.cluster))
        if r.layer < 2:
            out.append(f'<path layer="edges" stroke="{color}" pen="{r.pen}">\n{r.x1:g} {r.y1:g} m\n{r.x2:g} {r.y2:g} l\n</path>')
        else:
            out.append(f'<use layer="nodes" name="mark/disk(sx)" pos="{r.x1:g} {r.y1:g}" size="normal" stroke="{color}"/>')
    return "\n".join([*out, "</page>", "</ipe>", ""])
