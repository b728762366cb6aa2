"""Graphs derived from ordinary tables: edges(u, v) with u < v, distinct."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.storage import read_table, spread

#: Vectors in a block at least and at most, blocks if there are enough vectors, and the rows of a
#: block that are multiplied with another block at a time.
BLOCK, MOST, BLOCKS, STRIP = 1024, 1 << 14, 16, 256


def normalise(edges: DataFrame) -> DataFrame:
    """Undirected simple edges from any pairs: no loops, smaller end first, distinct."""
    return (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
        .distinct()
    )


def similarity_edges(vectors: DataFrame, id_col: str, vec_col: str, least: float) -> DataFrame:
    """Pairs of vectors with cosine at least ``least``, by products of blocks of vectors.

    Vectors are packed a block to a row. Every block meets every block once: of two, the one goes to
    the other's home, in turn, so homes have equally many. A vector is sent to half of all blocks, and
    blocks grow with the table up to ``MOST`` vectors. Only pairs above the threshold leave a task.
    """
    kept = dict(vectors.dtypes)[vec_col] if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    numbered = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kept).alias("x")
    )
    many = numbered.count()
    blocks = max(1, -(-many // min(MOST, max(BLOCK, many // BLOCKS))))
    packed = (
        numbered.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("rows"))
        .select("b", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("xs"))
    )
    home = (F.col("b") == F.col("c")) | ((F.col("b") < F.col("c")) == ((F.col("b") + F.col("c")) % 2 == 0))
    left = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), F.col("b"), F.col("ids").alias("ia"), F.col("xs").alias("xa")).where(home)
    right = packed.select(F.col("b").alias("c"), F.col("ids").alias("ib"), F.col("xs").alias("xb"))
    # not left to the planner, which would put all homes into one task for their few bytes
    pairs = spread(left, "c").join(right.hint("shuffle_merge"), "c").select("b", "c", "ia", "xa", "ib", "xb")

    def unit(ids, xs):
        x = xs.to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        return ids.to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(batches):
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                (ia, a), (ib, b) = (unit(col[i][k].values, col[x][k].values) for i, x in (("ia", "xa"), ("ib", "xb")))
                own = col["b"][k].as_py() == col["c"][k].as_py()
                u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
                for lo in range(0, len(ia), STRIP):
                    i, j = np.nonzero(a[lo : lo + STRIP] @ b.T >= least)
                    if own:
                        i, j = i[i + lo < j], j[i + lo < j]
                    u.append(np.minimum(ia[i + lo], ib[j]))
                    v.append(np.maximum(ia[i + lo], ib[j]))
                    held += len(i)
                    if held > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
                        u, v, held = [], [], 0
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def together_edges(rows: DataFrame, group_col: str, item_col: str, least: int) -> DataFrame:
    """Pairs of items that share at least ``least`` groups; groups are small (orders, baskets)."""
    return together_weights(rows, group_col, item_col, least).select("u", "v")


def together_weights(rows: DataFrame, group_col: str, item_col: str, least: int) -> DataFrame:
    """(u, v, s) of the same pairs, with the number of groups that they share."""
    held = rows.select(F.col(group_col).alias("g"), F.col(item_col).cast("long").alias("i")).distinct()
    pairs = held.withColumnRenamed("i", "u").join(held.withColumnRenamed("i", "v"), "g").where("u < v")
    return pairs.groupBy("u", "v").agg(F.count("*").alias("s")).where(F.col("s") >= least)


def emb_graph(spark: SparkSession, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Embeddings whose cosine reaches ``least``."""
    return similarity_edges(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least)


def part_graph(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Parts that are together in at least ``least`` orders."""
    return together_edges(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", least)


def part_weights(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """The same pairs, weighted by the orders that they share."""
    return together_weights(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", least)


def adjacency_edges(lists: DataFrame, id_col: str = "id", list_col: str = "neighbors") -> DataFrame:
    """Edges from adjacency lists."""
    return normalise(lists.select(F.col(id_col).alias("u"), F.explode(list_col).alias("v")))


EMB_SQL = """e AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {least})"""
#: The same pairs with the number of orders that they share.
PART_WEIGHT_SQL = """e AS MATERIALIZED (SELECT a.p AS u, b.p AS v, count(*) AS s FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= {least})"""
PART_SQL = """e AS MATERIALIZED (SELECT a.p AS u, b.p AS v FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= {least})"""
