"""Numbering rows of a whole table without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.storage import cut, partitions


def ranked(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """``df`` with the number of each row in order of a column of distinct values, from 0.

    Ranges of the column are partitions; each numbers its rows, and only the partitions' sizes
    are summed over all.
    """
    n = partitions(df.sparkSession)
    held = cut(df.repartitionByRange(n, order).withColumn("part_", F.spark_partition_id()))
    before = held.groupBy("part_").agg(F.count("*").alias("rows_")).withColumn("offset_", F.coalesce(F.sum("rows_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("part_").orderBy(order))
    return held.join(F.broadcast(before.select("part_", "offset_")), "part_").withColumn(name, (F.col("offset_") + own - 1).cast("long")).drop("part_", "offset_")
