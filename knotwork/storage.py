"""Reading tables and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of an estimated size that no real table comes near.
ESTIMATE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; the path may be in any store Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A session in one JVM that has none gets a local one; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/knotwork-checkpoints-{os.getuid()}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows.

    Reliable: a lost executor loses nothing, since the files are in shared storage.

    A checkpoint keeps the planner's estimate of its size. In loops that join the last round's
    table with itself the estimate is squared in every round, until planning is all about numbers
    of millions of digits; beyond ``ESTIMATE`` bits the rows go through Parquet, which has sizes.
    """
    shared_dir(df.sparkSession)
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() > ESTIMATE:
        return table(df)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns of ``df`` as one struct, so that columns added beside it cannot clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column] | None = None, name: str = "row") -> DataFrame:
    """The columns of a packed table, then the added ones; an added one replaces its namesake."""
    added = added or {}
    names = {c.lower() for c in added}
    return df.select(*(F.col(f"{name}.`{c}`").alias(c) for c in columns if c.lower() not in names), *(x.alias(c) for c, x in added.items()))


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key over all partitions. Groups of few bytes can be long work for a kernel, and the
    planner would otherwise put them all into one task for their size."""
    return df.repartition(partitions(df.sparkSession), *by)


def table(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; for wide rows ``cut`` is too
    bulky. With ``by``, a folder for each value of these columns, so readers of one skip the rest."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate Parquet tables in the shared folder, removed when the block ends.

    What leaves the block must have been written by ``cut`` or ``table`` before its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        sc = self.spark.sparkContext
        for path in self.paths:
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
