"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Between stages ``run`` writes Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import decontam, jaccard_join, mixing, suffix_dedup, toxicity
from knotwork.llm.queries import remainder, small_batches
from knotwork.storage import cut, packed, read_table, table, unpacked


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, scored as in op1.

    Null and empty texts are scored like all others, and repeated rows alike.
    """
    small_batches(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), train_rows=remainder(4) != 2)
    return unpacked(toxicity.scored(docs, model).where("predicted = 0"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, of ids before none.

    Five words to a shingle and a similarity of 0.8. Rows are told apart by a 64-bit hash of id
    and text, so rows without an id are members of their groups like all others, different
    texts of one id are different documents, and of repeated rows one stays: the smallest in
    its other columns. Texts without words are in no group.
    """
    small_batches(spark)
    key = F.xxhash64("row.doc_id", "row.text").alias("key")
    rows = packed(docs).withColumn("key", key)
    groups = jaccard_join.set_components(rows.select("key", "row.text"), id_col="key", k=5, percent=80)
    places = groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("comp").alias("comp"), F.count("*").alias("many"))
    ids = rows.groupBy("key").agg(F.first("row.doc_id").alias("id"))
    # a text without words has no component and stays
    places = cut(places.join(ids, "key"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    best = places.where("comp is not null").groupBy("comp").agg(F.min(rank).alias("best")).select(F.col("best.key").alias("key"))
    stay = places.where("comp is null").select("key").unionByName(best)
    several = cut(places.where("many > 1").join(stay, "key", "left_semi").select("key"))
    moved = cut(places.join(stay, "key", "left_anti").select("key").unionByName(several))
    once = rows.join(moved, "key", "left_anti").select("row")
    again = rows.join(several, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row")
    return unpacked(once.unionByName(again), docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings of 200 bytes that occur elsewhere."""
    small_batches(spark)
    return suffix_dedup.remove_repeats(docs, length_col="n_chars").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    small_batches(spark)
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, with ``copy_no`` from 1."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: No stage but the last two comes near SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs)
    return docs
