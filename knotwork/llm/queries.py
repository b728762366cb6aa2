"""The queries of the pipeline operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import chat, decontam, embed_dedup, filter_audit, jaccard_join, langid, lm, matroska, merkle, mixing, suffix_dedup, token_scan, toxicity
from knotwork.storage import read_table


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 512 documents and 16 MB, so that a batch of long texts stays small.

    Results are lazy, so the session keeps the setting; smaller limits of its own stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 512), ("spark.sql.execution.arrow.maxBytesPerBatch", 16_000_000)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, train_rows=remainder(4) != 2)
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.leak_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_scan.token_counts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "closed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.repeat_table(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, train_rows=remainder(5) != 0)
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(read_table(spark, sf_dir, "documents"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return matroska.media_digest(read_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    scored = lm.score(docs, remainder(7) != 2)
    return scored.withColumn("held_out", F.coalesce(remainder(7) == 2, F.lit(False)))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before, text = ("doc_id", "source", "lang", "n_chars"), F.col("text")
    capitals = "".join(chr(c) for c in range(65, 91))
    lower = merkle.leaf_hash(*(F.col(c) for c in before), F.translate(text, capitals, capitals.lower()))
    leaf = merkle.leaf_hash(*(F.col(c) for c in before), text)
    proofs, _ = merkle.merkle(docs, leaf, carried={"tampered": F.when(remainder(3) == 0, lower).otherwise(leaf)})
    digest, fold = merkle.proof_digest(F.col("lefts"), F.col("rights")), merkle.folded(F.col("tampered"), F.col("lefts"), F.col("rights"))
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest.alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_token_counts, op4_suffix_dedup, op5_language_id, op6_ngram_jaccard, op7_chat_rotation, op8_mix, op9_matroska, op10_lm_score, op11_merkle, op12_embedding_dedup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_rotation": chat.ROTATE_SQL, "op11_merkle": merkle.MERKLE_SQL, "op12_embedding_dedup": embed_dedup.LINK_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
