"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, then BPE. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.bpe import bpe_encode
from lamina.llm.common import stored
from lamina.llm.decontaminate import leaks
from lamina.llm.jaccard import MAX_BROADCAST, jaccard_components
from lamina.llm.secrets import redact_secrets
from lamina.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted to their labels doesn't call toxic; those without a text are kept."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep=tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate documents the one with the smallest id; of repeated rows of an id one. Rows without an id are kept."""
    classes = stored(jaccard_components(docs).where("doc_id IS NOT NULL"), "classes")
    dropped = classes.groupBy("doc_id").agg(F.max((F.col("component_id") < F.col("doc_id")).cast("int")).alias("d"), F.count("*").alias("c"))
    dropped = stored(dropped.where("d = 1 OR c > 1"), "dropped")
    gone = dropped.where("d = 1").select("doc_id")
    kept = docs.select(*COLUMNS).join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone, "doc_id", "left_anti")
    repeated = dropped.where("d = 0").select("doc_id")
    if not (n := repeated.count()):
        return kept
    some = F.broadcast(repeated) if n <= MAX_BROADCAST else repeated
    once = kept.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.join(some, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    found = stored(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaks")
    return docs.select(*COLUMNS).join(F.broadcast(found) if found.count() <= MAX_BROADCAST else found, "doc_id", "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets redacted; n_chars is that of the new text where the text changed."""
    old = docs.select(*COLUMNS)
    new = redact_secrets(old.withColumn("__old", F.xxhash64("text")))
    return new.select("doc_id", "text", "lang", "source", F.when(F.xxhash64("text") != F.col("__old"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), and the digest of the text that they decode to."""
    import public_tokenizers

    done = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"), decode=True)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
