"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.oracles import quality_sql, secrets_sql


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the public byte-level vocabulary; digests of both directions."""
    import public_tokenizers

    from lamina.llm.bpe import bpe_encode

    done = bpe_encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def secret_digest(documents: DataFrame) -> DataFrame:
    """Counts and digests of the spans that find_secrets finds."""
    from lamina.llm.secrets import KINDS, find_secrets, spans_text

    base = F.filter("spans", lambda s: s["ord"] < 3)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS[:3]]
    return find_secrets(documents).select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secret_digest(_documents(spark, sf_dir))


def quality_counts(documents: DataFrame) -> DataFrame:
    """What quality() finds, without the cleaned texts."""
    from lamina.llm.quality import quality

    return quality(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents."""
    return quality_counts(_documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents, exactly or as templates."""
    from lamina.llm.decontaminate import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    from lamina.llm.jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by the model of their labelled rows outside the held-out fold."""
    from lamina.llm.common import crc_mod
    from lamina.llm.toxicity import FOLDS, fit_toxicity, score_toxicity

    scored = score_toxicity(documents, fit_toxicity(documents, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity_digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeat_digest(documents: DataFrame) -> DataFrame:
    """What remove_repeats removes, and a digest of what it keeps."""
    from lamina.llm.suffix import remove_repeats

    return remove_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings removed from all documents."""
    return repeat_digest(_documents(spark, sf_dir))


def lm_scores(documents: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those that aren't held out."""
    from lamina.llm.common import crc_mod
    from lamina.llm.lm import FOLDS, fit_kneser_ney, score_kneser_ney, training_rows

    scored = score_kneser_ney(documents, fit_kneser_ney(training_rows(documents)))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return lm_scores(_documents(spark, sf_dir))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of all pages say of them, read back by their index."""
    from lamina.llm.common import shared_path
    from lamina.llm.warc import read_warc, write_warc

    back = read_warc(write_warc(pages, shared_path(pages.sparkSession, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written and read back."""
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    from lamina.llm.html import extract_main_text, fit_weights

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_main_text(pages, fit_weights(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": op1_bpe, "op2_secrets": op2_secrets, "op3_suffix": op3_suffix, "op4_lm": op4_lm, "op5_warc": op5_warc, "op6_quality": op6_quality, "op7_html": op7_html, "op8_decontamination": op8_decontamination, "op9_jaccard": op9_jaccard, "op10_toxicity": op10_toxicity,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op2_secrets": secrets_sql(), "op6_quality": quality_sql()}
