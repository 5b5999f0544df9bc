"""One registered query per operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabix.llm import (
    conversation_repair, decontamination, embedding_dedup, exact_dedup, html_extraction, line_dedup, mixing, near_dedup, packing, quality,
    token_counts, toxicity, vector_codes,
)
from syllabix.llm.common import fold, table

WORD_VOCABULARY = "word_bpe_49k.json"
TREE_WEIGHTS = {"domain": {"web": 2, "books": 1, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def source_tree() -> dict[str, Column]:
    """Levels of the source tree, from the top."""
    return {"domain": mixing.source_domain(), "lang": F.col("lang"), "source": F.col("source")}


def held_out_fold(modulus: int, remainder: int) -> Column:
    """Whether a document's labels are never learned from; those of one without identifier belong to no fold and are not known either."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; every third fold is never learned from."""
    docs, held_out = table(spark, folder, "documents"), held_out_fold(3, 1)
    scored = quality.quality_classifier(docs, table(spark, folder, "labels"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without later copies of line runs of ten words or more."""
    return line_dedup.line_dedup(table(spark, folder, "documents"), 10)


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.98."""
    return embedding_dedup.embedding_dedup(table(spark, folder, "embeddings"), 0.98)


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as there are, mixed to the tree's weights with up to four epochs."""
    return mixing.mix(table(spark, folder, "documents"), source_tree(), TREE_WEIGHTS, 1.0, max_epochs=4, seed=20)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pieces of at most 4,096 tokens, packed into few sequences."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document; every fourth fold is never learned from."""
    docs, held_out = table(spark, folder, "documents"), held_out_fold(4, 2)
    scored = toxicity.toxicity(docs, docs, table(spark, folder, "labels"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of identical texts; the largest doc_id stays."""
    return exact_dedup.exact_dedup(table(spark, folder, "documents"), digest_all=True)


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near copies; the smallest doc_id stays."""
    return near_dedup.near_dedup(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens per document."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY), limit=2048)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    return conversation_repair.conversation_repair(table(spark, folder, "conversations"))


def op12_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    found = decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Four-part codes of all vectors from codebooks of 256 entries and four rounds."""
    coded, books = vector_codes.vector_codes(table(spark, folder, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest_of(books)).alias("codebooks_sha256"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_classifier, op2_line_dedup, op3_html_extraction, op4_embedding_near_dedup, op5_source_mixing, op6_best_fit_packing,
        op7_toxicity, op8_exact_dedup, op9_near_dedup, op10_token_counts,
        op11_conversation_repair, op12_benchmark_decontamination, op13_vector_codes,
    )
}
