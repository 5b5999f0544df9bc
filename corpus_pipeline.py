"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``. Stages that
compare documents number their rows first and decide row by row, so rows without
identifier and rows that share one have a fate of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabix.llm.common import drop_documents, fold, table, unused_name
from syllabix.llm.exact_dedup import exact_dedup
from syllabix.llm.mixing import MISSING, mix
from syllabix.llm.near_dedup import near_dedup
from syllabix.llm.packing import pack_documents
from syllabix.llm.queries import TREE_WEIGHTS, WORD_VOCABULARY, source_tree
from syllabix.llm.toxicity import Settings, reject_toxic, train
from syllabix.llm.training import labelled_sample
from syllabix.session import pin, pinned_count, release_pinned

# Share of the tokens that mixing keeps, and the score from which a document is toxic.
MIXED_SHARE, TOXIC_FROM = 0.8, 0.3


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written out with a number for every row, and the number's column."""
    row = unused_name(docs, "row_number")
    return pin(docs.withColumn(row, F.monotonically_increasing_id())), row


def _all_but_one(numbered: DataFrame, row: str, grouped: DataFrame, group: str, best: Column) -> DataFrame:
    """Rows of every group of ``grouped`` (``row`` and ``group``) but the one with the least ``best``, then the first."""
    members = pin(grouped.select(F.col(row).alias("_row"), F.col(group).alias("_group")).join(
        numbered.select(F.col(row).alias("_row"), "doc_id"), "_row").select("_row", "_group", best.alias("_best")))
    kept = members.groupBy("_group").agg(F.min(F.struct("_best", "_row"))["_row"].alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return members.join(kept, "_group").filter("_row <> _kept").select(F.col("_row").alias(row))


def _without(numbered: DataFrame, row: str, dropped: DataFrame, before: int) -> DataFrame:
    """``numbered`` without the dropped rows; what else was pinned since ``before`` is deleted."""
    dropped = pin(dropped)
    release_pinned(numbered.sparkSession, before, keep=[numbered, dropped])
    return drop_documents(numbered, dropped, row).drop(row)


def reject_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A model learned from the labelled documents of three folds of four rejects toxic ones."""
    settings = Settings()
    sample = labelled_sample(
        docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2, settings.per_class, settings.max_chars)
    return reject_toxic(docs, train(sample, settings), TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, one row with the largest doc_id stays; rows without one only if no other has the text."""
    before = pinned_count()
    numbered, row = _numbered(docs)
    grouped = exact_dedup(numbered, doc_id=row).filter("group_size > 1")
    best = F.struct(F.isnull("doc_id"), -F.col("doc_id").cast("decimal(20,0)"))
    return _without(numbered, row, _all_but_one(numbered, row, grouped, "keep_id", best), before)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, one row with the smallest doc_id stays; rows without one only if the group has no other."""
    before = pinned_count()
    numbered, row = _numbered(docs)
    grouped = near_dedup(numbered, doc_id=row)
    best = F.struct(F.isnull("doc_id"), F.col("doc_id"))
    return _without(numbered, row, _all_but_one(numbered, row, grouped, "component_id", best), before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, mixed to the weights of the source tree; no document twice.

    Rows without identifier are drawn by their number; rows that share one are drawn together.
    """
    before = pinned_count()
    numbered, row = _numbered(docs)
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col(row)))
    named = numbered.select(row, drawn.alias("drawn"), "lang", "source", "text")
    chosen = mix(named, source_tree(), TREE_WEIGHTS, MIXED_SHARE, max_epochs=1, seed=20, doc_id="drawn").select("drawn", "lang", "source").distinct()
    leaves = [F.coalesce(c, F.lit(MISSING)).alias(c) for c in ("lang", "source")]
    left = named.select(row, "drawn", *leaves).join(chosen, ["drawn", "lang", "source"], "left_anti").select(row)
    return _without(numbered, row, left, before)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences of 4,096."""
    return pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic_documents),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# The toxicity model, the near-duplicate confirmation and the tokenizer are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; ``release_pinned`` deletes what they wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
