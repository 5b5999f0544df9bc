"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.session import pin

# A filter passed to all tasks is a set of bucket numbers below this, whatever the corpus size.
FILTER_BUCKETS = 1 << 18


def _crowded(rows: DataFrame, bucket: Column) -> DataFrame:
    """Buckets that hold more than one row: at most FILTER_BUCKETS numbers."""
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(counts.filter("_n > 1").select("_bucket"))


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    prefix: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """Groups of identical texts, one row per document, dropped ones too.

    Returns ``doc_id``, ``keep_id`` (largest identifier of the group), ``group_size``,
    ``kept`` and ``text_sha256`` (hex; null for texts that the first two levels showed to
    be unique, unless ``digest_all``).

    Level 1 groups by byte length and level 2 by length and hash of the first ``prefix``
    characters; both use a narrow table of signatures. Level 3 reads the texts again and
    hashes whole only those of surviving groups; it finds them by a filter of at most
    ``FILTER_BUCKETS`` bucket numbers, so texts are never shuffled (a false survivor costs
    one more hash and changes nothing). Groups are summed before the shuffle and joined
    back on the full key, where adaptive execution splits a hot group.

    A missing text counts as empty and empty texts are copies of each other. Missing
    identifiers are never kept in favour of others (a group of only those has a null
    ``keep_id`` and keeps them all). Rows that repeat identifier and text get the same
    answer. Other columns are not read.
    """
    whole = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    signed = whole.select(
        "_id", "_text", F.octet_length("_text").alias("_length"),
        F.xxhash64(F.substring("_text", 1, prefix)).alias("_prefix"),
    )
    by_length = F.pmod(F.col("_length"), F.lit(FILTER_BUCKETS)).cast("bigint")
    by_prefix = F.pmod(F.xxhash64("_length", "_prefix"), F.lit(FILTER_BUCKETS)).cast("bigint")

    signatures = pin(signed.select("_length", "_prefix"))
    same_length = signatures.withColumn("_bucket", by_length).join(_crowded(signatures, by_length), "_bucket", "left_semi")
    survivors = _crowded(same_length, by_prefix).withColumn("_survives", F.lit(True))

    full = F.sha2(F.col("_text").cast("binary"), 256)
    hashed = pin(
        signed.withColumn("_bucket", by_prefix)
        .join(survivors, "_bucket", "left")
        .select(
            "_id", "_length", "_prefix", F.coalesce("_survives", F.lit(False)).alias("_survives"),
            (full if digest_all else F.when(F.col("_survives"), full)).alias("_digest"),
        )
    )
    key = ["_length", "_prefix", "_digest"]
    alive = hashed.filter("_survives")
    groups = pin(alive.groupBy(*key).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1"))
    grouped = alive.join(groups, key, "left").select(
        "_id", "_digest",
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("_size"),
    )
    single = hashed.filter("NOT _survives").select("_id", "_digest", F.col("_id").alias("_keep"), F.lit(1).cast("bigint").alias("_size"))
    return grouped.unionByName(single).select(
        F.col("_id").alias(doc_id), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("text_sha256"),
    )
