"""Bounded training samples of labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    """Texts with a 0/1 label, and the share of label 1 among all rows that may be learned from."""

    texts: list[str]
    labels: list[int]
    positive_share: float


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_chars: int,
    text: str = "text", doc_id: str = "doc_id",
) -> Sample:
    """At most ``per_class`` whole documents of each label, drawn by hash of the identifier.

    Drawn are identifiers that ``usable`` admits; documents over ``max_chars`` characters
    are passed over, so the sample holds at most ``2 * per_class * max_chars`` characters
    whatever the corpus. Rows without label or identifier are ignored; contradicting
    labels of one document count as 1.
    """
    known = (
        labels.filter(usable & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    )
    order = F.xxhash64("_id", F.lit("sample"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [known.filter(F.col("_label") == y).orderBy(order, "_id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class identifiers: a proven bound for the broadcast.
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
        .filter(F.col("_text").isNotNull() & (F.length("_text") <= max_chars))
        .join(F.broadcast(drawn[0].unionByName(drawn[1])), "_id")
        .groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
        .orderBy(order, "_id").collect()
    )
    known_rows = sum(totals.values())
    return Sample([r["_text"] for r in rows], [r["_label"] for r in rows], totals.get(1, 0) / known_rows if known_rows else 0.0)
