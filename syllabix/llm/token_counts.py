"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.llm.bpe import lengths
from syllabix.llm.common import active, map_batches


def _counts(columns: dict[str, list], path: str) -> dict[str, list]:
    of = active(lengths(path)).of
    return {
        "id": columns["id"],
        "n_bytes": [len(t.encode("utf-8")) for t in columns["text"]],
        "n_tokens": [of(t) for t in columns["text"]],
    }


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id``, ``n_bytes``, ``n_tokens`` and, with a limit, ``over_limit``.

    ``vocabulary`` is the path of a byte-pair vocabulary that every machine can read. A
    word's tokens are its byte symbols minus the merges that apply; no identifiers are
    made. Special strings count as one token. Words seen before are remembered per
    worker, up to a fixed number. There is no shuffle: every row is counted where it is read.

    A missing text counts as empty (0 bytes, 0 tokens); missing identifiers and repeated
    rows are counted row by row; other columns are not read; an empty table gives an
    empty result. A text that is one single long word takes O(n log n).
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = map_batches(rows, _counts, f"id {kind}, n_bytes bigint, n_tokens bigint", vocabulary)
    result = counted.withColumnRenamed("id", doc_id)
    return result if limit is None else result.withColumn("over_limit", F.col("n_tokens") > limit)
