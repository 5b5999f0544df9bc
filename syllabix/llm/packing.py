"""Vector best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.llm.bpe import identifiers
from syllabix.llm.common import active, map_batches, pin_batched

# Pieces that one task packs together. Every group can leave a few sequences part empty.
GROUP_PIECES = 16_384


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and how much each resource counts in the choice of a bin.

    ``attention`` bounds the sum of squared document lengths. The defaults of documents
    and attention bind no sooner than the tokens do. ``rule`` is ``"norm"`` (the bin
    whose weighted residual is smallest once the piece is in) or ``"dot"`` (the bin whose
    residual has the largest weighted dot product with the demand).
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)
    rule: str = "norm"


def _pieces(columns: dict[str, list], path: str, size: int, end_id: int, keep_ids: bool) -> dict[str, list]:
    of, end = active(identifiers(path)).of, end_id.to_bytes(4, "little")
    rows: list[tuple] = []
    for doc, text in zip(columns["id"], columns["text"], strict=True):
        ids = memoryview(of(text) + end)
        for number, at in enumerate(range(0, len(ids), 4 * size)):
            part = ids[at : at + 4 * size]
            rows.append((doc, number, at // 4, len(part) // 4, crc32(part), bytes(part) if keep_ids else None))
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    out = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}
    return out


def token_pieces(
    docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1,
    text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False,
) -> DataFrame:
    """Tokens of every document and an end token, cut only where longer than ``size``.

    Returns ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids``
    (little-endian unsigned 32-bit, null unless ``keep_ids``). A missing text is empty
    and gives the end token alone.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    return map_batches(rows, _pieces, schema, vocabulary, size, end_id, keep_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; longer pieces are placed first.

    Only bins that still take the smallest piece stay in the search.
    """
    n = len(lengths)
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weight = np.asarray(capacity.weights)
    smallest = lengths.min(initial=capacity.tokens)
    least = (smallest, 1.0, float(smallest) ** 2)
    free = np.empty((3, n))
    names = np.empty(n, dtype=np.int64)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    opened = active = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = (float(lengths[i]), 1.0, float(lengths[i]) ** 2)
        tokens, documents, attention = free[0, :active], free[1, :active], free[2, :active]
        fits = np.flatnonzero((tokens >= need[0]) & (documents >= need[1]) & (attention >= need[2]))
        if len(fits):
            if capacity.rule == "dot":
                score = -sum(w * need[k] * free[k, fits] / limit[k] ** 2 for k, w in enumerate(weight))
            else:
                score = sum(w * ((free[k, fits] - need[k]) / limit[k]) ** 2 for k, w in enumerate(weight) if w)
            at = fits[int(np.argmin(score))]
        else:
            if need[0] > limit[0] or need[2] > limit[2] or limit[1] < 1:
                raise ValueError(f"a piece of {int(need[0])} tokens exceeds an empty sequence")
            at = active
            free[:, at], names[at] = limit, opened
            active, opened = active + 1, opened + 1
        bins[i], offsets[i] = names[at], capacity.tokens - free[0, at]
        free[:, at] -= need
        if any(free[k, at] < least[k] for k in range(3)):
            active -= 1
            free[:, at], names[at] = free[:, active], names[active]
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 in a sequence) to pieces with ``length``.

    Pieces are dealt by the hash of a row number to as many groups as their number needs,
    and each group is packed by one task; no group depends on the data, so equal rows spread. ``pieces`` is read once
    to count and once to pack, so pass a pinned table. An empty table stays empty;
    repeated pieces are placed one by one.
    """
    groups = max(1, ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("bigint"))

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by([(name, "ascending") for name in ("length", "id", "piece") if name in part.column_names])
        bins, offsets = best_fit(part.column("length").to_numpy().astype(np.int64), capacity)
        group = part.column("_group").to_numpy()
        placed = part.drop_columns(["_group"]).append_column("sequence_id", pa.array(group * (1 << 32) + bins))
        return placed.append_column("offset", pa.array(offsets))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), end_id: int = 1,
    text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False,
) -> DataFrame:
    """Every document's pieces and their places: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids`` if kept).

    Tokenizing runs once, where rows are read; only the narrow piece rows are written
    and dealt out. Missing texts are empty, missing identifiers and repeated rows are
    packed like any other, other columns are not read, an empty table gives no rows.
    """
    pieces = token_pieces(docs, vocabulary, capacity.tokens, end_id, text, doc_id, keep_ids)
    packed = pack(pin_batched(pieces if keep_ids else pieces.drop("ids")), capacity)
    return packed.withColumnRenamed("id", doc_id)
