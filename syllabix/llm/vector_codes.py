"""Product codes of vectors, trained over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from syllabix.functions.joins import lookup_join
from syllabix.llm.common import map_batches, shuffle_partitions
from syllabix.session import pin, ship_package

PARTS = 4
# Bits per component of the Hilbert curve's grid.
GRID_BITS = 4
# Vectors of a block.
BLOCK_ROWS = 256
# Sums of tasks are added up in so many groups a part before the driver adds those.
SUM_GROUPS = 32
# Largest whole number up to which doubles hold every whole number.
EXACT = 1 << 53


@dataclass(frozen=True)
class Settings:
    """Entries of a codebook, rounds of training, and what a component is multiplied with before it is floored."""

    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Place of every row of whole coordinates below ``2**bits`` on the Hilbert curve, as bytes that sort alike."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            set_ = (x[i] & bit) > 0
            exchanged = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, exchanged)
            x[i] ^= exchanged
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turned ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turned
    # Most significant bits of all coordinates first.
    planes = np.stack([(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)], axis=1)
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8), axis=1)]


def _cut(columns: dict[str, list], low: np.ndarray, high: np.ndarray) -> dict[str, list]:
    """Every vector as ``PARTS`` rows with their Hilbert keys; the grid spans ``low`` to ``high``, what lies outside counts as its edge."""
    out: dict[str, list] = {"part": [], "key": [], "row": [], "values": []}
    if not columns["row"]:
        return out
    whole = np.array(columns["vector"], np.int64)
    cells = 1 << GRID_BITS
    grid = np.clip((whole - low) * cells // np.maximum(high - low + 1, 1), 0, cells - 1)
    width = whole.shape[1] // PARTS
    for part in range(PARTS):
        piece = slice(part * width, (part + 1) * width)
        out["part"] += [part] * len(whole)
        out["key"] += hilbert_keys(grid[:, piece], GRID_BITS)
        out["row"] += columns["row"]
        out["values"] += [v.tobytes() for v in whole[:, piece].astype("<i4")]
    return out


BLOCK_SCHEMA = "part int, n int, rows binary, values binary, low binary, high binary, sums binary"


def _block(part: int, rows: np.ndarray, values: np.ndarray) -> dict[str, object]:
    return {
        "part": part, "n": len(rows), "rows": rows.astype("<i8").tobytes(), "values": values.astype("<i4").tobytes(),
        "low": values.min(axis=0).astype("<i8").tobytes(), "high": values.max(axis=0).astype("<i8").tobytes(),
        "sums": values.sum(axis=0).astype("<i8").tobytes(),
    }


def _blocks(parts: DataFrame, block_rows: int) -> DataFrame:
    """Flat blocks of up to ``block_rows`` neighbours on the curve, with minimum, maximum and sum of every component.

    Rows are range-partitioned by part, curve and row number, so equal vectors may span
    any number of tasks; a task holds one batch and one unfinished block.
    """
    order = ["part", "key", "row"]
    target = to_arrow_schema(parts.sparkSession.createDataFrame([], BLOCK_SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[int, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            out = []
            part = batch.column("part").to_numpy()
            rows = batch.column("row").to_numpy()
            values = np.frombuffer(b"".join(batch.column("values").to_pylist()), "<i4").astype(np.int64).reshape(len(rows), -1)
            for p in np.unique(part).tolist():
                mine = part == p
                r, v = rows[mine], values[mine]
                if rest and rest[0] == p:
                    r, v = np.concatenate([rest[1], r]), np.concatenate([rest[2], v])
                elif rest:
                    out.append(_block(*rest))
                full = len(r) // block_rows * block_rows
                out += [_block(p, r[i : i + block_rows], v[i : i + block_rows]) for i in range(0, full, block_rows)]
                rest = (p, r[full:], v[full:]) if full < len(r) else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if rest:
            yield pa.RecordBatch.from_pylist([_block(*rest)], schema=target)

    sorted_ = parts.repartitionByRange(shuffle_partitions(parts.sparkSession), *order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(run, BLOCK_SCHEMA)


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Numbers of the entries that can be nearest to some point of a box.

    An entry is left out if even its nearest point of the box is farther away than the
    farthest point is from some other entry, so it can neither win nor tie.
    """
    outside = np.maximum(np.maximum(low - book, book - high), 0)
    across = np.maximum(np.abs(book - low), np.abs(book - high))
    return np.flatnonzero((outside**2).sum(axis=1) <= (across**2).sum(axis=1).min())


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``entries`` of the nearest one (the first of equals) and the squared distance, in exact whole numbers."""
    largest = int(max(np.abs(values).max(initial=0), np.abs(entries).max(initial=0)))
    if values.shape[1] * (2 * largest) ** 2 < EXACT:
        # Every sum is a whole number below 2**53, so doubles are exact.
        x, c = values.astype(np.float64), entries.astype(np.float64)
        squared = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None, :]
    else:
        squared = np.stack([((values - c) ** 2).sum(axis=1) for c in entries], axis=1)
    at = squared.argmin(axis=1)
    return at, squared[np.arange(len(values)), at].astype(np.int64)


def _unpacked(block: dict, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The block's codebook and the shortlist of its entries."""
    book = books[block["part"]]
    return book, shortlist(np.frombuffer(block["low"], "<i8"), np.frombuffer(block["high"], "<i8"), book)


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part, the vectors and the component sums of every entry."""
    schema = "part int, salt int, counts binary, sums binary"
    target = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        salt = 0
        for batch in batches:
            for block in batch.to_pylist():
                book, near = _unpacked(block, books)
                counts, sums = found.setdefault(block["part"], (np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)))
                salt = block["salt"]
                if len(near) == 1:
                    counts[near[0]] += block["n"]
                    sums[near[0]] += np.frombuffer(block["sums"], "<i8")
                    continue
                values = np.frombuffer(block["values"], "<i4").astype(np.int64).reshape(block["n"], -1)
                at = near[nearest(values, book[near])[0]]
                counts += np.bincount(at, minlength=len(book))
                np.add.at(sums, at, values)
        rows = [{"part": p, "salt": salt, "counts": c.tobytes(), "sums": s.tobytes()} for p, (c, s) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=target)

    def added(rows: pa.Table) -> pa.Table:
        whole = [np.sum([np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()], axis=0) for c in ("counts", "sums")]
        first = {"part": rows.column("part")[0].as_py(), "salt": rows.column("salt")[0].as_py()}
        return pa.Table.from_pylist([first | {"counts": whole[0].tobytes(), "sums": whole[1].tobytes()}], schema=target)

    salted = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)).cast("int"))
    partial = salted.mapInArrow(run, schema).groupBy("part", "salt").applyInArrow(added, schema)
    total = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
    for row in partial.collect():  # at most PARTS * SUM_GROUPS rows of one codebook's size
        counts, sums = total[row["part"]]
        counts += np.frombuffer(row["counts"], np.int64)
        sums += np.frombuffer(row["sums"], np.int64).reshape(sums.shape)
    return total


def _codes(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``row``, ``part``, ``entry`` and ``distance`` of every part of every vector."""

    def assigned(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"row": [], "part": [], "entry": [], "distance": []}
        for i, part in enumerate(columns["part"]):
            block = {name: values[i] for name, values in columns.items()}
            book, near = _unpacked(block, books)
            values = np.frombuffer(block["values"], "<i4").astype(np.int64).reshape(block["n"], -1)
            at, distance = nearest(values, book[near])
            out["row"] += np.frombuffer(block["rows"], "<i8").tolist()
            out["part"] += [part] * block["n"]
            out["entry"] += near[at].tolist()
            out["distance"] += distance.tolist()
        return out

    return map_batches(blocks, assigned, "row bigint, part int, entry int, distance bigint")


def usable_vectors(vectors: DataFrame, scale: int, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, int]:
    """``row`` (a number of its own), ``id``, ``label``, ``vector`` (whole numbers) of the rows that are coded, and their number of components.

    The number of components is that of the smallest identifier's vector that can be cut into ``PARTS``.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.coalesce(finite, F.lit(False)))
    rows = rows.filter((F.size("raw") > 0) & (F.size("raw") % PARTS == 0))
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.size("raw")).select(F.size("raw")).first()
    size = first[0] if first else 0
    # Differences, squared and summed over a part, stay below 2**63.
    limit = float(min(1 << 30, int((float(1 << 63) / max(1, size // PARTS)) ** 0.5 / 2)))
    rows = rows.filter((F.size("raw") == size) & F.forall("raw", lambda x: F.abs(x) * scale < limit))
    return pin(rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "label",
        F.transform("raw", lambda x: F.floor(x * scale).cast("int")).alias("vector"))), size


def first_codebooks(rows: DataFrame, entries: int) -> list[np.ndarray]:
    """Parts of the vectors with the smallest identifiers: at most ``entries`` rows reach the driver."""
    chosen = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    return np.split(np.array([r["vector"] for r in chosen], np.int64), PARTS, axis=1) if chosen else []


def trained(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assigning every part and replacing entries by floored means; unused entries stay."""
    for _ in range(rounds):
        books = [
            np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book)
            for book, (counts, sums) in zip(books, _sums(blocks, books), strict=True)]
    return books


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id``, ``label``, ``code``, ``error`` of every usable vector, and the codebooks of the ``PARTS`` parts.

    Components become ``floor(scale * x)``. Every part of all vectors is sorted along a
    Hilbert curve and cut into flat blocks that know their box (smallest and largest
    components) and their sums. In every round a block's box gives the shortlist of
    entries that can be nearest: a block with one such entry is added by its sums,
    otherwise the exact kernel compares its vectors with the shortlist. Blocks are written
    once; a task sends its sums per entry, which are added in ``SUM_GROUPS`` groups, and only
    codebooks reach the driver (``entries`` times the components).

    Left out are vectors that are missing or hold missing or non-finite components, that
    have no components or another number of them than the smallest usable identifier's, or
    a number not divisible by ``PARTS``, and those with components beyond 64-bit arithmetic
    (about 2**18 for 64 components). Missing identifiers sort last, equal ones by their
    vectors; repeated rows are coded one by one; other columns are not read. An empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    rows, size = usable_vectors(vectors, settings.scale, vec_id, embedding, label)
    books = first_codebooks(rows, settings.entries)
    if not books:
        return rows.select(F.col("id").alias(vec_id), F.col("label").alias(label), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    # The grid only orders the rows; results do not depend on it.
    known = np.concatenate(books, axis=1)
    low, high = known.min(axis=0), known.max(axis=0)
    parts = map_batches(rows.select("row", "vector"), _cut, "part int, key binary, row bigint, values binary", low, high)
    blocks = pin(_blocks(parts, block_rows))
    books = trained(blocks, books, settings.rounds)
    digits = max(2, len(f"{settings.entries - 1:x}"))
    coded = _codes(blocks, books).groupBy("row").agg(
        F.concat(*[F.max(F.when(F.col("part") == p, F.lpad(F.lower(F.hex("entry")), digits, "0"))) for p in range(PARTS)]).alias("code"),
        F.sum("distance").alias("error"))
    joined = rows.select("row", "id", "label").join(coded, "row")
    return joined.select(F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``: the errors summed over equal labels, missing ones together. Summed before the shuffle and joined back."""
    coded = pin(coded)
    return lookup_join(coded, coded.groupBy(label).agg(F.sum("error").alias("label_error")), [label])
