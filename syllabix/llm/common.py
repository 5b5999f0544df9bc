"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from syllabix.session import pin, ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's partition count for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_rows(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly over the session's shuffle partitions."""
    return rows.repartition(shuffle_partitions(rows.sparkSession))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the identifier written as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


# Rows turned into Python objects at a time.
SLICE_ROWS = 1_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def pin_batched(df: DataFrame) -> DataFrame:
    """``pin`` with at most ``SLICE_ROWS`` rows in an Arrow batch, for rows that hold whole texts or sets."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(SLICE_ROWS))
    try:
        return pin(df)
    finally:
        conf.set(key, before)


def map_batches(df: DataFrame, function: Callable[..., dict[str, list]], schema: str, *args) -> DataFrame:
    """``function(columns, *args)`` on slices of every Arrow batch; it takes and returns a dict of equally long lists.

    Text columns arrive as Python strings (None where missing), lists as lists. Batches
    are bounded by Spark's Arrow settings, so a task never holds its whole partition.
    """
    ship_package(df.sparkSession)
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = function({name: batch.column(name).to_pylist() for name in batch.schema.names}, *args)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def append_column(df: DataFrame, name: str, kind: str, function: Callable[..., list], column: str, *args) -> DataFrame:
    """``df`` with one more column, ``function(values of column, *args)`` per slice of rows; the others pass through untouched."""
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields]).add(name, kind)
    target = to_arrow_schema(schema)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            new = pa.array(function(batch.column(at).to_pylist(), *args), target[-1].type)
            arrays = [a.cast(f.type) for a, f in zip(batch.columns, target, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, new], schema=target)

    return df.mapInArrow(run, schema)


_ACTIVE: list[dict] = []


def active(memory: dict) -> dict:
    """The operator's memory of words; that of any other operator is emptied, as workers serve one after another."""
    if not _ACTIVE or _ACTIVE[0] is not memory:
        for other in _ACTIVE:
            other.clear()
        _ACTIVE[:] = [memory]
    return memory


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


# A filter passed to all tasks is a set of bucket numbers below this, whatever the corpus size.
FILTER_BUCKETS = 1 << 20


def drop_documents(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the identifiers in ``dropped``; rows without identifier stay.

    Rows whose bucket holds no dropped identifier pass without a shuffle; only the
    others meet the list itself. A missing identifier cannot be named and so stays.
    """
    bucket = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(FILTER_BUCKETS)).cast("bigint")
    mark, hit = unused_name(docs, "_bucket"), unused_name(docs, "_hit")
    hits = F.broadcast(dropped.select(bucket.alias(mark)).distinct().withColumn(hit, F.lit(True)))
    marked = docs.withColumn(mark, bucket).join(hits, mark, "left")
    clear = marked.filter(F.col(hit).isNull()).select(docs.columns)
    unclear = marked.filter(F.col(hit)).select(docs.columns)
    return clear.unionByName(unclear.join(dropped.select(doc_id).distinct(), doc_id, "left_anti").select(docs.columns))
