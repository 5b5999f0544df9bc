"""Joins in which a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.session import is_pinned, pin

# A lookup is broadcast only below both limits.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``<=>``; the result keeps the key columns of ``left``.

    Non-key columns present on both sides are refused: rename them first, so
    that which side a column comes from is always visible in the caller.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"rename before joining, both sides have {sorted(clash)}")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys],
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def planned_bytes(df: DataFrame) -> float:
    """The planner's size estimate; unknown (no classic session) counts as infinite."""
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return float("inf")


def is_local(df: DataFrame) -> bool:
    """Whether the plan is nothing but rows of a local relation."""
    try:
        return df._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"
    except AttributeError:
        return False


def fits_broadcast(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure a table against the broadcast limits, reading at most ``max_rows + 1`` rows."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns),
        F.lit(16),
    )
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def lookup_join(left: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of a large table with a codebook-like table.

    A lookup made of rows the driver already holds is broadcast. Any other is computed
    once into files (unless it is a pinned table) and its rows and bytes are counted there (the planner's estimate is
    of compressed size and not trusted): below the limits it is broadcast, so that the
    large side is not shuffled; above them it becomes an ordinary shuffle join, where
    adaptive execution splits skewed partitions.
    """
    if is_local(lookup):
        small = True
    else:
        lookup = lookup if is_pinned(lookup) else pin(lookup)
        small = fits_broadcast(lookup)
    return null_safe_join(left, F.broadcast(lookup) if small else lookup, keys, how)
