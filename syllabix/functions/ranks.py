"""Running totals and exact quantiles that survive groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join, null_safe_join, planned_bytes
from syllabix.session import pin

# Largest group one task may sort. A bigger group is cut into ordered ranges.
MAX_GROUP_ROWS = 5_000_000
# A table the planner puts below this fits one task whole: no group needs counting.
SMALL_TABLE_BYTES = 32 * 1024 * 1024
# Groups are first counted together in so many buckets.
GROUP_BUCKETS = 4096


def group_sizes(
    df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS, rows_of: Column | None = None,
) -> tuple[int, int]:
    """Rows of the largest group (or, up to ``max_group_rows``, a bound of them) and of the table.

    A row counts as ``rows_of`` (default 1). A small table counts as 0. Groups are hashed into
    buckets, which combine map-side whatever the number of groups; no group is larger than
    its bucket. Only if a bucket is above the limit are the groups counted one by one.
    """
    if max_group_rows >= MAX_GROUP_ROWS and planned_bytes(df) <= SMALL_TABLE_BYTES:
        return 0, 0
    amount = F.lit(1) if rows_of is None else rows_of
    counted = df.select(*keys, amount.cast("bigint").alias("_n"))
    for grouped in (counted.groupBy(F.pmod(F.xxhash64(*keys), F.lit(GROUP_BUCKETS))), counted.groupBy(*keys)):
        largest, rows = grouped.agg(F.sum("_n").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
        if (largest or 0) <= max_group_rows:
            break
    return largest or 0, rows or 0


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    out: str,
    weight: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Running sum of ``weight`` (or row number, if none) inside each group.

    ``order_by`` must order the rows of a group without ties. Unless the table is
    small, its largest group is counted first (``group_sizes``; a caller that has counted
    passes ``sizes``). If that fits one task this is a plain window. Otherwise rows are range-partitioned on keys and
    order, so that a hot group spans many partitions; each partition is summed on
    its own and shifted by the total of the partitions before it.
    """
    largest, rows = group_sizes(df, keys, max_group_rows) if sizes is None else sizes
    step = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    if largest <= max_group_rows:
        window = Window.partitionBy(*keys).orderBy(*order_by)
        if weight is None:
            return df.withColumn(out, F.row_number().over(window).cast("bigint"))
        return df.withColumn(out, F.sum(step).over(window.rowsBetween(Window.unboundedPreceding, 0)))

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * ceil(rows / max_group_rows))
    # The range boundaries come from a sample, so the partition number must be
    # written down before two branches of the plan may both rely on it.
    ranged = pin(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order_by).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum(step).alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    local = ranged.withColumn(out, F.sum(step).over(inside))
    return (
        null_safe_join(local, shifts, [*keys, "_part"])
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_part", "_before")
    )


def count_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probs: dict[str, float],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    ``counts`` has one row per group and distinct value, so neither a frequent value
    nor a large group has to fit one task. Positions come from cumulative counts.
    """
    placed = running_total(counts, keys, [F.col(value).asc()], "_upto", weight, max_group_rows)
    totals = counts.groupBy(*keys).agg(F.sum(weight).alias("_rows"))
    located = lookup_join(placed, totals, keys, "inner")

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col(value)))

    parts, result = [], []
    for name, p in probs.items():
        spot = (F.col("_rows") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_f_{name}"),
        ]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((low + (high - low) * F.col(f"_f_{name}")).alias(name))
    return located.groupBy(*keys).agg(*parts).select(*keys, *result)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``count_quantiles`` of plain rows, missing values left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return count_quantiles(counts, keys, value, "_n", probs, max_group_rows)
