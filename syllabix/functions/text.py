"""Small column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"


def strip(column: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(WHITESPACE))


def count_tuples(*columns: str) -> Column:
    """Distinct count of a tuple in which a missing value counts as a value."""
    return F.count_distinct(F.struct(*columns))


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean across columns of one row, skipping missing values."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, present)


def iterations(count: int) -> Column:
    """The list 1..count, one entry per resampling round."""
    return F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint"))
