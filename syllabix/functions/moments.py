"""One-pass moments from which the linear and mixed models are solved.

Vectors are laid out as the columns given, matrices as their upper triangle in
row order (0,0), (0,1) ... (1,1) ...
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def full_matrix(packed, k: int) -> np.ndarray:
    """Symmetric k x k matrices from packed triangles (last axis)."""
    packed = np.asarray(packed, dtype=float)
    out = np.empty((*packed.shape[:-1], k, k))
    for at, (i, j) in enumerate(triangle(k)):
        out[..., i, j] = out[..., j, i] = packed[..., at]
    return out


def complete_cases(df: DataFrame, cols: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The model's columns as doubles, for rows where all of them are present."""
    return df.select(*also, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=list(cols))


def moment_columns(cols: Sequence[str]) -> list[Column]:
    """Row count ``n``, means ``m_i`` and within-group sums of products ``s_i_j``.

    Covariance aggregates update means and products together, which keeps columns
    far from zero accurate.
    """
    rows = F.count(F.lit(1))
    return [
        rows.alias("n"),
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[(F.covar_pop(cols[i], cols[j]) * rows).alias(f"s_{i}_{j}") for i, j in triangle(len(cols))],
    ]


def moment_arrays(k: int) -> list[Column]:
    return [
        F.array(*[f"m_{i}" for i in range(k)]).alias("means"),
        F.array(*[f"s_{i}_{j}" for i, j in triangle(k)]).alias("products"),
    ]


def fold_by_size(groups: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Summarise groups of equal size: the model needs a group only through its size.

    With N rows there are fewer than sqrt(2N) distinct sizes, which bounds the
    result however many groups there are.
    """
    parts = [F.count(F.lit(1)).cast("double").alias("groups")]
    parts += [F.avg(f"m_{i}").alias(f"a_{i}") for i in range(k)]
    parts += [F.covar_pop(f"m_{i}", f"m_{j}").alias(f"b_{i}_{j}") for i, j in triangle(k)]
    parts += [F.sum(f"s_{i}_{j}").alias(f"w_{i}_{j}") for i, j in triangle(k)]
    return groups.groupBy(*by, F.col("n").cast("double").alias("n")).agg(*parts).select(
        *by, "n", "groups",
        F.array(*[f"a_{i}" for i in range(k)]).alias("centre"),
        F.array(*[f"b_{i}_{j}" for i, j in triangle(k)]).alias("between"),
        F.array(*[f"w_{i}_{j}" for i, j in triangle(k)]).alias("within"),
    )
