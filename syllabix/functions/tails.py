"""Tail probabilities of the t, F and chi-squared distributions, for result rows only.

The incomplete beta function is evaluated by its continued fraction, the
incomplete gamma function by series or continued fraction (Press et al.,
Numerical Recipes, chapter 6).
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), _TINY) * np.sign(1 - (a + b) * x / (a + 1) or 1)
    h = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * np.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if not df > 0 or t != t:
        return float("nan")
    return 0.0 if np.isinf(t) else beta_lower(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if not (df1 > 0 and df2 > 0) or f != f:
        return float("nan")
    return 1.0 if f <= 0 else beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    """P(chi-squared > x)."""
    if not df > 0 or x != x:
        return float("nan")
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = exp(a * log(z) - z - lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b, c = z + 1 - a, 1 / _TINY
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_quantile(p: float, df: float) -> float:
    """The value t with P(T <= t) = p, for p > 0.5, by bisection."""
    if not df > 0:
        return float("nan")
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if t_two_sided(mid, df) > 2 * (1 - p):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _columnwise(function, *columns: pd.Series) -> pd.Series:
    values = [function(*row) if all(v == v for v in row) else None for row in zip(*[c.astype(float) for c in columns])]
    return pd.Series([None if v is None or v != v else v for v in values], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _columnwise(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _columnwise(f_upper, f, df1, df2)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _columnwise(chi2_upper, x, df)


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return _columnwise(t_quantile, p, df)
