"""Linear and random-intercept models, and the tests comparing them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.functions.mixed import FoldedMoments
from syllabix.functions.moments import complete_cases, fold_by_size, full_matrix, moment_arrays, moment_columns
from syllabix.functions.tails import chi2_p_value, f_p_value, t_critical, t_p_value, t_two_sided
from syllabix.operators.describe import pearson

OLS_SCHEMA = (
    "model string, term string, estimate double, std_error double, t_value double, p_value double, "
    "n bigint, df_residual bigint, rss double"
)
MIXED_SCHEMA = (
    "model string, term string, estimate double, std_error double, n bigint, n_params bigint, theta double, "
    "sigma double, group_sd double, log_likelihood double, aic double"
)


def _union(specs: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(x for xs in specs.values() for x in xs))


def ols_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: n, means and centred sums of products over complete cases."""
    return complete_cases(df, cols).agg(*moment_columns(cols)).select("n", *moment_arrays(len(cols)))


def fit_ols_sweep(df: DataFrame, y: str, specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Least-squares fits of several predictor sets on the same rows, from one moment pass.

    One row per model and term. Rows missing any column of any set are left out.
    Redundant predictors get the minimum-norm solution and do not use up degrees of
    freedom.
    """
    xs = _union(specs)
    k = len(xs) + 1
    order = {name: [xs.index(x) for x in chosen] for name, chosen in specs.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.n > 0:
                    yield _ols_rows(row, k, xs, order)

    return ols_moments(df, [*xs, y]).mapInPandas(solve, OLS_SCHEMA)


def _ols_rows(row, k: int, xs: list[str], specs: Mapping[str, list[int]]) -> pd.DataFrame:
    mean = np.asarray(row.means, dtype=float)
    products = full_matrix(row.products, k)
    scale = np.sqrt(np.where(np.diag(products) > 0, np.diag(products), 1.0))
    unit = products / np.outer(scale, scale)
    out = []
    for name, use in specs.items():
        xx, xy = unit[np.ix_(use, use)], unit[use, -1]
        inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) if use else np.zeros((0, 0))
        rank = int(np.linalg.matrix_rank(xx, hermitian=True)) if use else 0
        beta = inverse @ xy
        rss = max(float(unit[-1, -1] - xy @ beta), 0.0) * scale[-1] ** 2
        df = int(row.n) - 1 - rank
        variance = rss / df if df > 0 else float("nan")
        slope = beta * scale[-1] / scale[use]
        slope_cov = inverse / np.outer(scale[use], scale[use]) * variance
        intercept = mean[-1] - mean[use] @ slope
        intercept_var = variance / row.n + mean[use] @ slope_cov @ mean[use]
        estimates = [intercept, *slope]
        errors = np.sqrt(np.maximum([intercept_var, *np.diag(slope_cov)], 0))
        for term, estimate, error in zip(["(Intercept)", *[xs[i] for i in use]], estimates, errors):
            t = estimate / error if error > 0 else None
            p = t_two_sided(t, df) if t is not None else None
            out.append((name, term, estimate, error, t, p, int(row.n), df, rss))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OLS_SCHEMA.split(", ")])


def fit_ols(df: DataFrame, y: str, xs: Sequence[str], model: str = "model") -> DataFrame:
    """Least squares with intercept; one row per term."""
    return fit_ols_sweep(df, y, {model: xs})


def arm_indicator(df: DataFrame, arm: str, level: str, out: str) -> DataFrame:
    """A two-level factor as 0/1, 1 marking ``level``."""
    return df.withColumn(out, (F.col(arm) == level).cast("double"))


def nested_f_test(fits: DataFrame, smaller: str, larger: str) -> DataFrame:
    """F test of two nested least-squares fits of ``fit_ols_sweep``."""

    def of(model: str, column: str):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    sides = fits.agg(
        of(smaller, "rss").alias("rss0"), of(larger, "rss").alias("rss1"),
        of(smaller, "df_residual").alias("df0"), of(larger, "df_residual").alias("df1"),
    )
    between = F.try_divide(F.col("rss0") - F.col("rss1"), F.col("df0") - F.col("df1"))
    return (
        sides.withColumn("f_value", F.try_divide(between, F.try_divide("rss1", "df1")))
        .select(
            F.lit(smaller).alias("model_0"), F.lit(larger).alias("model_1"), "rss0", "rss1",
            (F.col("df0") - F.col("df1")).alias("df_model"), F.col("df1").alias("df_residual"), "f_value",
        )
        .withColumn("p_value", f_p_value("f_value", F.col("df_model").cast("double"), F.col("df_residual").cast("double")))
    )


def correlation_test(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    """Pearson correlation with t, df, two-sided p and Fisher-z interval, as one row."""
    normal_quantile = NormalDist().inv_cdf(0.5 + level / 2)
    pair = (F.col(y).cast("double"), F.col(x).cast("double"))
    moments = df.agg(
        F.regr_count(*pair).alias("n"), F.regr_sxx(*pair).alias("sxx"),
        F.regr_syy(*pair).alias("syy"), F.regr_sxy(*pair).alias("sxy"),
    )
    r = F.col("r")
    half = F.when(F.col("n") > 3, F.lit(normal_quantile) / F.sqrt(F.col("n") - 3))
    z = F.when(F.abs(r) < 1, F.atanh(r))
    return (
        moments.withColumn("r", pearson(F.col("sxy"), F.col("sxx"), F.col("syy")))
        .withColumn("df", F.col("n") - 2)
        .withColumn("t", F.when(F.col("df") > 0, F.try_divide(r * F.sqrt("df"), F.sqrt(1 - r * r))))
        .select(
            F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "r", "t", "df",
            t_p_value("t", F.col("df").cast("double")).alias("p"),
            F.tanh(z - half).alias("lower"), F.tanh(z + half).alias("upper"),
        )
    )


def predicted_means(df: DataFrame, arm: str, y: str, level: float = 0.95) -> DataFrame:
    """Prediction of ``y ~ arm`` per arm with interval, beside the observed mean.

    The model has one mean per arm and a residual variance pooled over arms.
    """
    groups = df.select(F.col(arm).alias("arm"), F.col(y).cast("double").alias("y")).na.drop().groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("predicted"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("_ss"),
    )
    # One row per arm: the arms are listed once in the model's design.
    pooled = groups.agg(
        F.sum("_ss").alias("_rss"), (F.sum("n") - F.count(F.lit(1))).cast("double").alias("_df"),
        F.collect_list(F.struct("arm", "n", "predicted")).alias("_arms"),
    ).select("_rss", "_df", F.inline("_arms"))
    error = F.sqrt(F.try_divide("_rss", F.nullif(F.col("_df"), F.lit(0.0))) / F.col("n"))
    margin = t_critical(F.lit(0.5 + level / 2), F.col("_df")) * F.col("std_error")
    return pooled.withColumn("std_error", error).select(
        F.col("arm").alias(arm), "n", "predicted", "std_error",
        (F.col("predicted") - margin).alias("lower"), (F.col("predicted") + margin).alias("upper"),
        F.col("predicted").alias("sample_avg"),
    )


def intercept_moments(df: DataFrame, y: str, xs: Sequence[str], group: str) -> DataFrame:
    """Moments per group, folded by group size (see ``fold_by_size``)."""
    cols = [*xs, y]
    groups = complete_cases(df, cols, also=[group]).groupBy(group).agg(*moment_columns(cols))
    return fold_by_size(groups, len(cols))


def mixed_rows(pdf: pd.DataFrame, xs: list[str], specs: Mapping[str, list[int]]) -> list[tuple]:
    """All fits of one set of folded moments, one tuple per model and term."""
    moments = FoldedMoments(pdf, len(xs) + 1)
    out = []
    for name, use in specs.items():
        fit = moments.fit(use)
        shared = (fit["n"], fit["rank"] + 2, fit["theta"], fit["sigma"], fit["group_sd"], fit["log_likelihood"], fit["aic"])
        for term, estimate, error in zip(["(Intercept)", *[xs[i] for i in use]], fit["estimate"], fit["std_error"]):
            out.append((name, term, float(estimate), float(error), *shared))
    return out


def model_sweep(df: DataFrame, y: str, group: str, specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Random-intercept fits of several predictor sets on the same rows.

    One moment pass over the union of columns serves every set; what the solver
    sees has one row per distinct group size. One result row per model and term;
    ``n_params`` counts fixed effects and the two variances.
    """
    xs = _union(specs)
    order = {name: [xs.index(x) for x in chosen] for name, chosen in specs.items()}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(mixed_rows(pdf, xs, order), columns=[c.split()[0] for c in MIXED_SCHEMA.split(", ")])

    return intercept_moments(df, y, xs, group).groupBy(F.lit("all")).applyInPandas(solve, MIXED_SCHEMA)


def fit_random_intercept(df: DataFrame, y: str, xs: Sequence[str], group: str, model: str = "model") -> DataFrame:
    """Linear mixed model ``y ~ xs + (1 | group)`` by maximum likelihood; one row per term."""
    return model_sweep(df, y, group, {model: xs})


def likelihood_ratio_test(fits: DataFrame, smaller: str, larger: str) -> DataFrame:
    """Likelihood-ratio test of two nested fits of ``model_sweep``."""

    def of(model: str, column: str):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    sides = fits.agg(
        of(smaller, "log_likelihood").alias("ll0"), of(larger, "log_likelihood").alias("ll1"),
        (of(larger, "n_params") - of(smaller, "n_params")).alias("df"),
    )
    return (
        sides.withColumn("chisq", 2 * (F.col("ll1") - F.col("ll0")))
        .withColumn("chisq", F.when(F.col("chisq") < 0, 0.0).otherwise(F.col("chisq")))
        .withColumn("p_value", chi2_p_value("chisq", F.col("df").cast("double")))
        .select(F.lit(smaller).alias("model_0"), F.lit(larger).alias("model_1"), "ll0", "ll1", "df", "chisq", "p_value")
    )


def relative_aic(fits: DataFrame, baseline: str) -> DataFrame:
    """AIC of every model minus the baseline's, one row per model."""
    return (
        fits.filter(F.col("term") == "(Intercept)")
        .agg(
            F.max(F.when(F.col("model") == baseline, F.col("aic"))).alias("_base"),
            F.collect_list(F.struct("model", "aic")).alias("_models"),
        )
        .select("_base", F.inline("_models"))
        .select("model", (F.col("aic") - F.col("_base")).alias("aic_value"))
    )
