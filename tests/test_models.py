import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabix.functions import tails
from syllabix.functions.mixed import FoldedMoments
from syllabix.operators import models, resample


def test_tails_at_known_points():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.f_upper(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(0.96, 3, 97) == pytest.approx(0.4150, abs=1e-3)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(40.04, 7) == pytest.approx(1.24e-6, rel=0.02)
    assert tails.chi2_upper(6.52, 7) == pytest.approx(0.48, abs=2e-3)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tails.chi2_upper(2.0, 4) == pytest.approx(np.exp(-1) * 2)


def grouped(spark, seed=2, sizes=(1, 1, 2, 5, 9, 9, 12, 20), spread=1.0):
    random = np.random.default_rng(seed)
    rows, at = [], 0
    for g, size in enumerate(sizes):
        shift = random.normal() * spread
        for _ in range(size):
            a, b = random.normal() + 100, random.normal() * 5
            rows.append((g, at, float(a), float(b), float(1 + 0.5 * a + shift + random.normal())))
            at += 1
    data = np.array(rows)
    df = spark.createDataFrame([(int(r[0]), int(r[1]), *map(float, r[2:])) for r in rows], "g int, s int, a double, b double, y double")
    return data, df


def dense_log_likelihood(data, columns, theta, estimate=None):
    """Multivariate normal likelihood with the group structure written out."""
    g, y = data[:, 0], data[:, 4]
    x = np.column_stack([np.ones(len(y)), *[data[:, c] for c in columns]])
    v = np.eye(len(y)) + theta**2 * (g[:, None] == g[None, :])
    inverse = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    resid = y - x @ beta
    sigma2 = resid @ inverse @ resid / len(y)
    _, log_det = np.linalg.slogdet(v)
    return -0.5 * (len(y) * np.log(2 * np.pi * sigma2) + log_det + len(y)), beta


def test_profile_matches_the_dense_likelihood(spark):
    data, df = grouped(spark)
    moments = FoldedMoments(models.intercept_moments(df, "y", ["a", "b"], "g").toPandas(), 3)
    for theta in (0.0, 0.3, 0.7, 2.0):
        want, _ = dense_log_likelihood(data, [2, 3], theta)
        assert moments.deviance(np.array([theta]), [0, 1])[0] == pytest.approx(-2 * want, rel=1e-10)


def test_fit_is_the_maximum(spark):
    data, df = grouped(spark)
    fit = {r.term: r for r in models.fit_random_intercept(df, "y", ["a", "b"], "g").collect()}
    top = fit["a"]
    grid = [dense_log_likelihood(data, [2, 3], t)[0] for t in np.linspace(0, 3, 600)]
    assert top.log_likelihood >= max(grid) - 1e-9
    want, beta = dense_log_likelihood(data, [2, 3], top.theta)
    assert top.log_likelihood == pytest.approx(want, rel=1e-10)
    assert np.allclose([fit["(Intercept)"].estimate, fit["a"].estimate, fit["b"].estimate], beta, rtol=1e-7)
    assert top.n_params == 5 and top.aic == pytest.approx(-2 * want + 10)


def test_boundary_fit_equals_least_squares(spark):
    data, df = grouped(spark, seed=4, spread=0.0)
    balanced = df.withColumn("g", F.col("s") % 3)
    # Residuals of the least-squares fit, mirrored from group to group: the groups differ less than by chance.
    mirrored = spark.createDataFrame(
        [(k % 3, float(k // 6), 2.0 * (k // 6) + (1.0 if (k // 3) % 2 else -1.0)) for k in range(60)], "g int, a double, y double")
    mixed = models.fit_random_intercept(mirrored, "y", ["a"], "g").collect()
    ols = {r.term: r.estimate for r in models.fit_ols(mirrored, "y", ["a"]).collect()}
    assert mixed[0].theta == 0 and all(r.estimate == pytest.approx(ols[r.term]) for r in mixed)
    moments = FoldedMoments(models.intercept_moments(balanced, "y", ["a"], "g").toPandas(), 2)
    rss = models.fit_ols(df, "y", ["a"]).first().rss
    n = len(data)
    assert moments.deviance(np.array([0.0]), [0])[0] == pytest.approx(n * np.log(2 * np.pi * rss / n) + n)


def test_sweep_is_nested_and_compared(spark):
    _, df = grouped(spark)
    fits = models.model_sweep(df, "y", "g", {"base": [], "a": ["a"], "ab": ["a", "b"]})
    ll = {r.model: r.log_likelihood for r in fits.collect()}
    assert ll["base"] <= ll["a"] <= ll["ab"]
    test = models.likelihood_ratio_test(fits, "base", "ab").first()
    assert test.df == 2 and test.chisq == pytest.approx(2 * (ll["ab"] - ll["base"]))
    assert test.p_value == pytest.approx(np.exp(-test.chisq / 2))
    rel = {r.model: r.aic_value for r in models.relative_aic(fits, "base").collect()}
    assert rel["base"] == 0 and rel["a"] == pytest.approx(2 - 2 * (ll["a"] - ll["base"]))


def test_redundant_predictors_are_flagged_not_fatal(spark):
    _, df = grouped(spark)
    doubled = df.withColumn("a2", F.col("a") * 2)
    mixed = {r.model: r for r in models.model_sweep(doubled, "y", "g", {"one": ["a"], "two": ["a", "a2"]}).collect()}
    assert mixed["two"].n_params == mixed["one"].n_params
    assert mixed["two"].log_likelihood == pytest.approx(mixed["one"].log_likelihood)
    ols = {r.model: r for r in models.fit_ols_sweep(doubled, "y", {"one": ["a"], "two": ["a", "a2"]}).collect()}
    assert ols["two"].df_residual == ols["one"].df_residual and ols["two"].rss == pytest.approx(ols["one"].rss)


def test_least_squares_matches_numpy(spark):
    data, df = grouped(spark)
    got = {r.term: r for r in models.fit_ols(df, "y", ["a", "b"]).collect()}
    x = np.column_stack([np.ones(len(data)), data[:, 2], data[:, 3]])
    beta, rss, *_ = np.linalg.lstsq(x, data[:, 4], rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(data) - 3))
    terms = ["(Intercept)", "a", "b"]
    assert np.allclose([got[t].estimate for t in terms], beta) and np.allclose([got[t].std_error for t in terms], se)
    assert got["a"].df_residual == len(data) - 3


def test_nested_f_equals_squared_t(spark):
    _, df = grouped(spark)
    fits = models.fit_ols_sweep(df, "y", {"a": ["a"], "ab": ["a", "b"]})
    test = models.nested_f_test(fits, "a", "ab").first()
    t = fits.filter("model = 'ab' AND term = 'b'").first()
    assert test.f_value == pytest.approx(t.t_value**2) and test.p_value == pytest.approx(t.p_value)


def test_correlation_test_interval(spark):
    data, df = grouped(spark)
    got = models.correlation_test(df, "a", "y").first()
    r = np.corrcoef(data[:, 2], data[:, 4])[0, 1]
    half = 1.959963984540054 / np.sqrt(len(data) - 3)
    assert got.r == pytest.approx(r) and got.df == len(data) - 2
    assert (got.lower, got.upper) == (pytest.approx(np.tanh(np.arctanh(r) - half)), pytest.approx(np.tanh(np.arctanh(r) + half)))


def test_predictions_match_the_dummy_model(spark):
    data, df = grouped(spark)
    arms = df.withColumn("arm", F.when(F.col("s") % 3 == 0, "A").otherwise("B"))
    got = {r.arm: r for r in models.predicted_means(arms, "arm", "y").collect()}
    fit = {r.term: r for r in models.fit_ols(models.arm_indicator(arms, "arm", "B", "b1"), "y", ["b1"]).collect()}
    assert got["A"].predicted == pytest.approx(fit["(Intercept)"].estimate)
    assert got["A"].std_error == pytest.approx(fit["(Intercept)"].std_error)
    assert got["B"].predicted == pytest.approx(fit["(Intercept)"].estimate + fit["b1"].estimate)
    margin = tails.t_quantile(0.975, len(data) - 2) * got["A"].std_error
    assert got["A"].upper == pytest.approx(got["A"].predicted + margin)


def test_resample_draws_as_many_as_the_class_has(spark):
    _, df = grouped(spark)
    weights = resample.stratified_resample(df, "g", "s", 30, 5)
    sizes = {r.g: r.n for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
    totals = weights.groupBy("iter", "g").agg(F.sum("w").alias("w")).collect()
    assert len(totals) == 30 * len(sizes) and all(r.w == sizes[r.g] for r in totals)
    hot = resample.stratified_resample(df, "g", "s", 30, 5, max_group_rows=4)
    assert hot.exceptAll(weights).count() == 0 and hot.count() == weights.count()


def test_bootstrap_equals_fitting_the_drawn_rows(spark):
    _, df = grouped(spark)
    specs = {"base": [], "ab": ["a", "b"]}
    aics = {(r["iter"], r.model): r.aic for r in resample.bootstrap_models(df, "y", "g", "s", specs, 4, 9).collect()}
    assert len(aics) == 8
    weights = resample.stratified_resample(df, "g", "s", 4, 9)
    for i in (1, 4):
        rows = df.join(weights.filter(F.col("iter") == i), ["g", "s"]).withColumn("w", F.explode(F.sequence(F.lit(1).cast("bigint"), "w")))
        direct = {r.model: r.aic for r in models.model_sweep(rows, "y", "g", specs).collect()}
        assert aics[(i, "base")] == pytest.approx(direct["base"]) and aics[(i, "ab")] == pytest.approx(direct["ab"])


def test_relative_and_summary(spark):
    aics = spark.createDataFrame([(i, m, float(v + i)) for i in (1, 2, 3) for m, v in (("base", 10), ("x", 7), ("z", 9))], "iter int, model string, aic double")
    rel = resample.bootstrap_relative(aics, ["base", "x", "z"], "base", "z", ["x"])
    assert rel.columns == ["iter", "rel_base", "rel_x", "rel_z", "z_rel_x"]
    actual = spark.createDataFrame([("base", 0.0), ("x", -3.5)], "model string, aic_value double")
    got = {r.model: (r["mean"], r.lb, r.ub, r.aic_value) for r in resample.transpose_summary(rel, actual).collect()}
    assert got == {"base": (0, 0, 0, 0.0), "x": (-3, -3, -3, -3.5), "z": (-1, -1, -1, None)}
