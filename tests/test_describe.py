import numpy as np
import pytest

from syllabix.operators import describe


def table(spark, n=60, seed=1):
    random = np.random.default_rng(seed)
    a = random.normal(size=n)
    data = np.column_stack([a, a + random.normal(size=n), random.normal(size=n)])
    return data, spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")


def test_correlations_match_numpy(spark):
    data, df = table(spark)
    want = np.corrcoef(data.T)
    for r in describe.correlation_matrix(df, ["a", "b", "c"]).collect():
        i, j = "abc".index(r.var_i), "abc".index(r.var_j)
        assert np.isclose(r.r, want[i, j])
        assert np.isclose(r.t, r.r * np.sqrt(58 / (1 - r.r**2)))
        assert r.p <= r.p_holm <= 1


def test_holm_steps(spark):
    _, df = table(spark)
    p = sorted((r.p, r.p_holm) for r in describe.correlation_matrix(df, ["a", "b", "c"]).collect())
    want, top = [], 0.0
    for k, (raw, _) in enumerate(p):
        top = max(top, min(1.0, raw * (3 - k)))
        want.append(top)
    assert np.allclose([h for _, h in p], want)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    got = describe.correlation_matrix(df, ["a", "b"]).first()
    assert (got.n, got.r, got.p, got.p_holm) == (2, None, None, None)


def test_full_table_has_raw_p_below_and_adjusted_above(spark):
    _, df = table(spark)
    pairs = describe.correlation_matrix(df, ["a", "b", "c"])
    raw = {(r.var_i, r.var_j): r for r in pairs.collect()}
    cells = {(r.var_i, r.var_j): r.p for r in describe.full_correlation_table(pairs, ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells[("a", "a")] == 0.0
    assert cells[("a", "c")] == raw[("a", "c")].p_holm and cells[("c", "a")] == raw[("a", "c")].p


def test_shares_count_missing_and_sort(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "g string")
    got = [(r.g, r["count"], r.total_count, r.percentage) for r in describe.category_share(df, "g").collect()]
    assert got == [("x", 2, 4, 50.0), ("y", 1, 4, 25.0), (None, 1, 4, 25.0)]


def test_model_frame_excludes_ids_and_incomplete_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 2.0)], "s int, v double")
    assert [r.s for r in describe.model_frame(df, ["s", "v"], {"s": [4]}).collect()] == [1]
    assert describe.model_frame(df, ["s", "v"], drop_missing=False).count() == 4


def test_entity_average_keeps_the_first_row(spark):
    df = spark.createDataFrame([(1, 3, "late", 1.0), (1, 1, "early", None), (1, None, "none", 2.0)], "s int, ch int, tag string, v double")
    got = describe.entity_average(df, ["s"], {"avg": "v"}, ["ch"]).first()
    assert (got.tag, got.ch, got.avg) == ("early", 1, 1.5)


def kernel(x, grid, adjust):
    bw = adjust * 0.9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * len(x) ** -0.2
    return np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("cells,tolerance", [(1024, 1e-4), (60, 2e-2)])
def test_density_matches_the_kernel_sum(spark, cells, tolerance):
    x = np.random.default_rng(5).beta(2, 3, size=150)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("g", None), ("g", 7.0)], "grp string, x double")
    got = describe.density_by_group(df, "x", "grp", 1.5, (0.0, 1.0), 101, cells=cells).orderBy("grid_index").toPandas()
    want = kernel(x, np.linspace(0, 1, 101), 1.5)
    assert np.allclose(got["x"], np.linspace(0, 1, 101))
    assert np.allclose(got["density"], want, rtol=tolerance, atol=tolerance)


def test_density_of_a_group_does_not_depend_on_others(spark):
    small = [("s", v / 7) for v in range(8)]
    big = [("b", v / 9999) for v in range(10_000)]
    alone, beside = (
        describe.density_by_group(spark.createDataFrame(rows, "grp string, x double"), "x", "grp", 1.0, (0.0, 1.0), 21)
        .filter("grp = 's'").orderBy("grid_index").toPandas()["density"] for rows in (small, small + big)
    )
    assert np.allclose(alone, beside, rtol=1e-12)


def test_density_of_a_constant_group(spark):
    df = spark.createDataFrame([("g", 0.5)] * 4 + [("h", 0.1), ("h", 0.9)], "grp string, x double")
    got = describe.density_by_group(df, "x", "grp", n_grid=5).filter("grp = 'g'").toPandas()
    assert np.isfinite(got["density"]).all() and (got["density"] > 0).all()


def test_trend_matches_polyfit(spark):
    data, df = table(spark)
    got = describe.trend_by_group(df, ["a", "c"], "b", n_grid=11).toPandas()
    for k, name in ((0, "a"), (2, "c")):
        rows = got[got.construct_variable == name].sort_values("grid_index")
        slope, intercept = np.polyfit(data[:, k], data[:, 1], 1)
        assert np.allclose(rows["fit"], intercept + slope * rows["x"])
        assert np.allclose(rows["upper"] - rows["fit"], 2.0017174830120923 * rows["se"])


def test_row_mean_and_assessment(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1)], "student_id int, avg double")
    grades = spark.createDataFrame([(1, 0.7), (2, 0.3), (3, None)], "student_id int, quiz_mean double")
    got = describe.row_mean(describe.attach_assessment(df, grades), ["avg", "quiz_mean"], "m").collect()
    assert {r.student_id: r.m for r in got} == {1: pytest.approx(0.6), 2: 0.3}
    assert describe.row_mean(spark.createDataFrame([(None, None)], "a double, b double"), ["a", "b"], "m").first().m is None


def test_several_gradebook_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "student_id string, x double")
    grades = spark.createDataFrame([("a", 0.1, 0.2, 0.3), ("b", 0.4, 0.5, None)],
                                   "student_id string, quiz_1_prop double, reali_prop double, quiz_mean double")
    got = describe.attach_assessment(df, grades, ["quiz_1_prop", "reali_prop", "quiz_mean"]).collect()
    assert [(r.student_id, r.quiz_1_prop, r.reali_prop) for r in got] == [("a", 0.1, 0.2)]


def test_condition_frame(spark):
    df = spark.createDataFrame([("mid", 1, "A", 1.0), ("mid", 2, "C", 1.0), ("mid", 3, "B", None), ("post", 4, "A", 1.0)],
                               "source string, student_id int, module_variation string, y double")
    got = describe.condition_frame(df, {"y": "q_y"}, source="mid").collect()
    assert [(r.student_id, r.q_y) for r in got] == [(1, 1.0)]


def test_labels_left_join_to_entities(spark):
    people = spark.createDataFrame([(1, 1), (1, 2), (1, 1)], "class_id int, student_id int")
    labels = spark.createDataFrame([(1, 1, "gender", "Male"), (1, 1, "gender", "Female"), (1, 1, "year", "Junior")],
                                   "class_id int, student_id int, variable_name string, response_label string")
    got = {r.student_id: (r.gender, r.year) for r in describe.widen_labels(people, labels, ["gender", "year"]).collect()}
    assert got == {1: ("Male", "Junior"), 2: (None, None)}
