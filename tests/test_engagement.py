import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from syllabix.operators import engagement


def views(spark, rows):
    """(student, chapter, page, time, complete) in file order, one class."""
    df = spark.createDataFrame(
        [(0, 1, s, c, f"Chapter {c}", p, t, done, o, "b", "r") for o, (s, c, p, t, done) in enumerate(rows)],
        "institution_id int, class_id int, student_id int, chapter_num int, chapter string, page string, dt_accessed string, "
        "was_complete string, ord int, book string, release string",
    )
    return engagement.parse_access_time(df)


def test_access_times(spark):
    df = views(spark, [(1, 1, " a ", "2024-01-01 00:00:01", "true"), (1, 1, "b", "2024-01-01 00:00:01.5", "true"),
                       (1, 1, "c", "2024-01-01 00:00:01.123456", "true"), (1, 1, "d", "yesterday", "true")])
    got = [(r.page, r.dt_accessed_processed_ms) for r in df.orderBy("ord").collect()]
    assert got == [("a", 1704067201000.0), ("b", 1704067201500.0), ("c", 1704067201123.456), ("d", None)]


def test_first_completion_takes_the_earliest_then_file_order(spark):
    df = views(spark, [(1, 1, "a", "bad", "true"), (1, 1, "a", "2024-01-01 00:00:05", "true"),
                       (1, 1, "a", "2024-01-01 00:00:05", "true"), (1, 1, "a", "2024-01-01 00:00:01", "false")])
    assert [r.ord for r in engagement.first_completion(df).collect()] == [1]


def test_progress_and_summary(spark):
    df = views(spark, [(1, 1, "b", "2024-01-01 00:00:05", "true"), (1, 1, "a", "2024-01-01 00:00:05", "true"),
                       (2, 1, "c", "2024-01-01 00:00:01", "true"), (2, 1, "a", "2024-01-01 00:00:02", "true"),
                       (2, 1, "a", "2024-01-01 00:00:03", "true"), (2, 2, "x", "2024-01-01 00:00:09", "true")])
    progress = engagement.running_progress(engagement.first_completion(df))
    got = {(r.student_id, r.page): (r.pages_complete_so_far, r.proportion_pages_complete_so_far) for r in progress.collect()}
    assert got[(1, "a")] == (1, 1 / 3) and got[(1, "b")] == (2, 2 / 3) and got[(2, "c")] == (1, 1 / 3)
    last = progress.groupBy("student_id", "chapter_num").agg(
        F.max("pages_complete_so_far").alias("m"), F.max("total_unique_pages_complete_student").alias("t"))
    assert all(r.m == r.t for r in last.collect())
    summary = engagement.engagement_summary(progress).collect()
    assert len(summary) == 3 and all(0 < r.proportion_pages_complete_student <= 1 for r in summary)


def firsts(spark, students=12, pages=9):
    rows = [(s, 1 + p % 2, f"p{p}", f"2024-01-01 00:00:{p:02d}", "true") for s in range(students) for p in range(pages) if (s * 7 + p * 3) % 5 > 1]
    return engagement.first_completion(views(spark, rows))


def test_halves_are_balanced_and_repeatable(spark):
    first = firsts(spark)
    halves = engagement.split_half_assign(first, 20, 7)
    sizes = halves.groupBy("iter").pivot("split", [1, 2]).count().collect()
    assert len(sizes) == 20 and all(r["1"] - r["2"] == 1 for r in sizes)
    again = engagement.split_half_assign(first.repartition(7), 20, 7)
    assert halves.exceptAll(again).count() == 0
    assert engagement.split_half_assign(first, 20, 8).exceptAll(halves).count() > 0


def test_scores_match_pandas(spark):
    first = firsts(spark)
    halves = engagement.split_half_assign(first, 5, 7)
    got = engagement.split_half_scores(first, halves).toPandas().set_index(["iter", "student_id"]).sort_index()
    joined = first.toPandas().merge(halves.toPandas(), on=["class_id", "chapter_num", "page"])
    share = joined.groupby(["iter", "student_id", "split"]).agg(n=("page", "size"), total=("split_total", "first"))
    wide = (share.n / share.total).unstack("split").sort_index()
    assert np.allclose(got["half_1"], wide[1], equal_nan=True) and np.allclose(got["half_2"], wide[2], equal_nan=True)


def test_a_title_repeated_in_another_chapter_belongs_to_no_half(spark):
    first = engagement.first_completion(views(spark, [
        (1, 1, "same", "2024-01-01 00:00:01", "true"), (1, 2, "other", "2024-01-01 00:00:02", "true"),
        (2, 2, "same", "2024-01-01 00:00:03", "true")]))
    scores = engagement.split_half_scores(first, engagement.split_half_assign(first, 3)).collect()
    assert len(scores) == 6
    assert all(r.half_1 is None and r.half_2 is None for r in scores if r.student_id == 2)


def test_reliability_matches_pandas(spark):
    scores = pd.DataFrame({"iter": 1, "half_1": [0.2, 0.4, 0.4, 0.9, 1.0, None], "half_2": [0.1, 0.5, 0.3, 0.3, 1.0, 0.4]})
    got = engagement.split_half_reliability(
        spark.createDataFrame(scores.astype(object).where(scores.notna(), None).values.tolist(), "iter int, half_1 double, half_2 double")
    ).first()
    full = scores.dropna()
    assert got.n == 5
    assert np.isclose(got.pearson, full.half_1.corr(full.half_2))
    assert np.isclose(got.spearman, full.half_1.rank().corr(full.half_2.rank()))
    assert np.isclose(got.spearman_brown, 2 * got.pearson / (1 + got.pearson))


def test_reliability_without_variance_is_missing(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2), (1, 0.1, 0.7)], "iter int, half_1 double, half_2 double")
    got = engagement.split_half_reliability(df).first()
    assert got.pearson is None and got.spearman is None and got.spearman_brown is None


def test_interval_summary_interpolates(spark):
    values = np.arange(1, 101) ** 1.5
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = engagement.interval_summary(df, ["x"]).first()
    assert np.allclose([got["mean"], got.lb, got.ub], [values.mean(), *np.quantile(values, [0.025, 0.975])])


def test_a_missing_student_does_not_place_a_page(spark):
    first = spark.createDataFrame(
        [(1, 1, None, 1, "p"), (1, 1, "a", 2, "p"), (1, 1, "b", 3, "p")],
        "institution_id int, class_id int, student_id string, chapter_num int, page string")
    assert {r.chapter_num for r in engagement.split_half_assign(first, 2).collect()} == {2}


def test_scores_have_as_many_iterations_as_the_halves(spark):
    first = spark.createDataFrame(
        [(1, 1, "a", 2, "p"), (1, 1, "a", 2, "q"), (1, 1, "b", 9, "p")],
        "institution_id int, class_id int, student_id string, chapter_num int, page string")
    scores = engagement.split_half_scores(first, engagement.split_half_assign(first.filter("chapter_num = 2"), 7)).collect()
    assert len(scores) == 14 and all(r.half_1 is None and r.half_2 is None for r in scores if r.student_id == "b")


def test_ranks_by_windows_and_by_joins_are_the_same(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(a), float(b), int(w)) for i in (1, 2) for a in range(6) for b, w in zip(rng.integers(0, 9, 5), rng.integers(1, 99, 5))]
    pairs = spark.createDataFrame(rows, "iter int, half_1 double, half_2 double, w bigint").groupBy("iter", "half_1", "half_2").agg({"w": "sum"}) \
        .withColumnRenamed("sum(w)", "w")
    frames = [f(pairs).toPandas().sort_values(["iter", "half_1", "half_2"]) for f in (engagement._window_ranks, engagement._joined_ranks)]
    columns = ["iter", "half_1", "half_2", "rank_1", "rank_2", *[f"_mean_{c}" for c in engagement.MEASURED]]
    assert np.allclose(frames[0][columns].astype(float), frames[1][columns].astype(float))


def test_reliability_pins_nothing_but_the_pairs(spark, monkeypatch):
    pinned, pin = [], engagement.pin
    monkeypatch.setattr(engagement, "pin", lambda df: pinned.append(1) or pin(df))
    monkeypatch.setattr("syllabix.functions.joins.pin", lambda df: pinned.append(2) or pin(df))
    df = spark.createDataFrame([(1, 0.1, 0.2), (1, 0.3, 0.7)], "iter int, half_1 double, half_2 double")
    plan = engagement.split_half_reliability(df)._jdf.queryExecution().optimizedPlan().toString()
    assert pinned == [1] and "Join" not in plan
