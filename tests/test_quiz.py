from pyspark.sql import functions as F

from syllabix.functions.text import count_tuples
from syllabix.operators import quiz


def test_page_numbers_follow_the_rules_and_their_defects(spark):
    titles = {"7.1 T": 1, "7.2 T": 2, "7.10 T": 10, "7.14 T": 14, "7.18 T": 18, "7.19 T": 1.9, "7.20 T": 2}
    df = spark.createDataFrame([("r", "b", "Chapter 7", t) for t in titles] * 2 + [("r", "b", "Chapter 7", "Intro"), ("r", "b", "Appendix", "7.1 T")],
                               "release string, book string, chapter string, page string")
    got = {r.page: round(r.page_num, 6) for r in quiz.derive_page_numbers(df).collect()}
    assert got == titles


def test_long_titles_are_truncated_before_parsing(spark):
    df = spark.createDataFrame([("r", "b", "Chapter 1", "Page  1.2 of many"), ("r", "b", "Chapter 1", "1.2 Topic")],
                               "release string, book string, chapter string, page string")
    assert [r.page for r in quiz.derive_page_numbers(df).collect()] == ["1.2 Topic"]


def answers(spark):
    page = "1.11 Review Questions "
    rows = [(1, "q1", 1.0, 1.0), (1, "q2", None, 1.0), (1, "q2", 0.0, None), (2, "q3", 1.0, 1.0)]
    return spark.createDataFrame(
        [("b", "r", 0, 7, s, "Chapter 1", page, "mcq", q, e, p) for s, q, e, p in rows]
        + [("b", "r", 0, 7, 2, "Chapter 1", page, "plaintext", "q9", 1.0, 1.0)],
        "book string, release string, institution_id int, class_id int, student_id int, chapter string, page string, "
        "lrn_type string, lrn_question_reference string, points_earned double, points_possible double",
    )


def pages(spark):
    return spark.createDataFrame(
        [("b", "r", "Chapter 1", 1, "1.11 Review Questions", 11, 4, 1), ("b", "r", "Chapter 1", 1, "1.12 Review Questions 2", 12, 6, 0)],
        "book string, release string, chapter string, chapter_num int, page string, page_num int, mcq int, plaintext int",
    )


def test_score_against_the_codebook(spark):
    review = quiz.select_review(answers(spark))
    got = {r.student_id: r for r in quiz.score_quiz_codebook(review, pages(spark), quiz.codebook_totals(pages(spark))).collect()}
    assert (got[1].questions_submitted, got[1].n_correct, got[1].n_attempted, got[1].n_total, got[1].eoc_score) == (3, 1.0, 2.0, 10.0, 0.1)


def test_score_without_a_total_is_missing(spark):
    totals = quiz.codebook_totals(pages(spark)).filter("mcq < 0")
    got = quiz.score_quiz_codebook(quiz.select_review(answers(spark)), pages(spark), totals).collect()
    assert [r.eoc_score for r in got] == [None, None]


def test_score_against_questions_seen_in_class(spark):
    got = {r.student_id: r for r in quiz.score_quiz_observed(quiz.select_review(answers(spark)), pages(spark)).collect()}
    assert (got[1].n_total, got[2].eoc_score) == (3.0, 1 / 3)


def test_unknown_pages_keep_a_missing_chapter_number(spark):
    unknown = pages(spark).filter("mcq < 0")
    got = quiz.score_quiz_observed(quiz.select_review(answers(spark)), unknown).collect()
    assert len(got) == 2 and all(r.chapter_num is None and r.n_total == 3.0 for r in got)


def test_distinct_questions_of_a_hot_class_are_counted_in_two_levels(spark):
    hot = spark.range(30_000, numPartitions=6).selectExpr("IF(id % 3 = 0, 'hot', concat('c', id % 90)) AS class_id", "id % 5000 AS question")
    counted = hot.groupBy("class_id").agg(count_tuples("question").alias("n"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    # Values meet by class and value, and only their counts meet by class.
    first = plan.rindex("Exchange hashpartitioning(class_id")
    assert plan.count("Exchange hashpartitioning(class_id") == 2 and "struct" in plan[first : first + 160]
    spread = hot.distinct().repartition(8, "class_id", "question").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert spread.max() < 2 * spread.median()
    assert counted.filter("class_id = 'hot'").first().n == len({i % 5000 for i in range(0, 30_000, 3)})
