from syllabix.operators import merge


def test_audit_reports_only_larger_groups(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None)], "s int, v string")
    assert {(r.s, r.nrows) for r in merge.uniqueness_audit(df, ["s", "v"]).collect()} == {(1, 3), (2, 2)}
    assert [r.s for r in merge.uniqueness_audit(df, ["s", "v"], max_rows=2).collect()] == [1]


def sets(spark):
    def of(*ids):
        return merge.entity_set(spark.createDataFrame([(1, i) for i in ids] * 2, "class_id int, student_id int"))

    return {"survey": of(1, 2, 3, None), "quiz": of(2, 3, 4), "engagement": of(3, 4, 5)}


def test_entity_set_writes_missing_parts(spark):
    assert {r.UID for r in sets(spark)["survey"].collect()} == {"1, 1", "1, 2", "1, 3", "1, NA"}


def test_overlap_sizes(spark):
    got = {r.comparison: r.n for r in merge.population_overlap(sets(spark)).collect()}
    assert got == {
        "survey": 4, "quiz": 3, "engagement": 3,
        "survey and quiz": 2, "survey not quiz": 2, "quiz not survey": 1,
        "survey and engagement": 1, "survey not engagement": 3, "engagement not survey": 2,
        "quiz and engagement": 2, "quiz not engagement": 1, "engagement not quiz": 1,
        "survey and quiz and engagement": 1,
    }


def test_count_entities_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int")
    assert merge.count_entities(df, "a", "b").first().n == 2
    assert merge.count_entities(df, "b").first().n == 2
    assert merge.count_entities(df, "a", also=spark.createDataFrame([(7,)], "a int")).first().n == 2


def items(spark):
    return spark.createDataFrame(
        [("r", "b", 0, 1, s, c, v) for s, c, v in [(1, "anx", 1.0), (1, "anx", None), (1, "val", 4.0), (2, "anx", None)]],
        "release string, book string, institution_id int, class_id int, student_id int, construct string, response_choice double",
    )


def test_means_skip_missing_and_counts_include_them(spark):
    got = {(r.student_id, r.construct): (r.construct_mean, r.construct_responses) for r in merge.construct_means(items(spark)).collect()}
    assert got == {(1, "anx"): (1.0, 2), (1, "val"): (4.0, 1), (2, "anx"): (None, 1)}


def test_wide_names(spark):
    wide = merge.widen_constructs(merge.construct_means(items(spark)), ["anx", "val"])
    assert wide.columns[5:] == ["construct_mean_anx", "construct_responses_anx", "construct_mean_val", "construct_responses_val"]
    got = {r.student_id: (r.construct_mean_val, r.construct_responses_val) for r in wide.collect()}
    assert got == {1: (4.0, 1), 2: (None, None)}


def test_merge_keeps_students_with_all_three_sources(spark):
    wide = merge.widen_constructs(merge.construct_means(items(spark)), ["anx"])
    keys = "release string, book string, institution_id int, class_id int, student_id int, chapter string, chapter_num int"
    engaged = spark.createDataFrame([("r", "b", 0, 1, 1, "C1", 1, 0.5), ("r", "b", 0, 1, 1, "C2", None, 0.7), ("r", "b", 0, 1, 9, "C1", 1, 1.0)], keys + ", share double")
    quiz = spark.createDataFrame([("r", "b", 0, 1, 1, "C1", 1, 0.9), ("r", "b", 0, 1, 1, "C2", None, 0.8)], keys + ", eoc_score double")
    got = {r.chapter: (r.share, r.eoc_score) for r in merge.merge_sources(wide, engaged, quiz).collect()}
    assert got == {"C1": (0.5, 0.9), "C2": (0.7, 0.8)}


def test_page_tables_differ_by_trailing_spaces(spark):
    from syllabix.plans import studies

    titles = spark.createDataFrame([("r", "b", "Chapter 2", "2.1 "), ("r", "b", "Chapter 2", "2.1")],
                                   "release string, book string, chapter string, page string")
    assert studies.quiz_pages(titles).count() == 2 and studies.view_pages(titles).count() == 1


def test_pinned_tables_are_deleted(spark):
    from pyspark.errors import PySparkException

    from syllabix.session import pin, pinned_tables

    with pinned_tables(spark):
        kept = pin(spark.range(5))
        assert kept.count() == 5
    try:
        left = spark.read.parquet(kept.inputFiles()[0]).count()
    except PySparkException:
        left = 0
    assert left == 0


def test_audits_share_one_scan_and_match_single_ones(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, None, "x"), (1, None, "x"), (None, "a", "y"), (2, "b", "x"), (2, "b", "y"), (2, "b", "y")]
    df = spark.createDataFrame(rows, "class_id int, student_id string, item string")
    audits = {"items": (["class_id", "student_id", "item"], 1), "students": (["class_id", "student_id"], 2),
              "students_any": (["student_id", "class_id"], 0), "classes": (["class_id"], 3)}
    got = merge.uniqueness_audits(df, audits)
    for name, (keys, most) in audits.items():
        want = {tuple(r) for r in merge.uniqueness_audit(df, keys, most).collect()}
        assert {(*[r[k] for k in keys], r.nrows) for r in got.filter(f"audit = '{name}'").collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ") <= 1


def test_bucketed_merge_moves_nothing_and_keeps_the_rows(spark, tmp_path):
    from syllabix.sources.tables import write_bucketed
    who = "release string, book string, institution_id int, class_id int, student_id string"
    students = [("r", "b", 1, c, s) for c in (1, 2, None) for s in ("x", "y", None)]
    survey = spark.createDataFrame([(*s, float(i)) for i, s in enumerate(students)], who + ", construct_mean double")
    engaged = spark.createDataFrame([(*s, ch, n, 0.5) for s in students for ch, n in (("c1", 1), ("c2", None), (None, 3))], who + ", chapter string, chapter_num int, share double")
    quiz = spark.createDataFrame([(*s, ch, n, 0.9) for s in students[:6] for ch, n in (("c1", 1), ("c2", None), ("c3", 3))], who + ", chapter string, chapter_num int, score double")
    want = merge.merge_sources(survey, engaged, quiz)
    parts = [write_bucketed(df, f"layout_{i}", merge.STUDENT, 4, str(tmp_path / str(i))) for i, df in enumerate((survey, engaged, quiz))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = merge.merge_bucketed(*parts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        rows = sorted(map(str, got.select(want.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted(map(str, want.collect())) and len(rows) == 12
    for i in range(3):
        spark.sql(f"DROP TABLE layout_{i}")


def test_in_both_matches_missing_keys_and_repeats_none(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, None), (2, "y")], "k int, v string")
    b = spark.createDataFrame([("x", None), ("x", 1), (None, None), (None, None), ("z", 2)], "v string, k int")
    got = [tuple(r) for r in merge.in_both(a, b, ["k", "v"]).collect()]
    assert len(got) == 3 and set(got) == {(1, "x"), (None, "x"), (None, None)}
    assert merge.in_both(a, b.limit(0), ["k", "v"]).count() == 0


def test_merged_students_need_no_measures(spark, monkeypatch):
    import random

    from syllabix.catalog.queries import CONSTRUCTS
    from syllabix.plans import studies
    from syllabix.plans.studies import OBSERVATIONAL

    rng = random.Random(7)
    who = "release string, book string, institution_id int, class_id int, student_id int"
    students = [("r1", "b1", rng.choice([1, 2]), c, s) for s in [*range(40), None] for c in (1, None)]

    def some(n):
        return [rng.choice(students) for _ in range(n)]

    answers = spark.createDataFrame(
        [(*s, i, "Pre_Survey_1", "mcq", f"Q{rng.randrange(4)}", "p", rng.choice(["null", "[]", '["1"]', '["1", "0"]', "?"])) for i, s in enumerate(some(150))],
        who + ", ord int, lrn_activity_reference string, lrn_type string, lrn_question_reference string, prompt string, response string")
    book = spark.createDataFrame(
        [("r1", "Pre_Survey_1", q, n, v, "p", "mcq", "a") for q, n, v in
         [("Q0", 1, "anx"), ("Q1", 1, " gender"), ("Q2", 1, "ma_prep_a"), ("Q2", 2, "ma_prep_b"), ("Q3", 2, "other")]],
        "release string, lrn_activity_reference string, lrn_question_reference string, `order` int, variable_name string, prompt string, lrn_type string, lrn_option_0 string")
    lookup = spark.createDataFrame([("anx", "anxiety_math", 6, False, "p")], "id string, construct string, scale_values int, scale_flipped boolean, question string")
    views = spark.createDataFrame(
        [(s[2], s[3], s[4], i, f"Chapter {c}", f"{c}.{rng.randrange(3)} Topic ", rng.choice(["2024-01-01 00:00:05", "bad", None]), rng.choice(["true", "false"]))
         for i, s in enumerate(some(200)) for c in [rng.randrange(1, 4)]],
        "institution_id int, class_id int, student_id int, ord int, chapter string, page string, dt_accessed string, was_complete string")
    classes = spark.createDataFrame([(i, c, "r1", "b1", 9) for i in (1, 2) for c in (1, None)], "institution_id int, class_id int, release string, book string, n_students int")
    pages = spark.createDataFrame([("r1", "b1", f"Chapter {c}", c, f"{c}.{p} Topic", p) for c in (1, 2) for p in range(3)],
                                  "release string, book string, chapter string, chapter_num int, page string, page_num int")
    quizzes = spark.createDataFrame(
        [(*s, f"Chapter {c}", f"{c}.11 Review Questions ", "mcq", "L1", 1.0, 1.0) for s in some(200) for c in [rng.randrange(1, 4)]],
        who + ", chapter string, page string, lrn_type string, lrn_question_reference string, points_earned double, points_possible double")
    quiz_pages = spark.createDataFrame([("r1", "b1", f"Chapter {c}", c, f"{c}.11 Review Questions", 11, 20, 2) for c in (1, 2)],
                                       "release string, book string, chapter string, chapter_num int, page string, page_num int, mcq int, plaintext int")
    enriched = studies.page_views(OBSERVATIONAL, views, classes, pages)
    whole = studies.combined(
        OBSERVATIONAL, studies.survey_items(OBSERVATIONAL, answers, book, lookup), studies.student_engagement(OBSERVATIONAL, enriched),
        studies.quiz_scores(OBSERVATIONAL, quizzes, quiz_pages), CONSTRUCTS)
    want = sorted(map(str, whole.select(*merge.STUDENT).distinct().collect()))
    labels = sorted(map(str, studies.demographics(OBSERVATIONAL, answers, book).select(*merge.STUDENT, "variable_name", "response_choice", "response_label").collect()))

    def unwanted(*_, **__):
        raise AssertionError("a measure was computed")

    for name in ("engagement.running_progress", "quiz.codebook_totals", "merge.construct_means"):
        monkeypatch.setattr(f"syllabix.operators.{name}", unwanted)
    pinned = studies.survey_answers(OBSERVATIONAL, answers, book)
    got = studies.combined_students(OBSERVATIONAL, pinned, lookup, enriched, quizzes, quiz_pages)
    assert want == sorted(map(str, got.collect())) and 5 < len(want) < len(students)
    labelled = studies.survey.label_codes(pinned, studies.DEMOGRAPHIC_LABELS).select(*merge.STUDENT, "variable_name", "response_choice", "response_label")
    assert labels == sorted(map(str, labelled.collect())) and labels


def test_labels_read_the_survey_once_and_compute_no_measures(spark, small, monkeypatch):
    from syllabix.catalog.queries import REGISTRY
    from syllabix.operators import engagement, quiz, survey

    calls = []
    for module, name in ((survey, "explode_multiselect"), (engagement, "running_progress"), (quiz, "codebook_totals"), (merge, "construct_means")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    assert REGISTRY["f1_widen_labels"](spark, small).columns == ["class_id", "student_id", "gender", "race1", "year"]
    assert calls == ["explode_multiselect"]
