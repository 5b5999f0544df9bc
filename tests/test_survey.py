from syllabix.operators import survey
from syllabix.plans import studies

KEYS = ["class_id", "release", "student_id", "lrn_question_reference"]


def responses(spark, rows):
    return spark.createDataFrame(
        [(1, "r1", s, q, o, r) for s, q, o, r in rows],
        "class_id int, release string, student_id int, lrn_question_reference string, ord int, response string",
    )


def choices(df):
    return [(r.student_id, r.lrn_question_reference, r.ord, r.response_choice, r.order)
            for r in df.orderBy("student_id", "lrn_question_reference", "order").collect()]


def test_choices_are_numbered_across_submissions(spark):
    df = responses(spark, [(1, "Q", 5, '["2", "0"]'), (1, "Q", 9, '["3"]'), (2, "Q", 1, "[]"), (2, "Q", 2, None)])
    assert choices(survey.explode_multiselect(df, KEYS, ["ord"])) == [
        (1, "Q", 5, "2", 1), (1, "Q", 5, "0", 2), (1, "Q", 9, "3", 3), (2, "Q", 1, "", 1), (2, "Q", 2, None, 2),
    ]


def test_numbering_survives_a_hot_student(spark):
    df = responses(spark, [(1, "Q", o, '["a","b"]') for o in range(300)] + [(2, "Q", 1, '["c"]')])
    plain = choices(survey.explode_multiselect(df, KEYS, ["ord"]))
    assert choices(survey.explode_multiselect(df, KEYS, ["ord"], max_group_rows=50)) == plain
    assert plain[-2][4] == 600


def test_normalize_drops_or_keeps_missing(spark):
    df = spark.createDataFrame([("null",), ("",), (None,), ("2",), ("text",)], "response_choice string")
    assert [r[0] for r in survey.normalize_response(df).collect()] == [2.0, None]
    kept = survey.normalize_response(df, null_tokens=["null"], drop_missing=False)
    assert [r[0] for r in kept.collect()] == [None, None, None, 2.0, None]


def test_missing_activity_and_type_are_dropped(spark):
    df = spark.createDataFrame([("Pre_Survey_1", "mcq"), (None, None), ("Post", "shorttext")], "lrn_activity_reference string, lrn_type string")
    assert survey.filter_activity(df).count() == 1
    assert survey.drop_item_types(df).count() == 1


def test_count_options(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None)], "lrn_option_0 string, lrn_option_1 string, lrn_option_2 string")
    assert [r.num_response_options for r in survey.count_options(df).collect()] == [2, 0]


def codebook(spark):
    return spark.createDataFrame(
        [("r1", "Q", 1, "ma_prep_a"), ("r1", "Q", 2, "ma_prep_b"), ("r2", "Q", None, "later"), ("r1", "P", 1, " gender ")],
        "release string, lrn_question_reference string, order int, variable_name string",
    ).selectExpr("*", "'p' AS prompt", "'mcq' AS lrn_type", "3L AS num_response_options")


def items(spark, rows):
    return spark.createDataFrame(
        [(1, "r1", s, q, o, c, "p", "mcq", str(c)) for s, q, o, c in rows],
        "class_id int, release string, student_id int, lrn_question_reference string, order int, "
        "response_choice double, prompt string, lrn_type string, response string",
    )


def test_codebook_release_rules(spark):
    df = items(spark, [(1, "Q", 1, 0.0), (1, "Q", 3, 1.0)])
    same = survey.join_codebook(df, codebook(spark)).orderBy("order").collect()
    assert [r.variable_name for r in same] == ["ma_prep_a", None]
    any_release = survey.join_codebook(df, codebook(spark), ["lrn_question_reference", "order"], default_order=1)
    assert sorted(r.variable_name for r in any_release.filter("order = 1").collect()) == ["later", "ma_prep_a"]
    assert {"release", "release_codebook"} <= set(any_release.columns)


def test_labels_trim_names_and_leave_unknown_codes_empty(spark):
    df = survey.join_codebook(items(spark, [(1, "P", 1, 1.0), (2, "P", 1, 9.0), (3, "Q", 1, 1.0)]), codebook(spark))
    got = {r.student_id: (r.variable_name, r.response_label) for r in survey.label_codes(df, studies.DEMOGRAPHIC_LABELS).collect()}
    assert got == {1: ("gender", "Female"), 2: ("gender", None)}


def test_every_demographic_mapping_labels_its_codes(spark):
    rows = [(name, float(code)) for name, codes in studies.DEMOGRAPHIC_LABELS.items() for code in codes]
    df = spark.createDataFrame(rows, "variable_name string, response_choice double")
    for r in survey.label_codes(df, studies.DEMOGRAPHIC_LABELS).collect():
        assert r.response_label == studies.DEMOGRAPHIC_LABELS[r.variable_name][str(int(r.response_choice))]
    assert set(studies.DEMOGRAPHIC_LABELS) == {"gender", "race1", "year"}


def test_collapse_conserves_rows(spark):
    df = survey.join_codebook(
        items(spark, [(1, "Q", 1, 5.0), (1, "Q", 2, 6.0), (2, "Q", 2, 7.0), (1, "P", 1, 1.0), (1, "Q", 3, 8.0)]), codebook(spark)
    )
    out = survey.collapse_multiselect(df)
    assert out.columns == df.columns
    got = {(r.student_id, r.variable_name): (r.response_choice, r.response, r.num_response_options, r.order) for r in out.collect()}
    assert got == {
        (1, "ma_prep_combined"): (2.0, ["ma_prep_a", "ma_prep_b"], 4, 1),
        (2, "ma_prep_combined"): (1.0, ["ma_prep_b"], 4, 2),
        (1, " gender "): (1.0, ["1.0"], 3, 1),
    }


def test_construct_override_and_coverage(spark):
    df = spark.createDataFrame(
        [("ma_prep_combined", 2.0, "p"), ("x", 1.0, "p"), ("x", None, "p"), ("none", 1.0, "p")],
        "variable_name string, response_choice double, prompt_codebook string",
    )
    lookup = spark.createDataFrame([("x", "anxiety", 6, True, "q")], "id string, construct string, scale_values int, scale_flipped boolean, question string")
    mapped = survey.attach_construct(df, lookup, {"ma_prep_combined": "experience_math"})
    assert sorted(r.construct for r in mapped.collect()) == ["anxiety", "anxiety", "experience_math"]
    assert survey.attach_construct(df, lookup).count() == 2
    everything = survey.attach_construct(df, lookup, drop_unmapped=False)
    assert {(r.variable_name, r.n) for r in survey.construct_coverage(everything, True).collect()} == {("x", 1)}
    assert {(r.variable_name, r.n) for r in survey.construct_coverage(everything, False).collect()} == {("none", 1), ("ma_prep_combined", 1)}
    assert [r.n for r in survey.prompt_drift(mapped).collect()] == [2]


def test_rescale_reverses_flipped_items(spark):
    df = spark.createDataFrame([(0.0, 6, False), (5.0, 6, False), (1.0, 6, True), (1.0, 1, False)], "response_choice double, scale_values int, scale_flipped boolean")
    assert [r.response_rescaled for r in survey.rescale_likert(df).collect()] == [0.0, 1.0, 0.8, None]


def test_choices_are_counted_before_they_are_dealt_out(spark, monkeypatch):
    rows = [(s, o, r) for s in (1, None) for o, r in enumerate(['["a|b", "c"]', "[]", None, "x | y", '"|"', "null"])]
    df = spark.createDataFrame(rows, "s int, ord int, response string")
    for sep, most in ((",", 8), ("|", 8), (", ", 8)):
        counted, group_sizes = [], survey.group_sizes
        monkeypatch.setattr(survey, "group_sizes", lambda *a: counted.append(group_sizes(*a)) or counted[-1])
        plain = survey.explode_multiselect(df, ["s"], ["ord"], sep=sep)
        got = survey.explode_multiselect(df, ["s"], ["ord"], sep=sep, max_group_rows=most, deal_by=["s"])
        cut = survey.explode_multiselect(df, ["s"], ["ord"], sep=sep, max_group_rows=2)
        assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect())) == sorted(map(str, cut.collect()))
        assert all(rows >= plain.count() for _, rows in counted) and counted[2][0] > 2
        monkeypatch.undo()
    choices = survey.explode_multiselect(df, ["s"], ["ord"], sep="|").filter("s = 1 and ord in (0, 3, 4)").orderBy("order")
    assert [r.response_choice for r in choices.collect()] == ["a", "b, c", "x", "y", "", ""]
