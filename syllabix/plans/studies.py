"""The operators chained for the observational and the experimental study.

Both use the same operators; what differs is gathered in ``Study``. Every function
takes and returns DataFrames and nothing is written between the stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join
from syllabix.functions.text import strip
from syllabix.operators import clusters, describe, engagement, merge, models, quiz, resample, survey
from syllabix.session import pin

# Sorts compare the first key fastest: students differ more than classes.
SURVEY_ITEM = ("student_id", "class_id", "release", "lrn_question_reference")

# Answer codes of the demographic items and their labels.
DEMOGRAPHIC_LABELS: Mapping[str, Mapping[str, str]] = {
    "gender": {
        "0": "Male",
        "1": "Female",
        "2": "Non-binary",
        "3": "Prefer to self-describe",
    },
    "race1": {
        "0": "American Indian or Alaska Native",
        "1": "Asian or Asian Am.",
        "2": "Black or African Am.",
        "3": "Hispanic, Latino, or Spanish Origin",
        "4": "Middle Eastern or North African",
        "5": "Native Hawaiian or Pacific Islander",
        "6": "White",
        "7": "Prefer to self-describe",
    },
    "year": {
        "0": "Freshman",
        "1": "Sophomore",
        "2": "Junior",
        "3": "Senior",
        "4": "Other",
    },
}


@dataclass(frozen=True)
class Study:
    """Rules in which the two studies differ."""

    drop_free_text: bool
    null_tokens: tuple[str, ...]
    drop_missing_answers: bool
    codebook_keys: tuple[str, ...]
    default_order: int | None
    construct_overrides: Mapping[str, str] = field(default_factory=dict)
    chapter: str = "chapter_num"
    chapter_keys: tuple[str, ...] = ("chapter", "chapter_num")
    # Page numbers and the quiz denominator come from a codebook, or from the views and answers.
    page_codebook: bool = True


OBSERVATIONAL = Study(
    drop_free_text=True,
    null_tokens=("null", ""),
    drop_missing_answers=True,
    codebook_keys=("release", "lrn_question_reference", "order"),
    default_order=None,
    construct_overrides={"ma_prep_combined": "experience_math"},
)

EXPERIMENTAL = Study(
    drop_free_text=False,
    null_tokens=("null",),
    drop_missing_answers=False,
    codebook_keys=("lrn_question_reference", "order"),
    default_order=1,
    chapter="chapter",
    chapter_keys=("chapter",),
    page_codebook=False,
)


def survey_choices(study: Study, responses: DataFrame) -> DataFrame:
    """Numbered answer choices of the pre-course survey; ``ord`` is the file order."""
    kept = survey.filter_activity(responses)
    if study.drop_free_text:
        kept = survey.drop_item_types(kept)
    # One exchange serves the numbering of choices here and the collapsing of questions later.
    choices = survey.explode_multiselect(kept, SURVEY_ITEM, ["ord"], deal_by=("class_id", "student_id", "lrn_question_reference"))
    if study.drop_missing_answers:
        return survey.normalize_response(choices, null_tokens=study.null_tokens)
    return choices


def survey_with_codebook(study: Study, responses: DataFrame, codebook: DataFrame) -> DataFrame:
    """Answer choices with their codebook columns."""
    book = survey.count_options(survey.filter_activity(codebook))
    return survey.join_codebook(survey_choices(study, responses), book, study.codebook_keys, study.default_order)


def demographics(study: Study, responses: DataFrame, codebook: DataFrame) -> DataFrame:
    """Demographic answers with their labels."""
    return survey.label_codes(survey_with_codebook(study, responses, codebook), DEMOGRAPHIC_LABELS)


def survey_items(
    study: Study, responses: DataFrame, codebook: DataFrame, lookup: DataFrame, drop_unmapped: bool = True
) -> DataFrame:
    """Survey answers with constructs, multi-select questions collapsed."""
    combined = survey_with_codebook(study, responses, codebook)
    return survey.attach_construct(
        survey.collapse_multiselect(combined), lookup, study.construct_overrides, drop_unmapped
    )


def survey_answers(study: Study, responses: DataFrame, codebook: DataFrame) -> DataFrame:
    """Students' numeric answers, multi-select questions collapsed, pinned: constructs and labels both derive from it.

    Collapsing touches no demographic item, so their labels are those of ``demographics``.
    """
    collapsed = survey.collapse_multiselect(survey_with_codebook(study, responses, codebook))
    return pin(collapsed.select(*merge.STUDENT, "variable_name", "response_choice"))


def construct_scores(items: DataFrame) -> DataFrame:
    """Construct mean and row count per student; kept missing answers count as rows."""
    return merge.construct_means(items)


def completed(study: Study, views: DataFrame) -> Column:
    """Completion test for text or boolean flags."""
    is_text = dict(views.dtypes)["was_complete"] == "string"
    return engagement.completed_text() if is_text else engagement.completed_flag()


def page_titles(views: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pages as their titles stand in the views, pinned: both page tables of a study derive from it."""
    return pin(engagement.attach_classes(views, classes).select("release", "book", "chapter", "page").distinct())


def quiz_pages(titles: DataFrame) -> DataFrame:
    """Page numbers by title as it stands."""
    return quiz.derive_page_numbers(titles)


def view_pages(titles: DataFrame) -> DataFrame:
    """Page numbers by trimmed title, as the parsed views have it."""
    return quiz.derive_page_numbers(titles.withColumn("page", strip("page")))


def page_views(study: Study, views: DataFrame, classes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Parsed views with class context and page numbers; without a codebook pages are derived."""
    parsed = engagement.parse_access_time(views)
    if pages is None:
        pages = view_pages(page_titles(views, classes))
    return engagement.enrich_views(parsed, classes, pages, keep=study.chapter)


def first_completions(study: Study, views: DataFrame) -> DataFrame:
    return engagement.first_completion(
        views, ("student_id", "class_id", study.chapter, "page"), completed=completed(study, views)
    )


def split_half(study: Study, views: DataFrame, iters: int = 100, seed: int = 130) -> tuple[DataFrame, DataFrame]:
    """Random halves of each class's pages and the students' share of them, per iteration.

    First completions feed both the draw and the scores, so they are computed once
    into a checkpoint.
    """
    first = pin(first_completions(study, views).select(
        "institution_id", "class_id", "student_id", "chapter_num", "page"
    ))
    halves = engagement.split_half_assign(first, iters, seed)
    return halves, engagement.split_half_scores(first, halves)


def student_progress(study: Study, views: DataFrame) -> DataFrame:
    """Running completion per student and chapter from enriched views.

    The class totals and the students' rows both come from the first completions;
    these are far fewer than the views and are computed once into files.
    """
    needed = ["book", "release", "institution_id", "class_id", "student_id", *study.chapter_keys, "page",
              "dt_accessed_processed"]
    first = pin(first_completions(study, views).select(*needed))
    return engagement.running_progress(first, study.chapter)


def student_engagement(study: Study, views: DataFrame) -> DataFrame:
    """Engagement per student and chapter from enriched views."""
    return engagement.engagement_summary(student_progress(study, views), study.chapter_keys)


def quiz_scores(study: Study, responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Quiz score per student and chapter; the denominator depends on the study."""
    review = quiz.select_review(responses)
    if study.page_codebook:
        # Page numbers and totals both read it.
        pages = pin(pages)
        return quiz.score_quiz_codebook(review, pages, quiz.codebook_totals(pages))
    return quiz.score_quiz_observed(review, pages)


def combined(study: Study, items: DataFrame, engaged: DataFrame, quizzes: DataFrame, constructs: list[str]) -> DataFrame:
    """Students' chapters with construct scores, engagement and quiz score."""
    wide = merge.widen_constructs(construct_scores(items), constructs)
    return merge.merge_sources(wide, engaged, quizzes, study.chapter_keys)


def combined_students(
    study: Study, answers: DataFrame, lookup: DataFrame, views: DataFrame, responses: DataFrame, pages: DataFrame
) -> DataFrame:
    """The students of ``combined``, each once, from the sources' keys alone: no score or share is computed.

    ``answers`` are ``survey_answers``, ``views`` enriched ones. Quiz responses are far more than
    students, so those of students without survey or engagement leave before they are numbered.
    """
    chapter = [*merge.STUDENT, *study.chapter_keys]
    engaged = pin(first_completions(study, views).select(*chapter).distinct())
    surveyed = survey.attach_construct(answers, lookup, study.construct_overrides)
    asked = lookup_join(quiz.select_review(responses), merge.in_both(engaged, surveyed, merge.STUDENT), merge.STUDENT, "left_semi")
    return merge.in_both(engaged, quiz.number_chapters(asked, pages), chapter).select(*merge.STUDENT).distinct()


def observational_models(averages: DataFrame, outcome: str, specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """End of the first study's chain: random-intercept models of the students' averages, grouped by class."""
    return models.model_sweep(averages, outcome, "class_id", specs)


def observational_bootstrap(
    averages: DataFrame, outcome: str, specs: Mapping[str, Sequence[str]], baseline: str, iters: int = 100, seed: int = 123,
) -> DataFrame:
    """Models of the students' averages compared by AIC: mean and interval over resampled students beside the actual value.

    The averages are the end of the whole preparation, so they are pinned and read by the
    draws, the moments and the actual fits alike.
    """
    students = pin(averages)
    aics = resample.bootstrap_models(students, outcome, "class_id", "student_id", specs, iters, seed)
    relative = resample.bootstrap_relative(aics, list(specs), baseline)
    actual = models.relative_aic(observational_models(students, outcome, specs), baseline)
    return resample.transpose_summary(relative, actual)


def construct_clusters(
    averages: DataFrame, measures: Sequence[str], ks: Sequence[int] = (2, 3), k: int = 2, restarts: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """The students' measures clustered by their correlations: silhouettes per number of clusters, and the table for ``k`` of them.

    One pass over the students gives all correlations; what follows has a row per measure.
    """
    cells = pin(describe.full_correlation_table(describe.correlation_matrix(averages, measures), measures))
    silhouettes = clusters.choose_k_of_profiles(clusters.correlation_profiles(cells, measures), "variable", measures, ks, restarts)
    return silhouettes, clusters.cluster_profiles(cells, measures, k, restarts)


def condition_effects(
    students: DataFrame, arms: DataFrame, outcomes: Sequence[str], arm: str = "module_variation", compared: Sequence[str] = ("A", "B"),
) -> tuple[DataFrame, DataFrame]:
    """Effect of the condition on the merged students' outcomes: F tests against no effect, and the arms' predicted means.

    ``arms`` has a student's condition once per survey; only students of the ``compared`` arms
    with all outcomes count, one row each. They are pinned and every outcome reads them.
    """
    placed = arms.filter(F.col(arm).isin(*compared)).select("student_id", arm).distinct()
    joined = lookup_join(students.select("class_id", "student_id", *outcomes), placed, ["student_id"], "inner").na.drop(subset=list(outcomes))
    rows = pin(models.arm_indicator(joined, arm, compared[1], "_arm"))
    tests, means = [], []
    for outcome in outcomes:
        fits = models.fit_ols_sweep(rows, outcome, {"baseline": [], "condition": ["_arm"]})
        tests.append(models.nested_f_test(fits, "baseline", "condition").withColumn("outcome", F.lit(outcome)))
        means.append(models.predicted_means(rows, arm, outcome).withColumn("outcome", F.lit(outcome)))
    return reduce(DataFrame.unionByName, tests), reduce(DataFrame.unionByName, means)


def experimental_test(graded: DataFrame, outcome: str, smaller: Sequence[str], larger: Sequence[str]) -> DataFrame:
    """End of the second study's chain: F test of two nested least-squares models of a gradebook column."""
    fits = models.fit_ols_sweep(graded, outcome, {"smaller": list(smaller), "larger": list(larger)})
    return models.nested_f_test(fits, "smaller", "larger")
