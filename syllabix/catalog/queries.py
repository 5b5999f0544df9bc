"""One registered query per operator, over the course-data roles of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, FloatType, IntegerType, TimestampType

from syllabix.catalog.specs import (
    ENGAGEMENT_MODELS,
    FEATURES,
    ITEM_AUDITS,
    ITERATIONS,
    MERGED_MEASURES,
    MERGED_MODELS,
    MERGED_QUIZ_MODELS,
    OLS_MODELS,
    QUIZ_AUDITS,
    QUIZ_MODELS,
)
from syllabix.operators import clusters, describe, engagement, merge, models, quiz, resample, survey
from syllabix.plans import studies
from syllabix.plans.studies import EXPERIMENTAL, OBSERVATIONAL, Study
from syllabix.session import ensure_checkpoint_dir, ship_package
from syllabix.sources.roles import role
from syllabix.sources.tables import VIEW_PAGE_CODEBOOK, drop_index_column, read_table, read_with_rejects, write_bucketed, write_table

CONSTRUCTS = ["anxiety_math", "stress_expectation", "value_task", "experience_math"]
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, integers as bigint, times and lists as text."""

    def column(field):
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (DoubleType, FloatType, DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, IntegerType):
            c = c.cast("bigint")
        elif isinstance(kind, TimestampType):
            c = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, ArrayType):
            c = F.concat_ws("|", c)
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def registered(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a query under the function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return comparable(function(Tables(spark, folder)))

    REGISTRY[function.__name__] = run
    return function


class Tables:
    """Roles of one data folder, and the stages of the two studies on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return role(self.spark, self.folder, name)

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def scratch(self) -> str:
        """A new folder on storage all executors share."""
        return f"{ensure_checkpoint_dir(self.spark)}/written-{uuid.uuid4().hex}"

    def views(self, study: Study = OBSERVATIONAL) -> DataFrame:
        pages = self.page_codebook if study.page_codebook else studies.view_pages(self.titles())
        return studies.page_views(study, self.page_views, self.classes, pages)

    def first(self, study: Study = OBSERVATIONAL) -> DataFrame:
        return studies.first_completions(study, self.views(study))

    def engaged(self, study: Study = OBSERVATIONAL) -> DataFrame:
        return studies.student_engagement(study, self.views(study))

    def quiz_pages(self, study: Study) -> DataFrame:
        if study.page_codebook:
            return self.quiz_codebook
        return studies.quiz_pages(self.titles())

    def titles(self) -> DataFrame:
        if "_titles" not in self.__dict__:
            self._titles = studies.page_titles(self.page_views, self.classes)
        return self._titles

    def quizzes(self, study: Study = OBSERVATIONAL) -> DataFrame:
        return studies.quiz_scores(study, self.quiz_responses, self.quiz_pages(study))

    def choices(self, study: Study = OBSERVATIONAL) -> DataFrame:
        return studies.survey_choices(study, self.survey_responses)

    def coded(self, study: Study = OBSERVATIONAL) -> DataFrame:
        return studies.survey_with_codebook(study, self.survey_responses, self.survey_codebook)

    def items(self, study: Study = OBSERVATIONAL, drop_unmapped: bool = True) -> DataFrame:
        return studies.survey_items(
            study, self.survey_responses, self.survey_codebook, self.construct_lookup, drop_unmapped
        )

    def merged(self, study: Study = OBSERVATIONAL) -> DataFrame:
        return studies.combined(study, self.items(study), self.engaged(study), self.quizzes(study), CONSTRUCTS)

    def frame(self) -> DataFrame:
        return describe.model_frame(self.merged(), [
            "class_id", "student_id", "chapter_num", "proportion_pages_complete_student",
            "construct_mean_anxiety_math", "construct_mean_stress_expectation", "eoc_score",
        ])

    def averages(self) -> DataFrame:
        return describe.entity_average(
            self.frame(), ["class_id", "student_id"],
            {"avg_prop_pages_complete": "proportion_pages_complete_student", "avg_eoc_score": "eoc_score"},
            ["chapter_num"],
        )

    def graded(self) -> DataFrame:
        return describe.attach_assessment(self.averages(), self.assessments)

    def outcomes(self) -> DataFrame:
        """Profiles with an outcome that differs between classes."""
        return self.profiles.withColumn("outcome", F.col("y") + F.col("class_id") * 0.02 + F.col("c1") * 0.2)

    def half_scores(self) -> DataFrame:
        return studies.split_half(OBSERVATIONAL, self.views(), ITERATIONS)[1]

    def conditions(self) -> DataFrame:
        return models.arm_indicator(self.condition_survey, "module_variation", "B", "arm_b")


# Sources and sinks


@registered
def a1_read_table(t: Tables) -> DataFrame:
    return read_table(
        t.spark, t.path("customer"),
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    )


@registered
def a1_read_table_csv(t: Tables) -> DataFrame:
    target = t.scratch()
    write_table(t.spark.read.parquet(t.path("documents")).select("doc_id", "lang", "text"), target, "csv")
    return read_table(t.spark, target, "doc_id bigint, lang string, text string", "csv", multiline=True)


def damaged_lines(customers: DataFrame) -> DataFrame:
    """CSV lines of customers, some with unpaired quotes, a field too few, a bad or a missing number; named as their header."""
    kind = F.col("c_custkey") % 50
    name = F.concat(F.lit('"'), "c_name", F.when(kind == 0, "").otherwise('"'))
    balance = F.when(kind == 2, "abc").when(kind == 3, "NA").otherwise(F.col("c_acctbal").cast("string"))
    cells = [F.col("c_custkey").cast("string"), name, F.col("c_nationkey").cast("string"), F.when(kind != 1, balance)]
    return customers.select(F.concat_ws(",", *cells).alias("c_custkey,c_name,c_nationkey,c_acctbal"))


@registered
def a1_read_with_rejects(t: Tables) -> DataFrame:
    """Account of a damaged CSV file: its rows, rejects by reason, and values missing or unreadable by column."""
    target = t.scratch()
    # Neither sign occurs, so every line is written as it stands, below the header.
    damaged_lines(t.spark.read.parquet(t.path("customer"))).write.csv(target, header=True, sep="\u0001", quote="\u0002")
    found = read_with_rejects(t.spark, target, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double")
    columns = found.counts.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col("column").alias("name"), F.col(kind).alias("n")) for kind in ("missing", "unreadable")])))
    rejects = found.rejects.groupBy(F.col("reason").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejects").alias("kind"), "name", "n")
    rows = found.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("kind"), F.lit("").alias("name"), "n")
    return columns.unionByName(rejects).unionByName(rows)


@registered
def a2_drop_index_column_csv(t: Tables) -> DataFrame:
    """A page codebook written with its index column and read back without it."""
    target = t.scratch()
    book = t.page_codebook.select(
        F.concat_ws("-", "release", "chapter", "page").alias("index"), "release", "book", "chapter", "page",
        F.col("chapter_num").cast("double").alias("chapter_num"), F.col("page_num").cast("double").alias("page_num"))
    write_table(book, target, "csv")
    return drop_index_column(read_table(t.spark, target, VIEW_PAGE_CODEBOOK, "csv"))


@registered
def a2_drop_index_column(t: Tables) -> DataFrame:
    return drop_index_column(t.spark.read.parquet(t.path("supplier")))


@registered
def a3_write_table(t: Tables) -> DataFrame:
    target = t.scratch()
    write_table(t.items(), target)
    return read_table(t.spark, target).select("student_id", "variable_name", "order", "response_choice", "response")


# Survey preparation


@registered
def b1_filter_activity(t: Tables) -> DataFrame:
    return survey.filter_activity(t.survey_responses).select("ord", "lrn_activity_reference", "response")


@registered
def b2_drop_item_types(t: Tables) -> DataFrame:
    return survey.drop_item_types(t.survey_responses).select("ord", "lrn_type")


@registered
def b3_explode_multiselect(t: Tables) -> DataFrame:
    kept = survey.drop_item_types(survey.filter_activity(t.survey_responses))
    return survey.explode_multiselect(kept, studies.SURVEY_ITEM, ["ord"]).select(
        "ord", *studies.SURVEY_ITEM, "response_choice", "order"
    )


@registered
def b4_normalize_response(t: Tables) -> DataFrame:
    return t.choices().select("ord", *studies.SURVEY_ITEM, "response_choice", "order")


@registered
def b4_normalize_response_kept(t: Tables) -> DataFrame:
    return survey.normalize_response(
        t.choices(EXPERIMENTAL), null_tokens=EXPERIMENTAL.null_tokens, drop_missing=False
    ).select("ord", *studies.SURVEY_ITEM, "response_choice", "order")


@registered
def b5_count_options(t: Tables) -> DataFrame:
    return survey.count_options(t.item_codebook).select("item_id", "num_response_options")


CODED = ["ord", "student_id", "variable_name", "prompt_survey_data", "prompt_codebook", "lrn_type_survey_data",
         "lrn_type_codebook", "num_response_options", "order", "response_choice"]


@registered
def b6_join_codebook(t: Tables) -> DataFrame:
    return t.coded().select(*CODED)


@registered
def b6_join_codebook_any_release(t: Tables) -> DataFrame:
    return t.coded(EXPERIMENTAL).select(*CODED, "release", "release_codebook")


@registered
def b7_label_codes(t: Tables) -> DataFrame:
    return studies.demographics(OBSERVATIONAL, t.survey_responses, t.survey_codebook).select(
        "ord", "student_id", "variable_name", "response_choice", "response_label"
    )


COLLAPSED = ["ord", "student_id", "class_id", "lrn_question_reference", "order", "variable_name",
             "num_response_options", "response_choice", "response"]


@registered
def b8_collapse_multiselect(t: Tables) -> DataFrame:
    return survey.collapse_multiselect(t.coded()).select(*COLLAPSED)


MAPPED = ["ord", "student_id", "order", "variable_name", "response_choice", "construct", "scale_values",
          "scale_flipped", "question"]


@registered
def b9_attach_construct(t: Tables) -> DataFrame:
    return t.items().select(*MAPPED)


@registered
def b9_attach_construct_experimental(t: Tables) -> DataFrame:
    return t.items(EXPERIMENTAL).select(*MAPPED)


@registered
def b10_prompt_drift(t: Tables) -> DataFrame:
    return survey.prompt_drift(t.items())


@registered
def b11_construct_coverage(t: Tables) -> DataFrame:
    return survey.construct_coverage(t.items(drop_unmapped=False), mapped=True)


@registered
def b11_construct_coverage_unmapped(t: Tables) -> DataFrame:
    items = survey.attach_construct(survey.collapse_multiselect(t.coded()), t.construct_lookup, drop_unmapped=False)
    return survey.construct_coverage(items, mapped=False)


@registered
def b12_rescale_likert(t: Tables) -> DataFrame:
    return survey.rescale_likert(t.items()).select("ord", "variable_name", "order", "response_choice", "response_rescaled")


# Quiz scoring


@registered
def c1_select_review(t: Tables) -> DataFrame:
    return quiz.select_review(t.quiz_responses).groupBy("page", "lrn_type", "student_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points_earned").alias("points")
    )


@registered
def c2_codebook_totals(t: Tables) -> DataFrame:
    return quiz.codebook_totals(t.quiz_codebook)


@registered
def c3_score_quiz_codebook(t: Tables) -> DataFrame:
    return t.quizzes()


@registered
def c4_score_quiz_observed(t: Tables) -> DataFrame:
    return t.quizzes(EXPERIMENTAL)


@registered
def c5_derive_page_numbers(t: Tables) -> DataFrame:
    return t.quiz_pages(EXPERIMENTAL)


# Engagement


@registered
def d1_parse_access_time(t: Tables) -> DataFrame:
    return engagement.parse_access_time(t.page_views).select(
        "ord", "page", "dt_accessed_processed", "dt_accessed_processed_ms"
    )


@registered
def d2_enrich_views(t: Tables) -> DataFrame:
    return t.views().select("ord", "student_id", "class_id", "institution_id", "release", "book", "chapter",
                            "chapter_num", "page", "page_num")


@registered
def d3_first_completion(t: Tables) -> DataFrame:
    return t.first().select("ord", "class_id", "student_id", "chapter_num", "page", "dt_accessed_processed")


@registered
def d4_class_page_totals(t: Tables) -> DataFrame:
    return engagement.class_page_totals(t.first())


PROGRESS = ["class_id", "student_id", "page", "pages_complete_so_far", "total_unique_pages_complete_student",
            "total_unique_pages_complete_class", "proportion_pages_complete_so_far",
            "proportion_pages_complete_student"]


@registered
def d5_running_progress(t: Tables) -> DataFrame:
    return studies.student_progress(OBSERVATIONAL, t.views()).select("chapter_num", *PROGRESS)


@registered
def d5_running_progress_experimental(t: Tables) -> DataFrame:
    views = t.views(EXPERIMENTAL).withColumn("was_complete", F.col("was_complete") == "true")
    return studies.student_progress(EXPERIMENTAL, views).select("chapter", *PROGRESS)


@registered
def d6_engagement_summary(t: Tables) -> DataFrame:
    return t.engaged()


@registered
def d6_engagement_summary_experimental(t: Tables) -> DataFrame:
    return t.engaged(EXPERIMENTAL)


@registered
def d7_split_half_assign(t: Tables) -> DataFrame:
    return engagement.split_half_assign(t.first(), ITERATIONS)


@registered
def d8_split_half_scores(t: Tables) -> DataFrame:
    return t.half_scores()


@registered
def d9_split_half_reliability(t: Tables) -> DataFrame:
    return engagement.split_half_reliability(t.half_scores())


@registered
def d10_interval_summary(t: Tables) -> DataFrame:
    return engagement.interval_summary(
        engagement.split_half_reliability(t.half_scores()), ["pearson", "spearman", "spearman_brown"]
    )


# Merge and audits


@registered
def e1_uniqueness_audit(t: Tables) -> DataFrame:
    return merge.uniqueness_audit(t.items(), ["class_id", "student_id", "variable_name"])


@registered
def e1_uniqueness_audit_two_rows(t: Tables) -> DataFrame:
    return merge.uniqueness_audit(t.items(), ["class_id", "student_id", "variable_name"], max_rows=2)


@registered
def e1_uniqueness_audit_submissions(t: Tables) -> DataFrame:
    return merge.uniqueness_audit(t.survey_responses, ["class_id", "student_id", "lrn_question_reference"])


@registered
def e1_uniqueness_audit_quiz(t: Tables) -> DataFrame:
    return merge.uniqueness_audit(t.quizzes(), ["class_id", "student_id"], max_rows=2)


@registered
def e1_uniqueness_audit_engagement(t: Tables) -> DataFrame:
    return merge.uniqueness_audit(t.engaged(), ["class_id", "student_id"])


@registered
def e1_uniqueness_audits(t: Tables) -> DataFrame:
    """All audits of the survey items in one scan."""
    return merge.uniqueness_audits(t.items(), ITEM_AUDITS)


@registered
def e1_uniqueness_audits_quiz(t: Tables) -> DataFrame:
    return merge.uniqueness_audits(t.quizzes(), QUIZ_AUDITS)


@registered
def e2_entity_set(t: Tables) -> DataFrame:
    return merge.entity_set(t.engaged())


@registered
def e2_population_overlap(t: Tables) -> DataFrame:
    return merge.population_overlap({
        "survey": merge.entity_set(t.items()),
        "quiz": merge.entity_set(t.quizzes()),
        "engagement": merge.entity_set(t.engaged()),
    })


@registered
def e3_count_entities(t: Tables) -> DataFrame:
    return merge.count_entities(t.merged(), "class_id", "student_id")


@registered
def e3_count_entities_two_sources(t: Tables) -> DataFrame:
    return merge.count_entities(t.condition_survey, "student_id", also=t.engaged())


@registered
def e4_construct_means(t: Tables) -> DataFrame:
    return studies.construct_scores(t.items())


@registered
def e4_construct_means_experimental(t: Tables) -> DataFrame:
    return studies.construct_scores(t.items(EXPERIMENTAL))


@registered
def e5_widen_constructs(t: Tables) -> DataFrame:
    return merge.widen_constructs(studies.construct_scores(t.items()), CONSTRUCTS)


@registered
def e6_merge_sources(t: Tables) -> DataFrame:
    return t.merged()


@registered
def e6_merge_sources_experimental(t: Tables) -> DataFrame:
    return t.merged(EXPERIMENTAL)


@registered
def e6_merge_sources_bucketed(t: Tables) -> DataFrame:
    """The merge from tables laid out by student, as a pipeline writes them that merges often."""
    wide = merge.widen_constructs(studies.construct_scores(t.items()), CONSTRUCTS)
    parts = [
        write_bucketed(df, f"part_{uuid.uuid4().hex}", merge.STUDENT, 8, t.scratch()) for df in (wide, t.engaged(), t.quizzes())]
    return merge.merge_bucketed(*parts)


# Descriptives


def _labels(t: Tables) -> DataFrame:
    answers = studies.survey_answers(OBSERVATIONAL, t.survey_responses, t.survey_codebook)
    students = studies.combined_students(
        OBSERVATIONAL, answers, t.construct_lookup, t.views(), t.quiz_responses, t.quiz_pages(OBSERVATIONAL))
    labels = survey.label_codes(answers, studies.DEMOGRAPHIC_LABELS)
    return describe.widen_labels(students, labels, list(studies.DEMOGRAPHIC_LABELS))


@registered
def f1_widen_labels(t: Tables) -> DataFrame:
    return _labels(t)


@registered
def f2_category_share(t: Tables) -> DataFrame:
    return describe.category_share(_labels(t), "gender")


@registered
def f3_model_frame(t: Tables) -> DataFrame:
    return describe.model_frame(
        t.merged(),
        ["class_id", "student_id", "chapter_num", "proportion_pages_complete_student",
         "construct_mean_anxiety_math", "construct_mean_stress_expectation", "eoc_score"],
        exclude={"student_id": [5]},
    )


@registered
def f4_entity_average(t: Tables) -> DataFrame:
    return t.averages()


@registered
def f5_correlation_matrix(t: Tables) -> DataFrame:
    return describe.correlation_matrix(t.profiles, FEATURES)


@registered
def f5_correlation_matrix_pairwise(t: Tables) -> DataFrame:
    wide = merge.widen_constructs(studies.construct_scores(t.items()), CONSTRUCTS)
    return describe.correlation_matrix(wide, [f"construct_mean_{c}" for c in CONSTRUCTS])


@registered
def f5_correlation_table(t: Tables) -> DataFrame:
    return describe.full_correlation_table(describe.correlation_matrix(t.profiles, FEATURES), FEATURES)


@registered
def f6_choose_k(t: Tables) -> DataFrame:
    cells = describe.full_correlation_table(describe.correlation_matrix(t.profiles, FEATURES), FEATURES)
    return clusters.choose_k_of_profiles(clusters.correlation_profiles(cells, FEATURES), "variable", FEATURES)


@registered
def f6_choose_k_merged(t: Tables) -> DataFrame:
    """The first study's clusters, of the merged students' measures."""
    return studies.construct_clusters(t.averages(), MERGED_MEASURES)[0]


@registered
def f7_cluster_profiles_merged(t: Tables) -> DataFrame:
    return studies.construct_clusters(t.averages(), MERGED_MEASURES)[1]


@registered
def f7_cluster_profiles(t: Tables) -> DataFrame:
    cells = describe.full_correlation_table(describe.correlation_matrix(t.profiles, FEATURES), FEATURES)
    return clusters.cluster_profiles(cells, FEATURES)


@registered
def f8_density_by_group(t: Tables) -> DataFrame:
    return describe.density_by_group(t.engaged(), "proportion_pages_complete_student", "chapter_num", 1.5, (0.0, 1.0))


@registered
def f8_density_by_group_open(t: Tables) -> DataFrame:
    return describe.density_by_group(t.profiles, "y", "class_id", 1.3)


@registered
def f9_trend_by_group(t: Tables) -> DataFrame:
    return describe.trend_by_group(t.profiles, ["c1", "c2"], "y")


@registered
def f10_group_means(t: Tables) -> DataFrame:
    return describe.group_means(t.condition_survey, "module_variation", {"sample_avg_y1": "y1", "sample_avg_y2": "y2"})


@registered
def f11_row_mean(t: Tables) -> DataFrame:
    graded = describe.attach_assessment(t.averages(), t.assessments)
    averaged = describe.row_mean(graded, ["avg_eoc_score", "quiz_mean"], "avg_all")
    # The mean of two values of six places can end exactly half way: decimals round it alike everywhere.
    exact = F.round(F.col("avg_all").cast("decimal(20,10)"), 6)
    return averaged.withColumn("avg_all", exact.cast("double"))


@registered
def f12_attach_assessment(t: Tables) -> DataFrame:
    return describe.attach_assessment(t.engaged(), t.assessments)


@registered
def f13_condition_frame(t: Tables) -> DataFrame:
    return describe.condition_frame(t.condition_waves, {"y1": "q_y1", "y2": "q_y2"}, source="src3")


# Models and resampling


@registered
def g1_fit_random_intercept(t: Tables) -> DataFrame:
    return models.fit_random_intercept(t.outcomes(), "outcome", ["c1", "c2"], "class_id")


@registered
def g1_fit_random_intercept_boundary(t: Tables) -> DataFrame:
    return models.fit_random_intercept(t.profiles, "y", ["c1"], "class_id")


@registered
def g2_likelihood_ratio_test(t: Tables) -> DataFrame:
    fits = models.model_sweep(t.outcomes(), "outcome", "class_id", ENGAGEMENT_MODELS)
    return models.likelihood_ratio_test(fits, "baseline", "attitudes")


@registered
def g3_relative_aic(t: Tables) -> DataFrame:
    return models.relative_aic(models.model_sweep(t.outcomes(), "outcome", "class_id", QUIZ_MODELS), "baseline")


@registered
def g4_model_sweep(t: Tables) -> DataFrame:
    return models.model_sweep(t.outcomes(), "outcome", "class_id", ENGAGEMENT_MODELS)


def _merged_sweep(t: Tables) -> DataFrame:
    return studies.observational_models(t.averages(), "avg_prop_pages_complete", MERGED_MODELS)


@registered
def g4_model_sweep_merged(t: Tables) -> DataFrame:
    """End of the first study's chain: engagement models on the merged students' averages."""
    return _merged_sweep(t)


@registered
def g4_model_sweep_merged_quiz(t: Tables) -> DataFrame:
    """Quiz models with engagement as predictor."""
    return studies.observational_models(t.averages(), "avg_eoc_score", MERGED_QUIZ_MODELS)


@registered
def g2_likelihood_ratio_test_merged(t: Tables) -> DataFrame:
    return models.likelihood_ratio_test(_merged_sweep(t), "baseline", "both")


@registered
def f5_correlation_matrix_merged(t: Tables) -> DataFrame:
    return describe.correlation_matrix(t.averages(), MERGED_MEASURES)


@registered
def g11_correlation_test_merged(t: Tables) -> DataFrame:
    """End of the second study's chain: engagement and the gradebook."""
    return models.correlation_test(t.graded(), "avg_prop_pages_complete", "quiz_mean")


@registered
def g10_nested_f_test_merged(t: Tables) -> DataFrame:
    return studies.experimental_test(
        t.graded(), "quiz_mean", ["avg_prop_pages_complete"], ["avg_prop_pages_complete", "construct_mean_anxiety_math"])


@registered
def g5_stratified_resample(t: Tables) -> DataFrame:
    return resample.stratified_resample(t.profiles, "class_id", "student_id", ITERATIONS)


def _bootstrap(t: Tables) -> DataFrame:
    return resample.bootstrap_models(t.outcomes(), "outcome", "class_id", "student_id", QUIZ_MODELS, ITERATIONS)


def _relative(t: Tables) -> DataFrame:
    return resample.bootstrap_relative(
        _bootstrap(t), list(QUIZ_MODELS), "baseline", "nervous_confval", ["attitudes", "nervous_confval"]
    )


@registered
def g6_bootstrap_models(t: Tables) -> DataFrame:
    return _bootstrap(t)


@registered
def g7_bootstrap_relative(t: Tables) -> DataFrame:
    return _relative(t)


@registered
def g8_transpose_summary(t: Tables) -> DataFrame:
    compared = {m: QUIZ_MODELS[m] for m in ("baseline", "attitudes", "nervous", "exp_confval")}
    actual = models.relative_aic(models.model_sweep(t.outcomes(), "outcome", "class_id", compared), "baseline")
    return resample.transpose_summary(_relative(t), actual)


@registered
def g8_transpose_summary_merged(t: Tables) -> DataFrame:
    """The first study's last step: quiz models of the merged students over resampled students."""
    return studies.observational_bootstrap(t.averages(), "avg_eoc_score", MERGED_QUIZ_MODELS, "baseline", ITERATIONS)


def _condition_effects(t: Tables) -> tuple[DataFrame, DataFrame]:
    return studies.condition_effects(t.averages(), t.condition_survey, ["avg_eoc_score", "avg_prop_pages_complete"])


@registered
def g10_nested_f_test_conditions(t: Tables) -> DataFrame:
    """The second study's conditions, compared on the merged students."""
    return _condition_effects(t)[0]


@registered
def g12_predicted_means_conditions(t: Tables) -> DataFrame:
    return _condition_effects(t)[1]


@registered
def g9_fit_ols(t: Tables) -> DataFrame:
    return models.fit_ols_sweep(t.profiles, "y", OLS_MODELS)


@registered
def g9_fit_ols_arm(t: Tables) -> DataFrame:
    return models.fit_ols(t.conditions(), "y1", ["arm_b"])


@registered
def g10_nested_f_test(t: Tables) -> DataFrame:
    return models.nested_f_test(models.fit_ols_sweep(t.profiles, "y", OLS_MODELS), "two", "five")


@registered
def g10_nested_f_test_arm(t: Tables) -> DataFrame:
    fits = models.fit_ols_sweep(t.conditions(), "y1", {"baseline": [], "condition": ["arm_b"]})
    return models.nested_f_test(fits, "baseline", "condition")


@registered
def g11_correlation_test(t: Tables) -> DataFrame:
    return models.correlation_test(t.profiles, "c1", "y")


@registered
def g12_predicted_means(t: Tables) -> DataFrame:
    return models.predicted_means(t.condition_survey, "module_variation", "y1")
