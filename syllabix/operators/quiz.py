"""End-of-chapter quiz scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from syllabix.functions.joins import lookup_join
from syllabix.functions.text import count_tuples, strip

PAGE_KEYS = ("book", "release", "chapter", "page")
CHAPTER_KEYS = ("book", "release", "chapter", "chapter_num")
STUDENT_CHAPTER = ("book", "release", "institution_id", "class_id", "student_id", "chapter", "chapter_num")


def select_review(df: DataFrame, page_pattern: str = "Review Questions", item_type: str = "mcq") -> DataFrame:
    """Keep scored questions on review pages and trim the page title."""
    return (
        df.filter(F.col("page").contains(page_pattern) & (F.col("lrn_type") == item_type))
        .withColumn("page", strip("page"))
    )


def codebook_totals(codebook: DataFrame, pattern: str = "Review", keys: Sequence[str] = CHAPTER_KEYS) -> DataFrame:
    """Sum every numeric count column over a chapter's review pages."""
    skipped = {*keys, "page", "page_num"}
    counts = [
        f.name for f in codebook.schema.fields if f.name not in skipped and isinstance(f.dataType, NumericType)
    ]
    return (
        codebook.filter(F.col("page").contains(pattern))
        .groupBy(*keys)
        .agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in counts])
    )


def _submissions():
    return [
        F.count(F.lit(1)).alias("questions_submitted"),
        F.coalesce(F.sum("points_earned"), F.lit(0.0)).alias("n_correct"),
    ]


def number_chapters(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Responses with their page's chapter number, missing for an unknown page."""
    return lookup_join(responses, pages.select(*PAGE_KEYS, "chapter_num"), list(PAGE_KEYS))


def score_quiz_codebook(responses: DataFrame, pages: DataFrame, totals: DataFrame, total_col: str = "mcq") -> DataFrame:
    """Score per student and chapter against the codebook's number of questions.

    A chapter without a codebook total, or with a total of 0, gets a missing score.
    """
    numbered = number_chapters(responses, pages)
    scored = numbered.groupBy(*STUDENT_CHAPTER).agg(
        *_submissions(), F.coalesce(F.sum("points_possible"), F.lit(0.0)).alias("n_attempted")
    )
    limits = totals.select(*CHAPTER_KEYS, F.col(total_col).alias("n_total"))
    return lookup_join(scored, limits, list(CHAPTER_KEYS)).withColumn(
        "eoc_score", F.try_divide("n_correct", "n_total")
    )


def score_quiz_observed(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Score per student and chapter against the distinct questions seen in the class."""
    numbered = number_chapters(responses, pages)
    seen_keys = ["class_id", "chapter", "chapter_num"]
    seen = numbered.groupBy(*seen_keys).agg(count_tuples("lrn_question_reference").cast("double").alias("n_total"))
    scored = numbered.groupBy(*STUDENT_CHAPTER).agg(*_submissions())
    return lookup_join(scored, seen, seen_keys).withColumn("eoc_score", F.try_divide("n_correct", "n_total"))


def derive_page_numbers(df: DataFrame) -> DataFrame:
    """Number pages from their titles; titles without a number are dropped.

    The chapter number is every digit of the chapter title. The page number is read
    from the first 8 characters of the page title (longer titles lose their last
    three of them to an ellipsis). Titles 10 to 18 within a chapter are scaled as
    two-digit numbers; ``x.19`` and ``x.20`` keep the known defects of the rule.
    """
    title = F.when(F.length("page") > 8, F.concat(F.substring("page", 1, 5), F.lit("..."))).otherwise(F.col("page"))
    numbers = F.struct(
        F.regexp_replace("chapter", r"\D", "").try_cast("double").alias("chapter_num"),
        F.nullif(F.regexp_extract(title, r"\d+\.*\d*", 0), F.lit("")).alias("_text"),
    )
    # A generator keeps the title parsing above the distinct: as plain columns, the
    # final filter would be pushed down and parse every view instead of every page.
    pages = df.select("release", "book", "chapter", "page").distinct().select("*", F.inline(F.array(numbers)))
    within = F.round((F.col("_text").try_cast("double") - F.col("chapter_num")) / 10, 3)
    two_digits = F.col("_text").contains(".10") | ((within > 0.010) & (within < 0.019))
    return (
        pages.withColumn("page_num", F.when(two_digits, within * 10).otherwise(within) * 100)
        .filter(F.col("page_num").isNotNull())
        .drop("_text")
    )
