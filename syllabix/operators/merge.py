"""Audits, entity counts and the merge of survey, engagement and quiz data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.functions.joins import null_safe_join
from syllabix.functions.text import count_tuples
from syllabix.sources.tables import LAYOUT_KEY

STUDENT = ("release", "book", "institution_id", "class_id", "student_id")


def uniqueness_audit(df: DataFrame, keys: Sequence[str], max_rows: int = 1) -> DataFrame:
    """Groups that have more than ``max_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("nrows")).filter(F.col("nrows") > max_rows)


def uniqueness_audits(df: DataFrame, audits: Mapping[str, tuple[Sequence[str], int]]) -> DataFrame:
    """Several ``uniqueness_audit``s of one table in one scan: name to keys and rows allowed.

    Returns ``audit``, all keys (missing where an audit does not use them) and ``nrows``. One
    aggregation with grouping sets serves all; audits of the same keys share its groups.
    """
    columns = list(dict.fromkeys(k for keys, _ in audits.values() for k in keys))
    sets = list(dict.fromkeys(tuple(c for c in columns if c in keys) for keys, _ in audits.values()))

    def number(keys: Sequence[str]) -> int:
        """``grouping_id`` of a set: a bit for every column left out, the first one highest."""
        return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)

    grouped = df.groupingSets([[F.col(c) for c in keys] for keys in sets], *columns).agg(
        F.count(F.lit(1)).alias("nrows"), F.grouping_id().alias("_set"))
    known = F.array(*[
        F.struct(F.lit(name).alias("audit"), F.lit(number(keys)).alias("set"), F.lit(most).alias("most"))
        for name, (keys, most) in audits.items()])
    failed = F.filter(known, lambda a: (a["set"] == F.col("_set")) & (F.col("nrows") > a["most"]))
    return grouped.select(F.explode(failed).alias("_failed"), *columns, "nrows").select("_failed.audit", *columns, "nrows")


def entity_set(df: DataFrame, keys: Sequence[str] = ("class_id", "student_id")) -> DataFrame:
    """Distinct entities as one ``UID`` text; a missing part reads ``NA``."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys]
    return df.select(F.concat_ws(", ", *parts).alias("UID")).distinct()


def population_overlap(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Sizes, pairwise differences and intersections, and the common core of entity sets.

    Membership flags are gathered per entity in one aggregation, so every size
    comes out of a single shuffle however many sets are compared.
    """
    names = list(sets)
    tagged = None
    for name in names:
        flags = [F.lit(name == other).alias(other) for other in names]
        part = sets[name].select("UID", *flags)
        tagged = part if tagged is None else tagged.unionByName(part)
    members = tagged.groupBy("UID").agg(*[F.bool_or(n).alias(n) for n in names])
    sizes = [(n, F.col(n)) for n in names]
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            sizes += [
                (f"{a} and {b}", F.col(a) & F.col(b)),
                (f"{a} not {b}", F.col(a) & ~F.col(b)),
                (f"{b} not {a}", F.col(b) & ~F.col(a)),
            ]
    everywhere = F.lit(True)
    for n in names:
        everywhere = everywhere & F.col(n)
    sizes.append((" and ".join(names) if len(names) > 2 else "all", everywhere))
    counted = members.agg(*[F.count_if(test).alias(label) for label, test in sizes])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("comparison"), F.col(f"`{label}`").alias("n")) for label, _ in sizes
    ])))


def count_entities(df: DataFrame, *cols: str, also: DataFrame | None = None) -> DataFrame:
    """Number of distinct tuples, a missing value being a value; ``also`` adds a second source."""
    source = df.select(*cols)
    if also is not None:
        source = source.unionByName(also.select(*cols))
    return source.agg(count_tuples(*cols).alias("n"))


def construct_means(items: DataFrame) -> DataFrame:
    """Mean answer (skipping missing ones) and row count (including them) per student and construct."""
    return items.groupBy(*STUDENT, "construct").agg(
        F.avg("response_choice").alias("construct_mean"),
        F.count(F.lit(1)).alias("construct_responses"),
    )


def widen_constructs(long: DataFrame, constructs: Sequence[str]) -> DataFrame:
    """One row per student with ``construct_mean_*`` and ``construct_responses_*`` columns."""
    measures = ("construct_mean", "construct_responses")
    wide = long.groupBy(*STUDENT).pivot("construct", list(constructs)).agg(*[F.max(m).alias(m) for m in measures])
    return wide.withColumnsRenamed({f"{c}_{m}": f"{m}_{c}" for c in constructs for m in measures})


def merge_sources(
    survey: DataFrame,
    engagement: DataFrame,
    quiz: DataFrame,
    chapter_keys: Sequence[str] = ("chapter", "chapter_num"),
) -> DataFrame:
    """Students' chapters with engagement and a quiz score, for students with a survey."""
    chapters = null_safe_join(engagement, quiz, [*STUDENT, *chapter_keys])
    return null_safe_join(survey, chapters, STUDENT)


def in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``keys`` that rows of both tables have, each once; a missing key matches a missing key.

    Membership is gathered per key in one aggregation, so repeated rows combine map-side.
    """
    tagged = a.select(*keys, F.lit(True).alias("_a")).unionByName(b.select(*keys, F.lit(False).alias("_a")))
    members = tagged.groupBy(*keys).agg(F.bool_or("_a").alias("_in_a"), (~F.bool_and("_a")).alias("_in_b"))
    return members.filter(F.col("_in_a") & F.col("_in_b")).select(*keys)


def merge_bucketed(
    survey: DataFrame,
    engagement: DataFrame,
    quiz: DataFrame,
    chapter_keys: Sequence[str] = ("chapter", "chapter_num"),
) -> DataFrame:
    """``merge_sources`` of three tables that ``write_bucketed`` wrote by student: no row is moved.

    Students meet on the layout's key alone. A student's chapters are then matched by a
    test on both rows, which the planner cannot take for another join key.
    """
    chapters, students = quiz.select(
        LAYOUT_KEY, F.struct(*chapter_keys).alias("_chapter"), *[c for c in quiz.columns if c not in (*STUDENT, *chapter_keys, LAYOUT_KEY)]
    ), survey.drop(*STUDENT)
    same = F.array_contains(F.array(F.struct(*[F.col(f"e.{c}") for c in chapter_keys])), F.col("q._chapter"))
    matched = engagement.alias("e").join(chapters.alias("q"), (F.col(f"e.{LAYOUT_KEY}") == F.col(f"q.{LAYOUT_KEY}")) & same)
    matched = matched.drop(F.col(f"q.{LAYOUT_KEY}"), F.col("q._chapter"))
    return students.join(matched, LAYOUT_KEY).drop(LAYOUT_KEY)
