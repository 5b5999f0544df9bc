"""Engagement from page views, and its split-half reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join, null_safe_join, planned_bytes
from syllabix.functions.ranks import SMALL_TABLE_BYTES, running_total
from syllabix.functions.text import count_tuples, iterations, strip
from syllabix.session import pin, spread


def completed_text() -> Column:
    """Completion flag stored as text (first study)."""
    return F.col("was_complete") == "true"


def completed_flag() -> Column:
    """Completion flag stored as a boolean (second study)."""
    return F.col("was_complete")


def parse_access_time(df: DataFrame, col: str = "dt_accessed") -> DataFrame:
    """Parse access times (UTC) with optional fractional seconds; unreadable text gives NULL.

    Adds ``<col>_processed`` and its epoch milliseconds, and trims the page title.
    """
    # The zone is part of the text, so the session's time zone does not matter.
    parsed = F.try_to_timestamp(F.concat(F.col(col), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]X"))
    return (
        df.withColumn(f"{col}_processed", parsed)
        .withColumn(f"{col}_processed_ms", F.unix_micros(f"{col}_processed") / 1000)
        .withColumn("page", strip("page"))
    )


def attach_classes(views: DataFrame, classes: DataFrame) -> DataFrame:
    """Institution's class context (release and book) for each view."""
    return lookup_join(views, classes.drop("n_students"), ["institution_id", "class_id"])


def enrich_views(
    views: DataFrame,
    classes: DataFrame,
    pages: DataFrame,
    keep: str = "chapter_num",
) -> DataFrame:
    """Attach class context and page numbers; keep views whose ``keep`` column is known."""
    return lookup_join(attach_classes(views, classes), pages, ["release", "book", "chapter", "page"]).filter(F.col(keep).isNotNull())


def first_completion(
    views: DataFrame,
    keys: Sequence[str] = ("class_id", "student_id", "chapter_num", "page"),
    ts: str = "dt_accessed_processed",
    ordinal: str = "ord",
    completed: Column | None = None,
) -> DataFrame:
    """Earliest completed view per key, with all its columns; ties go to file order.

    The rank filter lets Spark keep one row per key in each map task, so repeated
    views of a page are dropped before the shuffle.
    """
    done = views.filter(completed_text() if completed is None else completed)
    window = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last(), F.col(ordinal).asc_nulls_last())
    return done.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def class_page_totals(
    completions: DataFrame,
    keys: Sequence[str] = ("class_id", "chapter_num"),
    out: str = "total_unique_pages_complete_class",
) -> DataFrame:
    """Distinct pages anyone in the class completed: the most a student could reach."""
    return completions.groupBy(*keys).agg(count_tuples("page").alias(out))


def running_progress(
    first: DataFrame,
    chapter: str = "chapter_num",
    ts: str = "dt_accessed_processed",
) -> DataFrame:
    """Pages and share of pages completed so far and in total, per student and chapter.

    ``first`` holds each page once per student, so a window is at most as long as
    the chapter has pages. It is read twice: pin it if it is expensive.
    """
    totals = class_page_totals(first, ("class_id", chapter))
    whole = Window.partitionBy("class_id", "student_id", chapter)
    by_time = whole.orderBy(F.col(ts).asc_nulls_last(), F.col("page").asc())
    counted = first.withColumns({
        "pages_complete_so_far": F.row_number().over(by_time).cast("bigint"),
        "total_unique_pages_complete_student": F.count(F.lit(1)).over(whole),
    })
    most = F.col("total_unique_pages_complete_class")
    return lookup_join(counted, totals, ["class_id", chapter], "inner").withColumns({
        "proportion_pages_complete_so_far": F.try_divide(F.col("pages_complete_so_far"), most),
        "proportion_pages_complete_student": F.try_divide(F.col("total_unique_pages_complete_student"), most),
    })


def engagement_summary(progress: DataFrame, chapter: Sequence[str] = ("chapter", "chapter_num")) -> DataFrame:
    """One row per student and chapter."""
    return progress.select(
        "book", "release", "institution_id", "class_id", "student_id", *chapter,
        "total_unique_pages_complete_class", "proportion_pages_complete_student",
    ).distinct()


def split_half_assign(first: DataFrame, iters: int = 100, seed: int = 130) -> DataFrame:
    """Split each class's pages at random into two halves, once per iteration.

    A title that occurs in several chapters counts under its first one (lowest
    student, then lowest chapter; a missing student comes last). Halves have ceil(n/2) and floor(n/2) pages. The
    random order is an md5 hash of seed, iteration, class and page, so it does not
    depend on how the data is partitioned. A window holds one class's pages.
    """
    pages = first.groupBy("class_id", "page").agg(
        F.min(F.struct(F.col("student_id").isNull(), "student_id", "chapter_num")).getField("chapter_num").alias("chapter_num")
    )
    draws = pages.withColumn("iter", F.explode(iterations(iters)))
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), "iter", "class_id", "page"))
    of_class = Window.partitionBy("iter", "class_id")
    place = F.row_number().over(of_class.orderBy(ticket, "page"))
    pages_of_class = F.col("total_unique_pages_accessed_class")
    return draws.select(
        "iter", "class_id", "chapter_num", "page",
        ((place - 1) % 2 + 1).cast("bigint").alias("split"),
        F.count(F.lit(1)).over(of_class).alias("total_unique_pages_accessed_class"),
    ).withColumn(
        "split_total",
        F.when(F.col("split") == 1, F.ceil(pages_of_class / 2)).otherwise(F.floor(pages_of_class / 2)),
    )


def split_half_scores(first: DataFrame, halves: DataFrame) -> DataFrame:
    """Share of each half a student completed, per iteration, as ``half_1`` and ``half_2``.

    No completed page in a half gives NULL. A page found under another chapter than
    in ``halves`` belongs to no half. A page's membership packs into one digit per
    iteration: each completion meets it in a measured lookup join, moves once, and is
    unpacked only where a student's counts are summed, on data already partitioned by
    student. The number of iterations is that of ``halves``.
    """
    pages_of_class = F.col("total_unique_pages_accessed_class")
    packed = pin(halves.groupBy("class_id", "chapter_num", "page", pages_of_class).agg(
        F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.struct("iter", "split"))), lambda d: d["split"].cast("string")
        )).alias("_digits")
    ))
    iters = packed.agg(F.max(F.length("_digits"))).first()[0] or 0
    done = first.select("institution_id", "class_id", "student_id", "chapter_num", "page")
    placed = lookup_join(done, packed, ["class_id", "chapter_num", "page"], "left")
    unpacked = spread(placed, "class_id", "student_id").select(
        "institution_id", "class_id", "student_id", pages_of_class,
        F.posexplode(F.split(F.coalesce("_digits", F.lit("0" * iters)), "")).alias("_at", "_half"),
    ).withColumn("iter", (F.col("_at") + 1).cast("bigint"))
    most = F.max(pages_of_class)

    def share(half: int, size: Column) -> Column:
        done_in_half = F.nullif(F.count_if(F.col("_half") == str(half)), F.lit(0))
        return F.try_divide(done_in_half, size).alias(f"half_{half}")

    return unpacked.groupBy("iter", "institution_id", "class_id", "student_id").agg(
        share(1, F.ceil(most / 2)), share(2, F.floor(most / 2))
    )


def split_half_reliability(scores: DataFrame) -> DataFrame:
    """Pearson, Spearman and Spearman-Brown correlation of the halves, per iteration.

    Students without both halves are left out. Students are first counted per pair
    of shares: a share is a ratio of two page counts, so these tables stay small
    whatever the number of students, and one iteration's pairs fit a window. Beyond
    ``SMALL_TABLE_BYTES`` of pairs, ranks come from running totals that may span tasks and means from joins.
    """
    pairs = pin(
        scores.filter(F.col("half_1").isNotNull() & F.col("half_2").isNotNull())
        .groupBy("iter", "half_1", "half_2")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    ranked = _window_ranks(pairs) if planned_bytes(pairs) <= SMALL_TABLE_BYTES else _joined_ranks(pairs)

    def product(a: str, b: str) -> Column:
        return F.sum(F.col("w") * (F.col(a) - F.col(f"_mean_{a}")) * (F.col(b) - F.col(f"_mean_{b}")))

    def correlation(a: str, b: str) -> Column:
        varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        return F.when(varies, F.try_divide(product(a, b), F.sqrt(product(a, a) * product(b, b))))

    return (
        ranked.groupBy("iter")
        .agg(
            F.sum("w").alias("n"),
            correlation("half_1", "half_2").alias("pearson"),
            correlation("rank_1", "rank_2").alias("spearman"),
        )
        .withColumn("spearman_brown", F.try_divide(2 * F.col("pearson"), 1 + F.col("pearson")))
    )


MEASURED = ("half_1", "half_2", "rank_1", "rank_2")


def _window_ranks(pairs: DataFrame) -> DataFrame:
    """Ranks of both shares and the means of shares and ranks, in windows over the pairs of one iteration."""
    of_iter = Window.partitionBy("iter")
    ranked = pairs
    for at in ("1", "2"):
        # Up to and with the ties of a share, less half of them.
        upto = F.sum("w").over(of_iter.orderBy(f"half_{at}").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.sum("w").over(Window.partitionBy("iter", f"half_{at}"))
        ranked = ranked.withColumn(f"rank_{at}", upto - (ties - 1) / 2)
    total = F.sum("w").over(of_iter)
    return ranked.withColumns({f"_mean_{c}": F.sum(F.col(c) * F.col("w")).over(of_iter) / total for c in MEASURED})


def _joined_ranks(pairs: DataFrame) -> DataFrame:
    """The same by running totals per share, which hold any number of shares, and joins with the results."""
    ranked = pairs
    for at in ("1", "2"):
        shares = ranked.groupBy("iter", f"half_{at}").agg(F.sum("w").alias("_ties"))
        upto = running_total(shares, ["iter"], [F.col(f"half_{at}")], "_upto", "_ties")
        ranks = upto.select("iter", f"half_{at}", (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(f"rank_{at}"))
        ranked = lookup_join(ranked, ranks, ["iter", f"half_{at}"], "inner")
    means = ranked.groupBy("iter").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"_mean_{c}") for c in MEASURED])
    return lookup_join(ranked, means, ["iter"], "inner")


def interval_summary(df: DataFrame, cols: Sequence[str], lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Mean and percentile interval of each column over iterations, one row per column.

    The input has one row per iteration, which bounds the exact percentile's state.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("m")).select("m.*")
    return long.groupBy("measure").agg(
        F.avg("value").alias("mean"),
        F.percentile("value", lo).alias("lb"),
        F.percentile("value", hi).alias("ub"),
    )
