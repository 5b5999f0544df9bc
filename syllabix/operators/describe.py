"""Descriptive tables: shares, frames, correlations, densities, trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join, null_safe_join
from syllabix.functions.ranks import count_quantiles
from syllabix.functions.tails import t_critical, t_p_value
from syllabix.functions.text import mean_of
from syllabix.session import pin


def widen_labels(
    entities: DataFrame,
    labels: DataFrame,
    values: Sequence[str],
    ids: Sequence[str] = ("class_id", "student_id"),
    names: str = "variable_name",
    value: str = "response_label",
) -> DataFrame:
    """Labels as one column per variable, left-joined to the distinct entities.

    A repeated answer keeps the alphabetically last label.
    """
    wide = labels.groupBy(*ids).pivot(names, list(values)).agg(F.max(value))
    return null_safe_join(entities.select(*ids).distinct(), wide, ids, "left")


def category_share(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage per category, most frequent first; missing is a category."""
    counts = pin(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).first()[0]
    return (
        counts.withColumn("total_count", F.lit(total).cast("bigint"))
        .withColumn("percentage", F.col("count") * 100 / F.col("total_count"))
        .orderBy(F.col("percentage").desc(), F.col(col).asc_nulls_last())
    )


def model_frame(
    df: DataFrame,
    cols: Sequence[str],
    exclude: Mapping[str, Sequence] | None = None,
    drop_missing: bool = True,
) -> DataFrame:
    """Analysis columns, without excluded ids and (optionally) without incomplete rows."""
    frame = df.select(*cols)
    for column, ids in (exclude or {}).items():
        frame = frame.filter(~F.col(column).isin(list(ids)))
    return frame.na.drop() if drop_missing else frame


def entity_average(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str],
    order_by: Sequence[str],
) -> DataFrame:
    """Average measures per entity; the other columns come from its first row by ``order_by``."""
    others = [c for c in df.columns if c not in {*keys, *measures.values()}]
    position = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order_by])
    return df.groupBy(*keys).agg(
        *([F.min_by(F.struct(*others), position).alias("_first")] if others else []),
        *[F.avg(c).alias(out) for out, c in measures.items()],
    ).select(*keys, *[F.col("_first").getField(c).alias(c) for c in others], *measures)


def correlation_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete n and centred sums for every pair of columns, in one aggregation."""
    sums = []
    for i, j in combinations(range(len(cols)), 2):
        # regr_* takes (dependent, independent) and skips rows missing either.
        pair = (F.col(cols[j]), F.col(cols[i]))
        sums += [
            F.regr_count(*pair).alias(f"n_{i}_{j}"),
            F.regr_sxx(*pair).alias(f"xx_{i}_{j}"),
            F.regr_syy(*pair).alias(f"yy_{i}_{j}"),
            F.regr_sxy(*pair).alias(f"xy_{i}_{j}"),
        ]
    return df.agg(*sums).select(F.inline(F.array(*[
        F.struct(
            F.lit(cols[i]).alias("var_i"), F.lit(cols[j]).alias("var_j"),
            F.col(f"n_{i}_{j}").alias("n"), F.col(f"xx_{i}_{j}").alias("sxx"),
            F.col(f"yy_{i}_{j}").alias("syy"), F.col(f"xy_{i}_{j}").alias("sxy"),
        )
        for i, j in combinations(range(len(cols)), 2)
    ])))


def pearson(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from centred sums, kept within [-1, 1]; NULL if either side is constant."""
    r = F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per pair of columns: n, r, t, raw two-sided p and Holm-adjusted p.

    The input has one row per entity. Only one row of moments per pair goes on from
    the first aggregation.
    """
    r = F.col("r")
    tested = (
        correlation_moments(df, cols)
        .withColumn("r", pearson(F.col("sxy"), F.col("sxx"), F.col("syy")))
        .withColumn("df", (F.col("n") - 2).cast("double"))
        .withColumn("t", F.when(F.col("df") > 0, F.try_divide(r * F.sqrt("df"), F.sqrt(1 - r * r))))
        .withColumn("p", F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p_value("t", "df")))
        .withColumn("_all", F.lit(1))
    )
    by_p = Window.partitionBy("_all").orderBy(F.col("p").asc_nulls_last(), "var_i", "var_j")
    tests = F.count("p").over(Window.partitionBy("_all"))
    step = F.least(F.lit(1.0), F.col("p") * (tests - F.row_number().over(by_p) + 1))
    return (
        tested.withColumn("_step", step)
        .withColumn("p_holm", F.when(F.col("p").isNotNull(), F.max("_step").over(
            by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        .select("var_i", "var_j", "n", "r", "t", "p", "p_holm")
    )


def full_correlation_table(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every cell of the matrix: raw p below the diagonal, Holm-adjusted p above it."""
    upper = pairs.select("var_i", "var_j", "r", F.col("p_holm").alias("p"))
    lower = pairs.select(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "r", "p")
    spark = pairs.sparkSession
    diagonal = spark.createDataFrame([(c, c, 1.0, 0.0) for c in cols], "var_i string, var_j string, r double, p double")
    return upper.unionByName(lower).unionByName(diagonal)


# Cells over which a group's values are shared, whatever their number.
DENSITY_CELLS = 1024


def density_by_group(
    df: DataFrame,
    x: str,
    group: str,
    adjust: float = 1.0,
    limits: tuple[float, float] | None = None,
    n_grid: int = 512,
    cells: int = DENSITY_CELLS,
) -> DataFrame:
    """Gaussian kernel density per group on ``n_grid`` points.

    Values outside ``limits`` are dropped; without limits the grid spans the data of
    all groups. Bandwidth is ``adjust * 0.9 * min(sd, IQR / 1.34) * n^(-1/5)``; a zero
    spread falls back to sd, then to the value itself, then to 1. Every value is shared
    linearly between the two nearest of ``cells`` points that divide its own group's span
    evenly, and the kernel is summed over these points. The rule is the same at every
    size and for every group alone, and bounds the work per group. A group with one value
    has the density of that value.
    """
    data = df.select(F.col(group).alias("grp"), F.col(x).cast("double").alias("x")).filter(F.col("x").isNotNull())
    if limits is not None:
        data = data.filter(F.col("x").between(*limits))
    # Everything below follows from the distinct values and their counts.
    counts = pin(data.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("w")))
    least_x, most_x = counts.agg(F.min("x"), F.max("x")).first()
    low, high = limits if limits is not None else (least_x, most_x)

    middle = ((least_x or 0.0) + (most_x or 0.0)) / 2
    off = F.col("x") - F.lit(middle)
    rows = F.sum("w")
    squares = F.sum(F.col("w") * off * off) - F.pow(F.sum(F.col("w") * off), F.lit(2)) / rows
    spread = F.least("_sd", F.col("_iqr") / 1.34)
    base = F.coalesce(
        F.nullif(spread, F.lit(0.0)), F.nullif(F.col("_sd"), F.lit(0.0)),
        F.nullif(F.abs(F.col("_min")), F.lit(0.0)), F.lit(1.0),
    )
    moments = counts.groupBy("grp").agg(
        rows.alias("n"), F.min("x").alias("_min"), F.max("x").alias("_max"),
        F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.sqrt(F.try_divide(squares, F.nullif(rows - 1, F.lit(0))))).alias("_sd"),
    )
    quartiles = count_quantiles(counts, ["grp"], "x", "w", {"_q1": 0.25, "_q3": 0.75})
    stats = pin(null_safe_join(moments, quartiles, ["grp"]).withColumn("_iqr", F.col("_q3") - F.col("_q1")).select(
        "grp", "n", "_min", ((F.col("_max") - F.col("_min")) / (cells - 1)).alias("_width"),
        (F.lit(0.9 * adjust) * base * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"),
    ))
    at = F.coalesce(F.try_divide(F.col("x") - F.col("_min"), F.col("_width")), F.lit(0.0))
    left = F.least(F.floor(at), F.lit(cells - 2))
    shared = (
        lookup_join(counts, stats.select("grp", "_min", "_width"), ["grp"], "inner")
        .withColumn("_share", at - left)
        .select("grp", F.inline(F.array(
            F.struct(left.alias("cell"), (F.col("w") * (1 - F.col("_share"))).alias("w")),
            F.struct((left + 1).alias("cell"), (F.col("w") * F.col("_share")).alias("w")),
        )))
        .groupBy("grp", "cell").agg(F.sum("w").alias("w")).filter("w > 0")
    )
    points = lookup_join(shared, stats, ["grp"], "inner").select(
        "grp", "n", "bw", "w", (F.col("_min") + F.col("cell") * F.col("_width")).alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("i"),
    )
    step = 0.0 if low is None else (high - low) / (n_grid - 1)
    z = (F.lit(low or 0.0) + F.col("i") * F.lit(step) - F.col("x")) / F.col("bw")
    height = F.col("w") * F.exp(-0.5 * z * z)
    return (
        points.groupBy(F.col("grp").alias(group), F.col("i").cast("bigint").alias("grid_index"), "n", "bw")
        .agg(F.sum(height).alias("_height"))
        .select(
            group, "grid_index",
            (F.lit(low or 0.0) + F.col("grid_index") * F.lit(step)).alias("x"),
            (F.col("_height") / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi()))).alias("density"),
        )
    )


def trend_by_group(
    df: DataFrame,
    xs: Sequence[str],
    y: str,
    n_grid: int = 80,
    level: float = 0.95,
) -> DataFrame:
    """Least-squares line with confidence band for ``y`` on each of ``xs``.

    The wide input is turned long, reduced to moments per variable, and the line is
    evaluated on ``n_grid`` points over the observed range of that variable.
    """
    long = df.unpivot(
        [y], [F.col(c) for c in xs], "construct_variable", "value"
    ).filter(F.col(y).isNotNull() & F.col("value").isNotNull())
    pair = (F.col(y), F.col("value"))
    fits = long.groupBy("construct_variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_avgx(*pair).alias("mx"), F.regr_avgy(*pair).alias("my"),
        F.regr_sxx(*pair).alias("sxx"), F.regr_syy(*pair).alias("syy"), F.regr_sxy(*pair).alias("sxy"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).withColumn("slope", F.try_divide("sxy", "sxx")).withColumn("df", (F.col("n") - 2).cast("double")).withColumn(
        "s2", F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.when(F.col("df") > 0, F.col("df")))
    ).withColumn("q", t_critical(F.lit(0.5 + level / 2), F.col("df")))
    grid = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1)))).withColumn(
        "x", F.col("low") + F.col("i") * (F.col("high") - F.col("low")) / (n_grid - 1)
    )
    off = F.col("x") - F.col("mx")
    return (
        grid.withColumn("fit", F.col("my") + F.col("slope") * off)
        .withColumn("se", F.sqrt(F.when(F.col("s2") < 0, 0.0).otherwise(F.col("s2")) * (1 / F.col("n") + F.try_divide(off * off, F.col("sxx")))))
        .select(
            "construct_variable", F.col("i").cast("bigint").alias("grid_index"), "x", "fit", "se",
            (F.col("fit") - F.col("q") * F.col("se")).alias("lower"),
            (F.col("fit") + F.col("q") * F.col("se")).alias("upper"),
        )
    )


def group_means(df: DataFrame, group: str, cols: Mapping[str, str]) -> DataFrame:
    """Mean per group; ``cols`` maps output name to column."""
    return df.groupBy(group).agg(*[F.avg(c).alias(out) for out, c in cols.items()])


def row_mean(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Mean of several columns of a row, ignoring missing ones."""
    return df.withColumn(out, mean_of([F.col(c) for c in cols]))


def attach_assessment(
    df: DataFrame, grades: DataFrame, cols: Sequence[str] = ("quiz_mean",), required: str = "quiz_mean"
) -> DataFrame:
    """Gradebook columns joined on the student alone; rows without the required grade are dropped."""
    wanted = grades.select("student_id", *cols)
    return null_safe_join(df, wanted, ["student_id"], "left").filter(F.col(required).isNotNull())


def condition_frame(
    df: DataFrame,
    rename: Mapping[str, str],
    source: str | None = None,
    arm: str = "module_variation",
    arms: Sequence[str] = ("A", "B"),
) -> DataFrame:
    """One survey wave's complete answers for the compared arms, with constructs renamed."""
    wave = df if source is None else df.filter(F.col("source") == source)
    return (
        wave.select("student_id", arm, *rename)
        .withColumnsRenamed(dict(rename))
        .na.drop()
        .filter(F.col(arm).isin(list(arms)))
    )
