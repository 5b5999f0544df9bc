"""Stratified bootstrap of model comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join, null_safe_join
from syllabix.functions.moments import complete_cases, fold_by_size, triangle
from syllabix.functions.ranks import MAX_GROUP_ROWS, running_total
from syllabix.functions.text import iterations
from syllabix.operators.engagement import interval_summary
from syllabix.operators.models import mixed_rows
from syllabix.session import pin, spread

BOOTSTRAP_SCHEMA = "iter bigint, model string, aic double"


def _draw(seed: int, stratum: str, slot: Column, size: Column) -> Column:
    """A position 1..size from the first 8 hex digits of an md5 hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("iter"), F.col(stratum), slot))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % size + 1


def numbered_entities(
    df: DataFrame, stratum: str, entity: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Distinct entities numbered 1..n inside their stratum, with the stratum's size."""
    entities = pin(df.select(stratum, entity).distinct())
    sizes = entities.groupBy(stratum).agg(F.count(F.lit(1)).alias("stratum_size"))
    numbered = running_total(entities, [stratum], [F.col(entity).asc_nulls_last()], "slot", max_group_rows=max_group_rows)
    return lookup_join(numbered, sizes, [stratum], "inner")


def stratified_resample(
    df: DataFrame,
    stratum: str,
    entity: str,
    iters: int = 100,
    seed: int = 123,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Draw, per iteration and stratum, as many entities as it has, with replacement.

    Returns weights ``(iter, stratum, entity, w)``; entities never drawn are absent.
    Every entity makes one draw per iteration from its own slot number, and entities
    are spread over all tasks first, so a large stratum does not draw in one task.
    """
    numbered = pin(numbered_entities(df, stratum, entity, max_group_rows))
    draws = (
        spread(numbered, stratum, "slot").select(stratum, "slot", "stratum_size", F.explode(iterations(iters)).alias("iter"))
        .select("iter", stratum,
                _draw(seed, stratum, F.col("slot"), F.col("stratum_size")).alias("slot"))
        .groupBy("iter", stratum, "slot")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    return null_safe_join(draws, numbered.drop("stratum_size"), [stratum, "slot"]).select("iter", stratum, entity, "w")


def bootstrap_moments(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    group: str,
    entity: str,
    iters: int = 100,
    seed: int = 123,
) -> DataFrame:
    """Folded moments of every bootstrap sample, without copying rows.

    The iterations that drew an entity travel as one list (at most ``iters`` long)
    beside the entity's rows; they are unpacked only where weighted sums are taken.
    """
    cols = [*xs, y]
    k = len(cols)
    # Read once: the draws, the centre and the join all start from here.
    rows = pin(complete_cases(df, cols, also=[group, entity]))
    weights = stratified_resample(rows, group, entity, iters, seed)
    packed = weights.groupBy(group, entity).agg(F.collect_list(F.struct("iter", "w")).alias("_draws"))
    # One row of means: sums of products are taken about them, for accuracy.
    centre = rows.agg(*[F.avg(c) for c in cols]).first()
    shifted = rows.select(group, entity, *[
        (F.col(c) - F.lit(m if m is not None else 0.0)).alias(f"z_{i}") for i, (c, m) in enumerate(zip(cols, centre))
    ])
    drawn = spread(null_safe_join(shifted, packed, [group, entity]), group, entity).select(
        group, *[f"z_{i}" for i in range(k)], F.inline("_draws")
    )
    sums = [F.sum("w").alias("n")]
    sums += [F.sum(F.col("w") * F.col(f"z_{i}")).alias(f"t_{i}") for i in range(k)]
    sums += [F.sum(F.col("w") * F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"u_{i}_{j}") for i, j in triangle(k)]
    groups = drawn.groupBy("iter", group).agg(*sums).select(
        "iter", "n",
        *[(F.col(f"t_{i}") / F.col("n")).alias(f"m_{i}") for i in range(k)],
        *[(F.col(f"u_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("n")).alias(f"s_{i}_{j}") for i, j in triangle(k)],
    )
    return fold_by_size(groups, k, by=["iter"])


def bootstrap_models(
    df: DataFrame,
    y: str,
    group: str,
    entity: str,
    specs: Mapping[str, Sequence[str]],
    iters: int = 100,
    seed: int = 123,
) -> DataFrame:
    """AIC of every model in every bootstrap sample: one row per iteration and model.

    An iteration in which any model cannot be fitted is dropped.
    """
    xs = list(dict.fromkeys(x for chosen in specs.values() for x in chosen))
    order = {name: [xs.index(x) for x in chosen] for name, chosen in specs.items()}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            fits = [(int(pdf["iter"].iloc[0]), r[0], r[-1]) for r in mixed_rows(pdf, xs, order) if r[1] == "(Intercept)"]
        except (np.linalg.LinAlgError, ValueError):
            fits = []
        if not all(np.isfinite(aic) for _, _, aic in fits):
            fits = []
        return pd.DataFrame(fits, columns=["iter", "model", "aic"])

    moments = bootstrap_moments(df, y, xs, group, entity, iters, seed)
    # Solving takes far longer than the few bytes of moments suggest: one partition
    # per core, which adaptive execution must not merge.
    tasks = min(iters, df.sparkSession.sparkContext.defaultParallelism)
    return moments.repartition(tasks, "iter").groupBy("iter").applyInPandas(solve, BOOTSTRAP_SCHEMA)


def bootstrap_relative(
    aics: DataFrame,
    models: Sequence[str],
    baseline: str,
    against: str | None = None,
    against_models: Sequence[str] = (),
) -> DataFrame:
    """Per iteration, each model's AIC minus the baseline's (``rel_*``).

    ``against`` adds differences of ``against_models`` to a second model, named
    ``<against>_rel_*``.
    """
    wide = aics.groupBy("iter").pivot("model", list(models)).agg(F.max("aic"))
    columns = [(F.col(m) - F.col(baseline)).alias(f"rel_{m}") for m in models]
    if against is not None:
        columns += [(F.col(m) - F.col(against)).alias(f"{against}_rel_{m}") for m in against_models]
    return wide.select("iter", *columns)


def transpose_summary(df: DataFrame, actual: DataFrame, prefix: str = "rel_") -> DataFrame:
    """Mean and interval per model over iterations, beside the value on the actual data.

    Models without an actual value keep NULL there.
    """
    summary = interval_summary(df, [c for c in df.columns if c.startswith(prefix)])
    named = summary.withColumn("model", F.expr(f"substring(measure, {len(prefix) + 1})")).drop("measure")
    return null_safe_join(named, actual, ["model"], "left").select("model", "mean", "lb", "ub", "aic_value")
