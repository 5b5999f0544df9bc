"""k-means clustering of profile tables and of constructs by their correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join
from syllabix.session import pin

Starts = list[np.ndarray]


# Rounds of seeding, and rows that a round draws for every cluster.
SEED_ROUNDS, SEED_ROWS = 4, 3
# Beyond so many tasks their sums are added up in so many groups before the driver adds those.
DIRECT_TASKS, SUM_GROUPS = 64, 16


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for pdf in batches:
        yield from np.array_split(pdf.to_numpy(dtype=float), max(1, len(pdf) // 1000))


def _worked(points: DataFrame) -> DataFrame:
    """The table in as many tasks as run at the same time, so what they send does not grow with its partitions."""
    return points.coalesce(points.sparkSession.sparkContext.defaultParallelism)


def _drawn(points: DataFrame, features: Sequence[str], known: np.ndarray, size: int, seed: int, turn: int) -> np.ndarray:
    """``size`` rows of the whole table, drawn without replacement in proportion to their squared distance from the ``known`` ones.

    Each row has the key -ln(u) / distance with u from a hash of its values; the rows of the
    smallest keys are such a draw. Tasks keep their smallest, so a round is one pass.
    """
    ticket = F.xxhash64(F.lit(seed), F.lit(turn), *features)
    uniform = ((F.shiftrightunsigned(ticket, 11).cast("double") + 0.5) / float(1 << 53)).alias("u")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((0, len(features) + 1))
        for rows in _slices(batches):
            x, u = rows[:, :-1], rows[:, -1]
            apart = _nearest(x, known).min(axis=1) if len(known) else np.ones(len(x))
            # A row that is known already has distance 0 up to rounding.
            far = apart > 1e-12 * (1 + (x * x).sum(axis=1))
            key = -np.log(u[far]) / apart[far]
            kept = np.unique(np.vstack([kept, np.column_stack([key, x[far]])]), axis=0)[:size]
        yield pd.DataFrame(kept, columns=["key", *features])

    found = _worked(points.select(*features, uniform)).mapInPandas(best, "key double, " + ", ".join(f"`{f}` double" for f in features))
    rows = found.distinct().orderBy("key", *features).limit(size).collect()
    return np.array([list(r)[1:] for r in rows], dtype=float).reshape(-1, len(features))


def seeds(points: DataFrame, features: Sequence[str], most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows to start up to ``most`` clusters from, and how many rows of the table are nearest to each.

    Every round draws ``SEED_ROWS * most`` rows of the whole table, the likelier the farther
    they are from those drawn before, so a small cluster far from the others is found as
    well; few rounds replace one draw per centre. The driver holds ``SEED_ROUNDS`` draws.
    """
    known = np.empty((0, len(features)))
    for turn in range(SEED_ROUNDS):
        more = _drawn(points, features, known, SEED_ROWS * most, seed, turn)
        if not len(more):
            break
        known = np.vstack([known, more])
    if not len(known):
        return known, np.empty(0)
    return known, _sums(points, features, [known])[0][:, 0]


def _spread_start(pool: np.ndarray, weight: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` rows of the pool, each drawn by its weight times its squared distance from those drawn before."""
    chosen = [int(random.choice(len(pool), p=weight / weight.sum()))]
    while len(chosen) < k:
        apart = ((pool[:, None, :] - pool[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        apart[chosen] = 0
        share = apart * weight
        if not share.sum():
            share = np.where(np.isin(np.arange(len(pool)), chosen), 0.0, 1.0)
        chosen.append(int(random.choice(len(pool), p=share / share.sum())))
    return pool[chosen]


def lloyd(
    points: DataFrame, features: Sequence[str], starts: Starts, max_iter: int
) -> tuple[Starts, np.ndarray, np.ndarray]:
    """Improve many sets of centres at the same time; returns them, their costs, and whether they have settled.

    Each round is one pass over the rows for all moving sets together: see ``_sums``. Sets
    that stay in place leave the rounds; a last pass takes the costs of those that
    ``max_iter`` rounds did not settle. An empty cluster keeps its centre.
    """
    current, costs, settled = list(starts), np.zeros(len(starts)), np.zeros(len(starts), bool)
    for turn in range(max_iter + 1):
        moving = np.flatnonzero(~settled).tolist()
        if not moving:
            break
        for s, rows in zip(moving, _sums(points, features, [current[s] for s in moving]), strict=True):
            n, costs[s] = rows[:, :1], rows[:, 1].sum()
            if turn < max_iter:
                moved = np.where(n > 0, rows[:, 3:] / np.maximum(n, 1), current[s])
                settled[s] = np.array_equal(moved, current[s])
                current[s] = moved
    return current, costs, settled


def _added(points: DataFrame, features: Sequence[str], totals: Callable[[Iterator[np.ndarray]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """``totals`` of every task's rows, added up.

    A task sends one packed row. Up to ``DIRECT_TASKS`` of them go to the driver; more are
    added up by ``SUM_GROUPS`` tasks first.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"sums": [totals(_slices(batches)).tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]})

    packed = _worked(points.select(*features)).mapInPandas(partial, "sums binary")
    if points.sparkSession.sparkContext.defaultParallelism > DIRECT_TASKS:
        packed = packed.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)).alias("_group")).applyInPandas(added, "sums binary")
    return np.sum([np.zeros(shape), *[np.frombuffer(r["sums"]).reshape(shape) for r in packed.collect()]], axis=0)


def _sums(points: DataFrame, features: Sequence[str], centres: Starts) -> list[np.ndarray]:
    """Per set, a row for every centre: number of its rows, their cost, their summed squared norms and their summed coordinates."""
    first = np.cumsum([0, *[len(c) for c in centres]])
    stacked = np.vstack(centres)

    def totals(slices: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(stacked), 3 + len(features)))
        for x in slices:
            distance = _nearest(x, stacked)
            member = np.zeros_like(distance)
            for at, of_set in zip(first, centres):
                nearest = distance[:, at:at + len(of_set)].argmin(axis=1)
                member[np.arange(len(x)), at + nearest] = 1.0
            out[:, 0] += member.sum(axis=0)
            out[:, 1] += (member * distance).sum(axis=0)
            out[:, 2] += (x * x).sum(axis=1) @ member
            out[:, 3:] += member.T @ x
        return out

    return np.split(_added(points, features, totals, (len(stacked), 3 + len(features))), first[1:-1])


def silhouettes(points: DataFrame, features: Sequence[str], centres: Starts) -> list[float]:
    """Mean squared-Euclidean silhouette of every set of centres, in two passes over the rows for all sets together.

    The first pass sums points and squared norms per cluster; with them a row's mean
    squared distance from all points of a cluster needs no other row. A row alone in its
    cluster, or in the only one, has silhouette 0.
    """
    sums = _sums(points, features, centres)

    def totals(slices: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(centres), 2))
        for x in slices:
            norms = (x * x).sum(axis=1)[:, None]
            for at, (of_set, rows) in enumerate(zip(centres, sums)):
                n = rows[:, 0]
                own = _nearest(x, of_set).argmin(axis=1)
                each = np.arange(len(x))
                mean = norms + (rows[:, 2] - 2 * x @ rows[:, 3:].T) / np.maximum(n, 1)
                a = mean[each, own] * n[own] / np.maximum(n[own] - 1, 1)
                mean[each, own] = np.inf
                mean[:, n == 0] = np.inf
                b = mean.min(axis=1)
                known = (n[own] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
                out[at] += (((b - a) / np.maximum(a, b))[known].sum() if known.any() else 0.0, len(x))
        return out

    found = _added(points, features, totals, (len(centres), 2))
    return [float(total / n) if n else 0.0 for total, n in found]


def nearest_cluster(features: Sequence[str], centres: np.ndarray) -> Column:
    """Index 1..k of the closest centre."""
    distances = F.array(*[
        sum(((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(features, centre)), F.lit(0.0)) for centre in centres
    ])
    return F.array_position(distances, F.array_min(distances)).cast("bigint")


def best_centres(
    points: DataFrame, features: Sequence[str], ks: Sequence[int], restarts: int, max_iter: int, seed: int
) -> dict[int, tuple[np.ndarray, float, bool]]:
    """Per number of clusters, the centres of least cost over ``restarts`` random starts, the cost, and whether they settled.

    Starts come from the rows that ``seeds`` draws from the whole table, for every restart
    spread over them by their weight and distance; all rows are clustered. More clusters
    than distinct rows are refused.
    """
    pool, weight = seeds(points, features, max(ks), seed)
    if len(pool) < max(ks):
        raise ValueError(f"{max(ks)} clusters need as many distinct complete rows, there are {len(pool)}")
    random = np.random.default_rng(seed)
    plan = [k for k in ks for _ in range(restarts)]
    starts = [_spread_start(pool, weight, k, random) for k in plan]
    best: dict[int, tuple[np.ndarray, float, bool]] = {}
    for k, c, cost, settled in zip(plan, *lloyd(points, features, starts, max_iter), strict=True):
        if k not in best or cost < best[k][1]:
            best[k] = (c, float(cost), bool(settled))
    return best


def _scaled(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with z-scored features; a constant feature becomes 0."""
    complete = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).na.drop(subset=list(features))
    scale = complete.agg(*[g(f) for f in features for g in (F.avg, F.stddev_samp)]).first()
    return complete.select(*keep, *[
        ((F.col(f) - scale[2 * i]) / (scale[2 * i + 1] or 1.0)).alias(f) for i, f in enumerate(features)
    ])


def choose_k(
    df: DataFrame,
    features: Sequence[str],
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    restarts: int = 50,
    max_iter: int = 15,
    seed: int = 1,
) -> DataFrame:
    """Mean silhouette per number of clusters of many rows, on z-scored features; ``best`` marks the highest.

    The silhouette is the squared-Euclidean one, which needs no distances between pairs
    of rows (see ``silhouettes``). The scaled table is pinned. ``cost`` belongs to the returned centres and
    ``converged`` tells whether they had settled after ``max_iter`` rounds. Starts: see
    ``best_centres``.
    """
    points = pin(_scaled(df, features))
    best = best_centres(points, features, ks, restarts, max_iter, seed)
    widths = silhouettes(points, features, [centres for centres, _, _ in best.values()])
    return _marked(df, [(k, cost, width, settled) for (k, (_, cost, settled)), width in zip(best.items(), widths, strict=True)])


def _marked(df: DataFrame, rows: list[tuple[int, float, float, bool]]) -> DataFrame:
    top = max(rows, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame(
        [(k, cost, silhouette, k == top, settled) for k, cost, silhouette, settled in rows],
        "k bigint, cost double, silhouette double, best boolean, converged boolean",
    )


def choose_k_of_profiles(
    profiles: DataFrame,
    name: str,
    features: Sequence[str],
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    restarts: int = 50,
    max_iter: int = 15,
    seed: int = 1,
) -> DataFrame:
    """``choose_k`` for a table of one row per variable, with the Euclidean silhouette.

    Distances between all pairs of variables come from an equi-join on the feature, so
    this is for profile tables, whose rows are as few as their columns. A variable alone
    in its cluster has silhouette 0.
    """
    points = pin(_scaled(profiles, features, [name]))
    long = points.unpivot([name], [F.col(f) for f in features], "feature", "z")
    other = long.select(F.col(name).alias("other"), "feature", F.col("z").alias("z_other"))
    apart = pin(
        long.join(other, "feature").groupBy(name, "other")
        .agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("z_other"), F.lit(2)))).alias("distance"))
    )
    best = best_centres(points, features, ks, restarts, max_iter, seed)
    own = [F.struct(F.lit(k).alias("k"), nearest_cluster(features, centres).alias("own")) for k, (centres, _, _) in best.items()]
    member = points.select(name, F.inline(F.array(*own)))
    theirs = member.select(F.col(name).alias("other"), "k", F.col("own").alias("theirs"))
    joined = lookup_join(lookup_join(apart, member, [name], "inner"), theirs, ["other", "k"], "inner")
    per_cluster = joined.groupBy("k", name, "own", "theirs").agg(F.sum("distance").alias("total"), F.count(F.lit(1)).alias("n"))
    same = F.col("own") == F.col("theirs")
    widths = per_cluster.groupBy("k", name).agg(
        F.max(F.when(same, F.col("n"))).alias("size"),
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    width = F.when(F.col("size") == 1, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    mean = {r["k"]: float(r["width"]) for r in widths.groupBy("k").agg(F.avg(width).alias("width")).collect()}  # one row per k
    return _marked(profiles, [(k, cost, mean[k], settled) for k, (_, cost, settled) in best.items()])


def cluster_rows(
    df: DataFrame,
    features: Sequence[str],
    k: int = 2,
    restarts: int = 10,
    max_iter: int = 15,
    seed: int = 1,
) -> DataFrame:
    """Each complete row with its ``cluster`` 1..k, from k-means on the unscaled features; starts: see ``best_centres``."""
    points = pin(df.select(*[F.col(f).cast("double").alias(f) for f in features]).na.drop())
    centres = best_centres(points, features, [k], restarts, max_iter, seed)[k][0]
    return df.na.drop(subset=list(features)).withColumn("cluster", nearest_cluster(features, centres))


def correlation_profiles(cells: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per variable holding its correlation with every variable."""
    return cells.groupBy(F.col("var_i").alias("variable")).pivot("var_j", list(cols)).agg(F.max("r"))


def cluster_profiles(cells: DataFrame, cols: Sequence[str], k: int = 2, restarts: int = 50) -> DataFrame:
    """Correlation table with the cluster of both variables, ordered by cluster.

    Variables are clustered on their unscaled rows of the correlation matrix, so
    k-means, the windows and the join below see one row per variable. Clusters are
    numbered by their alphabetically first variable.
    """
    found = cluster_rows(correlation_profiles(cells, cols), cols, k, restarts).select("variable", "cluster")
    leader = F.min("variable").over(Window.partitionBy("cluster"))
    number = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("_leader")).cast("bigint")
    members = found.withColumn("_leader", leader).select("variable", number.alias("cluster"))
    left = members.withColumnsRenamed({"variable": "var_i", "cluster": "cluster_i"})
    right = members.withColumnsRenamed({"variable": "var_j", "cluster": "cluster_j"})
    return (
        lookup_join(lookup_join(cells, left, ["var_i"], "inner"), right, ["var_j"], "inner")
        .orderBy("cluster_i", "var_i", "cluster_j", "var_j")
        .select("var_i", "cluster_i", "var_j", "cluster_j", "r", "p")
    )
