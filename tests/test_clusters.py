import numpy as np
import pytest

from syllabix.operators import clusters, describe


def blobs(spark, centres=((0, 0), (10, 0), (0, 10)), each=30):
    random = np.random.default_rng(0)
    rows = [(k * each + i, k, *map(float, np.array(c) + random.normal(size=2))) for k, c in enumerate(centres) for i in range(each)]
    return spark.createDataFrame(rows, "id int, truth int, a double, b double")


def test_best_k_is_the_number_of_blobs(spark):
    got = clusters.choose_k(blobs(spark), ["a", "b"], restarts=8).collect()
    assert [r.k for r in got] == [2, 3, 4, 5, 6]
    assert [r.k for r in got if r.best] == [3]
    cost = [r.cost for r in got]
    assert cost == sorted(cost, reverse=True)


def test_partition_is_stable_over_seeds(spark):
    for seed in (1, 2, 3):
        rows = clusters.cluster_rows(blobs(spark), ["a", "b"], k=3, restarts=8, seed=seed).collect()
        assert len({(r.truth, r.cluster) for r in rows}) == 3 and {r.cluster for r in rows} == {1, 2, 3}


def test_cost_is_within_cluster_squares(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (12.0,)], "a double")
    best = clusters.best_centres(df, ["a"], [2], 5, 15, 1)[2]
    assert sorted(best[0].ravel()) == [0.5, 11.0] and np.isclose(best[1], 2.5)


def test_cost_belongs_to_the_returned_centres(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    for k, (centres, cost, settled) in clusters.best_centres(df, ["a", "b", "c"], [4, 6], 3, 2, 1).items():
        squares = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert len(centres) == k and not settled and np.isclose(cost, squares)


def test_too_many_clusters_are_refused(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "a double")
    with pytest.raises(ValueError, match="distinct"):
        clusters.choose_k(df, ["a"], ks=(2, 3))
    with pytest.raises(ValueError, match="distinct"):
        clusters.cluster_rows(df.limit(0), ["a"], k=2)


def test_variables_cluster_by_their_correlations(spark):
    random = np.random.default_rng(1)
    u, v = random.normal(size=(2, 200))
    data = np.column_stack([u, u + 0.1 * random.normal(size=200), v, v + 0.1 * random.normal(size=200)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "p double, q double, r double, s double")
    names = list("pqrs")
    cells = describe.full_correlation_table(describe.correlation_matrix(df, names), names)
    got = clusters.cluster_profiles(cells, names).collect()
    member = {r.var_i: r.cluster_i for r in got}
    assert len(got) == 16 and member["p"] == member["q"] != member["r"] == member["s"]
    assert [r.cluster_i for r in got] == sorted(r.cluster_i for r in got)


def test_silhouettes_of_all_sets_match_brute_force(spark):
    random = np.random.default_rng(6)
    x = np.vstack([random.normal(size=(200, 3)) + random.integers(0, 3, (200, 1)) * 2, [[90.0, 0.0, 0.0]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    sets = [np.vstack([x[random.choice(200, k - 1, replace=False)], x[-1:]]) for k in (2, 4, 6)] + [np.array([x[0], x[0] + 1000.0])]
    far = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    for centres, got in zip(sets, clusters.silhouettes(df, ["a", "b", "c"], sets), strict=True):
        own, widths = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1), []
        for i in range(len(x)):
            mine = own == own[i]
            others = [far[i][own == c].mean() for c in set(own) - {own[i]}]
            if mine.sum() == 1 or not others:
                widths.append(0.0)
                continue
            a, b = far[i][mine].sum() / (mine.sum() - 1), min(others)
            widths.append((b - a) / max(a, b))
        assert np.isclose(got, np.mean(widths))


def test_sums_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    df, sets = blobs(spark).repartition(4), [np.zeros((1, 2)), np.array([[0.0, 0.0], [9.0, 1.0]])]
    direct = clusters._sums(df, ["a", "b"], sets)
    monkeypatch.setattr(clusters, "DIRECT_TASKS", 1)
    for a, b in zip(direct, clusters._sums(df, ["a", "b"], sets), strict=True):
        assert np.allclose(a, b) and a[:, 0].sum() == 90


def test_all_silhouettes_take_two_passes(spark, monkeypatch):
    passes, added = [], clusters._added
    monkeypatch.setattr(clusters, "_added", lambda *a: passes.append(1) or added(*a))
    clusters.silhouettes(blobs(spark), ["a", "b"], [np.zeros((2, 2)), np.ones((3, 2)), np.eye(2)])
    assert len(passes) == 2


def test_a_small_cluster_is_found_by_every_seed(spark):
    random = np.random.default_rng(2)
    x = np.vstack([random.normal(size=(1998, 2)), np.array([[40.0, 40.0], [40.1, 40.0]])])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    for seed in range(6):
        pool, weight = clusters.seeds(df, ["a", "b"], 2, seed)
        assert (pool[:, 0] > 30).any() and weight.sum() == 2000 and len(pool) <= clusters.SEED_ROUNDS * clusters.SEED_ROWS * 2
        centres = clusters.best_centres(df, ["a", "b"], [2], 10, 15, seed)[2][0]
        assert (centres[:, 0] > 30).sum() == 1


def test_rows_sent_per_round_do_not_grow_with_partitions(spark):
    sent = []
    for parts in (4, 64):
        df = blobs(spark).repartition(parts)
        plan = clusters._worked(df.select("a", "b"))
        sent.append(plan.rdd.getNumPartitions())
    assert sent[0] == sent[1] == spark.sparkContext.defaultParallelism
