import numpy as np
from pyspark.sql import functions as F

from syllabix.functions import ranks
from syllabix.functions.ranks import group_quantiles, running_total


def hot(spark, rows=2000):
    """One key holds most rows; a missing key has some."""
    key = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(rows).select(key.alias("k"), ((F.col("id") * 7919) % rows).alias("at"), (F.col("id") % 5).alias("w"))


def test_split_group_numbers_like_a_window(spark):
    df = hot(spark)
    plain = running_total(df, ["k"], [F.col("at").asc()], "n")
    split = running_total(df, ["k"], [F.col("at").asc()], "n", max_group_rows=100)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    assert split.columns == plain.columns


def test_split_group_sums_weights_like_a_window(spark):
    df = hot(spark)
    plain = running_total(df, ["k"], [F.col("at").desc()], "s", "w")
    split = running_total(df, ["k"], [F.col("at").desc()], "s", "w", max_group_rows=50)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_hot_group_spans_partitions(spark):
    df = running_total(hot(spark), ["k"], [F.col("at").asc()], "n", max_group_rows=100)
    assert df.filter("k = 'hot'").agg(F.max("n"), F.count("*")).first() == (1400, 1400)


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(3).normal(size=501).round(2)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)] + [(0, None)], "g int, x double")
    for limit in (5_000_000, 20):
        got = {r.g: r for r in group_quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.9, "c": 1.0}, limit).collect()}
        for g in (0, 1):
            want = np.quantile(values[g::2], [0.25, 0.9, 1.0])
            assert np.allclose([got[g].a, got[g].b, got[g].c], want)


def test_groups_are_counted_in_buckets_first(spark):
    df = spark.createDataFrame([(i % 40, None if i % 7 else "x", 1 + i % 3) for i in range(400)], "a int, b string, n int")
    sizes = df.groupBy("a", "b").agg(F.sum("n").alias("n"))
    largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    # Above the limit the groups are counted exactly; below it the count is a bound of them.
    assert ranks.group_sizes(df, ["a", "b"], 3, F.col("n")) == (largest, rows)
    bound, total = ranks.group_sizes(df, ["a", "b"], 1000, F.col("n"))
    assert largest <= bound <= 1000 and total == rows
    assert ranks.group_sizes(df, ["a"], 1000)[1] == 400
    assert ranks.group_sizes(spark.range(9), ["id"]) == (0, 0)
    assert ranks.group_sizes(df.filter("a < 0"), ["a"], 5) == (0, 0)
