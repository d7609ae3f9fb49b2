"""Positions, splits and quantiles keep every row: large sorts, null keys, repeated keys."""

import numpy as np
from pyspark.sql import functions as F

from tierwise.operators import lime, merge, split
from tierwise.operators.quantiles import exact_quantiles


def test_positions_of_millions_of_rows_with_payload(spark):
    n = 3_000_000
    a = spark.range(n).select(F.col("id").alias("a"), F.md5(F.col("id").cast("string")).alias("payload")) \
        .orderBy(F.xxhash64("a"))
    b = spark.range(n).select((F.lit(n - 1) - F.col("id")).alias("b")).orderBy(F.xxhash64("b", F.lit(1)))
    m = merge.merge_positional(a, b, ["a"], ["b"])
    r = m.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("paired")).first()
    assert (r.n, r.paired) == (n, n)


def rows(spark):
    """A tenth of the rows without key, and one key with a third of the rows."""
    k = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    return spark.range(12_000).select(k.alias("key"), (F.col("id") % 4).cast("int").alias("label"), F.col("id").alias("x"))


def test_split_keeps_null_and_repeated_keys(spark):
    df = rows(spark)
    s = split.stratified_split(df, "key", "label", 20)
    assert s.count() == 12_000 and s.select("x").distinct().count() == 12_000
    assert {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()} == {
        **{(k, "test"): 600 for k in range(4)}, **{(k, "train"): 2400 for k in range(4)}}
    assert s.filter("key is null").count() == 1200
    again = split.stratified_split(df.repartition(5), "key", "label", 20)
    assert s.exceptAll(again).isEmpty()


def test_sample_has_its_exact_size(spark):
    s = split.stratified_sample(rows(spark), "key", "label", 25)
    assert s.count() == 3000


def test_null_strata_come_out(spark):
    df = rows(spark).withColumn("label", F.when(F.col("x") < 100, None).otherwise(F.col("label")))
    out = split.first_k_per_stratum(df, "key", "label", {0: 10, 1: 0, 2: 5000, 3: 1}, "s")
    got = {r.label: (r.n, r.k) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if("_first").alias("k")).collect()}
    assert got == {None: (100, 0), 0: (2975, 10), 1: (2975, 0), 2: (2975, 2975), 3: (2975, 1)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=5001), "b": rng.integers(0, 5, 5001).astype(float), "c": np.full(5001, 3.0)}
    df = spark.createDataFrame([(*map(float, r), None) for r in zip(*data.values())], "a double, b double, c double, d double")
    got = exact_quantiles(df, ["a", "b", "c", "d"], [0.0, 0.25, 0.5, 0.77, 1.0])
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, [0.0, 0.25, 0.5, 0.77, 1.0]), rtol=0, atol=1e-12)
    assert got["d"] == [None] * 5


def test_surrogate_solves_the_weighted_ridge():
    rng = np.random.default_rng(3)
    z, y, w = (rng.random((400, 8)) < 0.4).astype(float), rng.random(400), rng.random(400)
    full = np.column_stack([np.ones(400), z, y])
    for k in (3, 8):
        weights, intercept = lime.solve(full.T @ (full * w[:, None]), k)
        chosen = [i for i, _ in weights]
        x = np.column_stack([np.ones(400), z[:, chosen]])
        penalty = np.diag([0.0] + [1.0] * len(chosen))
        want = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (w * y))
        assert np.allclose([intercept] + [b for _, b in weights], want)
        assert len(chosen) == k
