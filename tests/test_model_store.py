"""Versioned models, explanations kept by row, audits of continuous attributes."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tierwise.operators import explain, fairness, models
from tierwise.sources.store import ModelStore, NoVersion


@pytest.fixture
def store(spark):
    return ModelStore(spark, tempfile.mkdtemp(prefix="tierwise-store-"))


def table(spark, n):
    return {"coefficients": spark.createDataFrame([(n,)], "v int"), "other": spark.range(n)}


def value(store, **kw):
    return store.load("m", **kw)["coefficients"].collect()[0]["v"]


def test_nothing_saved(store):
    assert store.versions("m") == []
    with pytest.raises(NoVersion):
        store.load("m")


def test_versions_stay(spark, store):
    assert [store.save("m", table(spark, n)) for n in (1, 2, 3)] == [1, 2, 3]
    assert value(store) == 3 and value(store, version=1) == 1
    with pytest.raises(NoVersion):
        store.load("m", version=9)


def test_a_save_that_dies_leaves_the_old_model(spark, store):
    store.save("m", table(spark, 1))
    broken = {"coefficients": spark.createDataFrame([(2,)], "v int"),
              "other": spark.range(3).select(F.raise_error(F.lit("executor lost")).alias("x"))}
    with pytest.raises(Exception, match="executor lost"):
        store.save("m", broken)
    assert store.versions("m") == [1] and value(store) == 1
    assert store.save("m", table(spark, 3)) == 2 and value(store) == 3


def test_falls_back_to_the_last_whole_version(spark, store):
    for n in (1, 2, 3):
        store.save("m", table(spark, n))
    folder = store._whole("m", 3)[0]
    os.remove(glob.glob(f"{folder}/other/part-*")[0])
    commit = f"{store.path}/m/commits/00000002.json"
    with open(commit, "w") as f:
        f.write('{"folder":')
    crc = f"{store.path}/m/commits/.00000002.json.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert value(store) == 1
    assert store.save("m", table(spark, 4)) == 4 and value(store) == 4


def test_only_new_rows_are_explained(spark, wb):
    kept = explain.RowPhiStore(spark, tempfile.mkdtemp(prefix="tierwise-phi-"))
    m, rows = wb.fixed_a, wb.labelled
    first = rows.filter("PROSPECTID % 10 > 0")
    assert kept.missing(first, m, "PROSPECTID").count() == first.count()
    kept.of(first, m, "PROSPECTID").count()
    assert kept.missing(rows, m, "PROSPECTID").count() == rows.count() - first.count()
    want = {(r["PROSPECTID"], r["feature"], r["class"]): r["phi"] for r in explain.phi_long(rows, m, "PROSPECTID").collect()}
    got = {(r["PROSPECTID"], r["feature"], r["class"]): r["phi"] for r in kept.of(rows, m, "PROSPECTID").collect()}
    assert got == want and kept.missing(rows, m, "PROSPECTID").count() == 0
    changed = rows.withColumn("AGE", F.when(F.col("PROSPECTID") == 1, F.col("AGE") + 1).otherwise(F.col("AGE")))
    assert [r["PROSPECTID"] for r in kept.missing(changed, m, "PROSPECTID").collect()] in ([1], [])
    twice = rows.unionByName(rows)
    assert kept.of(twice, m, "PROSPECTID").count() == 2 * len(want)
    other = models.LinearModel("other", m.features, m.coef, [0.0] * 4, m.background)
    assert kept.missing(rows, other, "PROSPECTID").count() == rows.count()       # another model, its own rows
    assert kept.of(rows.limit(0), m, "PROSPECTID").count() == 0


def test_bins_of_continuous_attributes(spark):
    rows = [(i, float(i), 7.0, "a", i % 3) for i in range(1000)] + [(1000, None, 7.0, None, None), (1001, float("nan"), 7.0, "b", 1)]
    df = spark.createDataFrame(rows, "prospectid int, x double, same double, s string, few int")
    got, bounds = fairness.binned(df, ["x", "same", "s", "few", "absent"], bins=4, above=50)
    counts = {r["x"]: r["count"] for r in got.groupBy("x").count().collect()}
    assert counts == {"1": 250, "2": 250, "3": 250, "4": 250, None: 2}
    assert {(r["grp"], r["lo"], r["hi"]) for r in bounds.collect()} == {
        ("1", 0.0, 249.75), ("2", 249.75, 499.5), ("3", 499.5, 749.25), ("4", 749.25, 999.0)}
    assert got.select("same", "s", "few").exceptAll(df.select("same", "s", "few")).count() == 0
    hot = spark.createDataFrame([(i, 0.0 if i < 900 else float(i)) for i in range(1000)], "prospectid int, x double")
    assert [r["count"] for r in fairness.binned(hot, ["x"], bins=4)[0].groupBy("x").count().collect()] == [1000]
    empty, none = fairness.binned(df.limit(0), ["x"])
    assert empty.count() == 0 and none.count() == 0
