"""Mergeable fit state: sums of batches, bounds of the sketch, idempotent batches."""

import os
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from tierwise.operators import fitstate, prepare

NAN, INF = float("nan"), float("inf")


def rows(state):
    return {(r["kind"], r["column"], r["lo"], r["value"]): (r["n"], r["least"], r["most"], r["mean"], r["m2"]) for r in state.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][:3] == b[k][:3]
        assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(a[k][3:], b[k][3:]))


def test_merging_is_fitting_together(wb):
    parts = [wb.merged.filter(F.col("PROSPECTID") % 4 == i) for i in range(4)]
    merged = fitstate.merge_states(*[fitstate.state_of(p) for p in parts])
    same(rows(merged), rows(fitstate.state_of(wb.merged)))
    left = fitstate.merge_states(fitstate.merge_states(*[fitstate.state_of(p) for p in parts[:2]]),
                                 fitstate.merge_states(*[fitstate.state_of(p) for p in parts[2:]]))
    same(rows(merged), rows(left))


def test_params_are_near_the_exact_ones(wb):
    want = prepare.fit(wb.merged)
    got = fitstate.params(fitstate.state_of(wb.merged), want.num_cols + want.cat_cols)
    assert got.feature_names == want.feature_names and got.modes == want.modes
    assert got.categories == want.categories and got.target_counts == want.target_counts
    for c in want.num_cols:
        assert abs(got.medians[c] - want.medians[c]) <= abs(want.medians[c]) / 64
        assert got.means[c] == pytest.approx(want.means[c], rel=0.01, abs=1e-6)
        assert got.stds[c] == pytest.approx(want.stds[c], rel=0.02, abs=1e-6)


def test_values_of_every_size(spark):
    xs = [0.0, -0.0, 1.0, 1.0, -3.5, 5e-324, 2.2e-308, 1.7e308, -1e-12, 1e15 + 1, 1e15 + 2, 1e15 + 3]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(90, None), (91, NAN), (92, INF), (93, -INF)], "k int, x double")
    state = fitstate.state_of(df, "k", "t")
    for r in state.filter("kind = 'numeric'").collect():
        assert r["most"] - r["least"] <= max(abs(r["lo"]) / 64, 2.3e-308)
    assert state.filter("kind = 'missing'").agg(F.sum("n")).collect()[0][0] == 4
    m = fitstate.medians(state).collect()[0]
    assert m["median_low"] <= statistics.median(xs) <= m["median_high"]


def test_deviation_keeps_its_digits(spark):
    xs = [1e9 + i / 8 for i in range(100)]
    got = fitstate.moments(fitstate.state_of(spark.createDataFrame([(x,) for x in xs], "x double"), "k", "t")).collect()[0]
    assert got["std"] == pytest.approx(statistics.pstdev(xs), rel=1e-7) and got["mean"] == pytest.approx(statistics.fmean(xs), rel=1e-12)


def test_empty_and_all_null(spark):
    schema = "PROSPECTID int, x double, GENDER string, Approved_Flag string"
    empty = fitstate.state_of(spark.createDataFrame([], schema))
    assert empty.count() == 0 and fitstate.params(empty, ["x", "GENDER"]).feature_names == []
    nulls = fitstate.state_of(spark.createDataFrame([(1, None, None, None)] * 3, schema))
    p = fitstate.params(nulls, ["x", "GENDER"])
    assert p.all_null == ["x"] and p.num_cols == p.cat_cols == [] and p.target_counts == {}
    assert fitstate.moments(nulls).collect()[0]["missing"] == 3


def test_store_counts_a_batch_once(spark, wb):
    path = tempfile.mkdtemp(prefix="tierwise-fit-")
    store = fitstate.FitStore(spark, path)
    assert store.state().count() == 0
    a, b = wb.merged.filter("PROSPECTID % 2 = 0"), wb.merged.filter("PROSPECTID % 2 = 1")
    assert store.add("a", a) and not store.add("a", a)
    fitstate.state_of(b).write.parquet(f"{path}/batch=b")
    os.remove(f"{path}/batch=b/_SUCCESS")                            # a batch cut off half way
    same(rows(store.state()), rows(fitstate.state_of(a)))
    assert store.add("b", b)
    same(rows(store.state()), rows(fitstate.state_of(wb.merged)))
