"""Sparse one-hot features: wide columns, edges, the same model as dense columns."""

import pytest
from pyspark.sql import functions as F

from tierwise.operators import models, sparse


def test_hundred_thousand_categories(spark):
    df = spark.range(120_000).select(
        F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 100_000).alias("wide"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("hot"))
    p = sparse.fit(df, "k", None, nums=[], cats=["wide", "hot"])
    assert p.sizes == {"wide": 100_000, "hot": 40_001} and p.width == 140_001 and p.modes["hot"] == "hot"
    assert p.modes["wide"] == "v0"                                   # ties: the smallest value
    r = p.index.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.sum("n")).collect()[0]
    assert tuple(r) == (0, 140_000, 140_001, 240_000)
    order = p.index.filter(F.col("column") == "wide").orderBy("pos").select("value").limit(3).collect()
    assert [r[0] for r in order] == ["v0", "v1", "v10"]
    rows = sparse.encode(df, p, ["k"])
    assert rows.columns == ["k", "features"]
    assert rows.agg(F.count(F.lit(1)), F.sum(F.size("features"))).collect()[0][:] == (120_000, 240_000)


def test_nulls_unseen_repeats_and_empty(spark):
    schema = "k int, x double, a string, b string, column string"
    df = spark.createDataFrame([(1, 1.0, "p", None, "c"), (1, 1.0, "p", None, "c"), (None, None, None, None, "c"),
                                (2, 4.0, "", None, "c")], schema)
    p = sparse.fit(df, "k", None, nums=["x"], cats=["a", "b"])
    assert p.cat_cols == ["a"] and p.sizes == {"a": 2} and p.modes == {"a": "p"}     # b has no value, so no features
    new = spark.createDataFrame([(7, 1.0, "unseen", "z", "c"), (8, None, None, None, "c")], schema)
    got = {r["k"]: [x["pos"] for x in r["features"]] for r in sparse.encode(new, p, ["k"]).collect()}
    assert got == {7: [0], 8: [0, 2]}
    assert sparse.encode(df, p, ["k"]).count() == 4
    none = sparse.fit(df.limit(0), "k", None, nums=["x"], cats=["a"])
    assert none.width == 0 and sparse.encode(df.limit(0), none, ["k"]).count() == 0
    absent = sparse.encode(new.drop("a", "x"), p, ["k"]).collect()
    assert all([x["pos"] for x in r["features"]][-1] == 2 for r in absent)           # fitted mode


@pytest.fixture(scope="module")
def both(wb):
    from tierwise.sources.fixtures import label_expr
    p = sparse.fit(wb.merged)
    label = label_expr("Approved_Flag")
    dense = models.fit_logistic(wb.labelled, wb.params.feature_names, name="dense")
    return p, sparse.fit_logistic(wb.merged, p, label, name="wide"), dense


def test_logistic_is_the_dense_one(wb, both):
    p, wide, dense = both
    names = wb.params.feature_names
    assert p.width == len(names)
    got = {r["pos"]: r for r in wide.weights.collect()}
    for j in range(len(names)):
        for k in range(len(dense.intercept)):
            assert got[j]["coefs"][k] == pytest.approx(dense.coef[k][j], abs=2e-2)
    a = sparse.score(wb.merged, p, wide, ["PROSPECTID"]).alias("a")
    b = models.score(wb.prepared_all, dense, ["PROSPECTID"]).alias("b")
    gap = a.join(b, "PROSPECTID").agg(F.max(F.abs(F.col("a.Prob_P1") - F.col("b.Prob_P1"))), F.count(F.lit(1))).collect()[0]
    assert gap[0] < 1e-2 and gap[1] == wb.merged.count()


def test_contributions_add_up(wb, both):
    p, wide, _ = both
    total = sparse.phi(wb.merged, p, wide, "PROSPECTID").groupBy("PROSPECTID", "class").agg(F.sum("phi").alias("phi"))
    base = {k: b for k, b in enumerate(wide.intercept)}
    for r in wide.weights.collect():
        for k, c in enumerate(r["coefs"]):
            base[k] += c * r["background"]
    sums = {}
    for r in total.collect():
        sums.setdefault(r["PROSPECTID"], {})[r["class"]] = r["phi"] + base[r["class"]]
    import math
    for r in sparse.score(wb.merged, p, wide, ["PROSPECTID"]).collect():
        z = sums[r["PROSPECTID"]]
        e = {k: math.exp(v) for k, v in z.items()}
        assert e[0] / sum(e.values()) == pytest.approx(r["Prob_P1"], abs=1e-9)
