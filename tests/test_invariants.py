"""Invariants for fitted and non-SQL parts; edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from tierwise.constants import KEY_COL
from tierwise.operators import evaluate, explain, fairness, merge, models, prepare, schema, split


def test_split_sizes_match_quotas(wb):
    counts = split.class_counts(wb.labelled)
    q = split.split_quotas(counts)
    got = {r["label"]: r["n"] for r in wb.split_df.filter("split = 'test'").groupBy("label").count()
           .withColumnRenamed("count", "n").collect()}
    assert got == {k: v for k, v in q.items() if v}
    n = sum(counts.values())
    assert sum(q.values()) == math.ceil(0.2 * n)


def test_allocate_largest_remainder():
    assert split.allocate({0: 5, 1: 5, 2: 1}, 5) == {0: 2, 1: 2, 2: 1}   # remainders 3/11, 3/11, 5/11
    assert sum(split.allocate({0: 7, 1: 11, 2: 13}, 10).values()) == 10


def test_probabilities_sum_to_one_and_phi_adds_up(wb):
    m = wb.fixed_a
    s = models.score(wb.labelled, m, [KEY_COL] + m.features)
    tot = s.select((F.col("Prob_P1") + F.col("Prob_P2") + F.col("Prob_P3") + F.col("Prob_P4")).alias("t"))
    assert tot.agg(F.max(F.abs(F.col("t") - 1))).first()[0] < 1e-12
    phi = explain.phi_long(wb.labelled, m, KEY_COL).groupBy(KEY_COL, "class").agg(F.sum("phi").alias("sp"))
    base = explain.base_values(m)
    z = wb.labelled.select(KEY_COL, *[e.alias(f"z{k}") for k, e in enumerate(m.logits())])
    j = phi.join(z, KEY_COL).select(
        (F.col("sp") + F.element_at(F.array(*[F.lit(b) for b in base]), F.col("class") + 1)
         - F.element_at(F.array(*[F.col(f"z{k}") for k in range(4)]), F.col("class") + 1)).alias("d"))
    assert j.agg(F.max(F.abs("d"))).first()[0] < 1e-9


def test_scaler_output_standardised(wb):
    p = wb.params
    agg = wb.prepared_all.agg(*[F.avg(c).alias(f"m_{c}") for c in p.num_cols],
                              *[F.stddev_pop(c).alias(f"s_{c}") for c in p.num_cols]).first()
    for c in p.num_cols:
        assert abs(agg[f"m_{c}"]) < 1e-9
        assert abs(agg[f"s_{c}"] - (0.0 if p.stds[c] == 0 else 1.0)) < 1e-9


def test_auc_equals_rank_statistic(wb):
    preds = wb.fixed_preds.toPandas()
    auc = {(r["model"], r["class"]): r["auc"] for r in evaluate.auc_by_class(evaluate.roc_points(wb.fixed_preds)).collect()}
    for (m, k), a in auc.items():
        g = preds[preds.model == m]
        s = g[f"Prob_P{k + 1}"]
        y = g.actual == k
        if y.sum() == 0 or (~y).sum() == 0:
            assert a is None
            continue
        ranks = s.rank()
        mw = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        assert abs(mw - a) < 1e-9


def test_confusion_rows_sum_to_support(wb):
    cm = evaluate.confusion(wb.rule_preds)
    assert cm.count() == 32
    rep = evaluate.class_report(cm).toPandas()
    sup = wb.rule_preds.groupBy("model", "actual").count().toPandas()
    for _, r in sup.iterrows():
        assert rep[(rep.model == r["model"]) & (rep["class"] == r["actual"])].support.iloc[0] == r["count"]


def test_dpd_zero_for_one_group(spark):
    df = spark.createDataFrame([("m", 0, 1, "only"), ("m", 2, 3, "only")], "model string, actual int, pred int, g string")
    long = fairness.long_groups(fairness.binarize(df), ["g"])
    d = fairness.differences(fairness.group_rates(long)).first()
    assert d["dpd"] == 0 and d["eod"] == 0


def test_group_without_positives_has_null_tpr(spark):
    df = spark.createDataFrame([("m", 3, 0, "a"), ("m", 0, 0, "b"), ("m", 3, 3, "b")],
                               "model string, actual int, pred int, g string")
    r = {x["grp"]: x for x in fairness.group_rates(fairness.long_groups(fairness.binarize(df), ["g"])).collect()}
    assert r["a"]["tpr"] is None and r["a"]["fpr"] == 1.0


def test_key_detection_rules():
    assert schema.find_common_key(["PROSPECTID", "x"], ["prospectid", "y"]) == ("PROSPECTID", "prospectid")
    assert schema.find_common_key(["a", "b"], ["c"]) == (None, None)
    assert schema.find_common_key(["b", "a"], ["A", "B"]) == ("b", "B")


def test_nullsafe_merge_and_duplicates(spark):
    a = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "id long, v long")
    b = spark.createDataFrame([(None, "x"), (1, "y")], "ID long, v string")
    m = merge.merge(a, b)
    assert m.count() == 3
    assert set(m.columns) == {"id", "v_int", "v_ext"}
    assert merge.merge(a, b, null_safe=False).count() == 2


def test_positional_merge_requires_equal_counts(spark):
    a = spark.range(3).withColumnRenamed("id", "x")
    b = spark.range(4).withColumnRenamed("id", "y")
    with pytest.raises(ValueError):
        merge.merge_positional(a, b, ["x"], ["y"])
    c = spark.range(3).select((F.col("id") * 10).alias("y"))
    rows = merge.merge_positional(a, c, ["x"], ["y"]).orderBy("x").collect()
    assert [(r.x, r.y) for r in rows] == [(0, 0), (1, 10), (2, 20)]


def test_mode_tie_all_null_and_unseen_category(spark):
    df = spark.createDataFrame(
        [(1, "b", None, 1.0, "P1"), (2, "a", None, 2.0, "P2"), (3, "b", None, 3.0, "P3"), (4, "a", None, 4.0, "P4")],
        "PROSPECTID long, GENDER string, empty double, x double, Approved_Flag string")
    p = prepare.fit(df)
    assert p.modes["GENDER"] == "a"
    assert "empty" in p.all_null and "empty" not in p.num_cols
    new = spark.createDataFrame([(9, "X", 2.5)], "PROSPECTID long, GENDER string, x double")
    out = prepare.transform(new, p).first()
    assert out["GENDER_a"] == 0.0 and out["GENDER_b"] == 0.0


def test_unknown_labels_include_null(spark):
    df = spark.createDataFrame([("P1",), ("P9",), (None,), ("P9",)], "Approved_Flag string")
    got = {r["value"]: r["n"] for r in schema.unknown_labels(spark, df).collect()}
    assert got == {"P9": 2, None: 1}


def test_fit_logistic_invariants(wb):
    m = models.fit_logistic(wb.train, wb.params.feature_names, "label", max_iter=200)
    for j in range(len(m.features)):
        assert abs(sum(m.coef[k][j] for k in range(len(m.coef)))) < 1e-6
    preds = models.predictions_long(wb.test, [m], KEY_COL, "label")
    acc = evaluate.accuracy(preds).first()["accuracy"]
    prior = wb.train.groupBy("label").count().orderBy(F.desc("count")).first()["count"] / wb.train.count()
    assert acc >= prior - 0.1


def test_fit_additive_shapes_centred(wb):
    m = models.fit_additive(wb.train, wb.params.feature_names[:6], "label", max_iter=30)
    imp = explain.global_importance(wb.train, m, None)
    assert imp.count() == 6
    f = m.features[0]
    b = m.bin_expr(f)
    means = wb.train.select(*[m.term(f, k, b).alias(f"t{k}") for k in range(4)]).agg(
        *[F.avg(f"t{k}") for k in range(4)]).first()
    assert all(abs(v) < 1e-9 for v in means)


def test_lime_batch(wb, spark):
    from tierwise.operators import lime
    ids = wb.labelled.select(KEY_COL).orderBy(KEY_COL).limit(2)
    out = lime.lime_batch(wb.train, wb.labelled, ids, wb.fixed_a, KEY_COL, num_samples=500)
    pdf = out.toPandas()
    assert len(pdf) == 2 * len(wb.fixed_a.features)
    assert set(pdf.feature) == set(wb.fixed_a.features)


def test_stream_score_equals_batch(spark):
    import __spark_entry__ as E
    from conftest import SF
    s = E.queries()["stream_score"](spark, SF)
    b = E.queries()["score_unseen"](spark, SF)
    assert sorted(map(tuple, s.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_loaders_roundtrip(spark, wb):
    import __spark_entry__ as E
    from conftest import SF
    csv = E.queries()["load_csv"](spark, SF)
    assert csv.count() == wb.internal.count()
    assert set(csv.columns) == set(wb.internal.columns)
    loaded = E.queries()["load_inputs"](spark, SF)
    assert loaded.count() == wb.merged.count()
    assert loaded.columns == wb.merged.columns
