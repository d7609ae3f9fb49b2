"""Histogram boosting against plain numpy, its promises on a round's loss, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tierwise.operators import boosting, evaluate, models
from tierwise.plans.workbench import Workbench

EDGES = {"x": [0.0, 1.0, 2.5], "y y": [5.0], "flat": []}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(1, 2, 700), rng.integers(0, 10, 700)
    label = np.clip((x > 0).astype(int) + (y > 4) + (rng.random(700) < 0.1), 0, 3)
    data = [(float(a) if i % 50 else None, int(b), 1.0, int(c) if i % 97 else None) for i, (a, b, c) in enumerate(zip(x, y, label))]
    return spark.createDataFrame(data, "x double, `y y` int, flat double, label int").repartition(5)


def test_histograms_are_numpys(spark, rows):
    scores = boosting.flat_scores(EDGES)
    scores += np.random.default_rng(1).normal(size=scores.shape)
    binned = boosting.binned(rows, EDGES, "label", bags=2, held_pct=30).persist()
    icpt = boosting.class_intercept(binned)
    got = {(r["bag"], r.feature, r.bin, r["class"]): (r.n, r.g, r.h) for r in boosting.histograms(binned, icpt, [scores, -scores]).collect()}
    data = binned.collect()
    assert len(data) == rows.filter("label is not null").count()
    for b, at in enumerate((scores, -scores)):
        want = {}
        for r in data:
            z = np.array(icpt) + sum(at[f, i] for f, i in enumerate(r.bins))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            kind = boosting.HELD_LOSS if r.held[b] else boosting.LOSS
            cell = want.setdefault((kind, 0, 0), [0, 0.0, 0.0])
            cell[0] += 1
            cell[1] -= np.log(p[r.label])
            for f, i in enumerate(r.bins):
                for k in range(4):
                    cell = want.setdefault((f, i, k), [0, 0.0, 0.0])
                    cell[0] += 1
                    if not r.held[b]:
                        cell[1] += p[k] - (r.label == k)
                        cell[2] += p[k] * (1 - p[k])
        assert {k[1:] for k in got if k[0] == b} == set(want)
        for key, cell in want.items():
            assert np.allclose(got[(b, *key)], cell, atol=1e-8), key


def test_loss_falls_and_shapes_are_centred(spark, rows):
    fitted = boosting.fit_boosted(rows, list(EDGES), rounds=10, bags=3, edges=EDGES)
    for b in range(3):
        losses = [r[2] for r in fitted.rounds if r[0] == b]
        assert len(losses) > 3 and all(q < p for p, q in zip(losses, losses[1:]))
        assert losses[0] > 1.3 * losses[-1]
    m = fitted.model
    known = m.add_bins(rows.filter("label is not null").withColumn("x", F.coalesce("x", F.lit(-9.0))))
    for f in m.features:
        for k in range(4):
            assert abs(known.agg(F.avg(m.term(f, k, m.bin_col(f)))).first()[0]) < 1e-9
    scored = models.score(rows.filter("x is not null"), m, ["label"])
    assert scored.filter(F.abs(F.col("Prob_P1") + F.col("Prob_P2") + F.col("Prob_P3") + F.col("Prob_P4") - 1) > 1e-9).count() == 0
    assert scored.filter("label = pred").count() > 0.8 * scored.filter("label is not null").count()


def test_held_back_rows_do_not_move_the_scores(spark, rows):
    binned = boosting.binned(rows, EDGES, "label", bags=1, held_pct=40)
    again = binned.filter(~F.col("held")[0]).unionByName(binned.filter(F.col("held")[0]).withColumn("label", F.lit(0)))
    cells = [{(r.feature, r.bin, r["class"]): round(r.g, 9) for r in boosting.histograms(b, [0.0] * 4, [boosting.flat_scores(EDGES)])
              .filter("feature >= 0").collect()} for b in (binned, again)]
    assert cells[0] == cells[1]


def test_one_class_and_no_rows(spark, rows):
    fitted = boosting.fit_boosted(rows.withColumn("label", F.lit(2)), ["x"], rounds=3, bags=1, held_pct=0)
    assert models.score(rows, fitted.model, ["label"]).filter("pred <> 2").count() == 0
    with pytest.raises(ValueError, match="label"):
        boosting.fit_boosted(rows.filter("1 = 0"), ["x"], edges={"x": [0.0]})
    with pytest.raises(ValueError, match="n_bins"):
        boosting.quantile_edges(rows, ["x"], 500)


def test_not_worse_than_the_binned_logit(spark):
    wb = Workbench(spark, SF01)
    feats = wb.params.feature_names
    boosted = boosting.fit_boosted(wb.train, feats, name="boosted").model
    logit = models.fit_additive(wb.train, feats, name="logit")
    auc = {r.model: r.auc_ovr for r in evaluate.model_summary(models.predictions_long(wb.test, [boosted, logit], "PROSPECTID")).collect()}
    assert auc["boosted"] >= auc["logit"]
