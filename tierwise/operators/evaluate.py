"""Evaluation tables over a long predictions table.

Input columns: ``model, actual, pred`` (+ ``Prob_P1..Prob_P4`` for ROC/AUC).
Everything aggregates first (partial + final hash aggregation), so the
windows below only ever run over small tables or bounded buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import written
from ..constants import TIER_CODES
from ..functions.numeric import r6, safe_div
from .models import prob_cols

K = len(TIER_CODES)


def _tier(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.array(*[F.lit(t) for t in TIER_CODES]), c + 1)


CELLS = [(a, p) for a in range(K) for p in range(K)]


def confusion(pred: DataFrame) -> DataFrame:
    """H1: counts on the complete 4x4 grid per model (empty cells = 0): one
    aggregate with a column per cell, unpivoted in the row."""
    wide = pred.groupBy("model").agg(*[
        F.count_if((F.col("actual") == a) & (F.col("pred") == p)).alias(f"n{a}{p}") for a, p in CELLS])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n"))
                      for a, p in CELLS])
    return wide.select("model", F.inline(cells))


def confusion_pct(cm: DataFrame) -> DataFrame:
    """H2: row-normalised percent; null for an empty actual row."""
    w = Window.partitionBy("model", "actual")
    return cm.withColumn("row_pct", r6(safe_div(F.col("n") * 100.0, F.sum("n").over(w))))


def class_report(cm: DataFrame) -> DataFrame:
    """H3: per-class precision / recall / F1 / support; 0/0 -> 0.  The grid of
    a model comes back into one row (already partitioned by model), and all
    the rest is arithmetic in that row."""
    n = {(a, p): F.col(f"n{a}{p}") for a, p in CELLS}
    wide = cm.groupBy("model").agg(*[
        F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))), F.lit(0)).alias(f"n{a}{p}")
        for a, p in CELLS])
    rows = F.array(*[F.struct(F.lit(k).alias("class"), sum((n[k, j] for j in range(1, K)), n[k, 0]).alias("support"),
                              sum((n[j, k] for j in range(1, K)), n[0, k]).alias("n_pred"), n[k, k].alias("tp"))
                     for k in range(K)])
    j = wide.select("model", F.inline(rows))
    p = F.coalesce(safe_div("tp", "n_pred"), F.lit(0.0))
    r = F.coalesce(safe_div("tp", "support"), F.lit(0.0))
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return j.withColumn("f1", f1).select("model", "class", _tier("class").alias("tier"), "precision", "recall",
                                         "f1", "support")


def averages(rep: DataFrame) -> DataFrame:
    """H4: macro and weighted averages (as the report's two extra rows)."""
    s = F.col("support")
    g = rep.groupBy("model").agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        safe_div(F.sum(F.col("precision") * s), F.sum(s)).alias("wp"),
        safe_div(F.sum(F.col("recall") * s), F.sum(s)).alias("wr"),
        safe_div(F.sum(F.col("f1") * s), F.sum(s)).alias("wf"),
        F.sum(s).alias("support"))
    rows = F.array(
        F.struct(F.lit("macro avg").alias("average"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1")),
        F.struct(F.lit("weighted avg").alias("average"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1")))
    return g.select("model", "support", F.explode(rows).alias("a")).select(
        "model", "a.average", "a.precision", "a.recall", "a.f1", "support")


def f1_scores(rep: DataFrame) -> DataFrame:
    """H5: macro and weighted F1 per model."""
    s = F.col("support")
    return rep.groupBy("model").agg(F.avg("f1").alias("f1_macro"),
                                    safe_div(F.sum(F.col("f1") * s), F.sum(s)).alias("f1_weighted"))


def accuracy(pred: DataFrame) -> DataFrame:
    """H6: diagonal / n."""
    return pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("actual") == F.col("pred")).alias("correct"),
    ).withColumn("accuracy", safe_div("correct", "n"))


def _class_scores(pred: DataFrame) -> DataFrame:
    """H7: one (model, class, score, y) row per prediction and class."""
    items = F.array(*[F.struct(F.lit(k).alias("class"), F.col(p).alias("score"),
                               (F.col("actual") == k).cast("int").alias("y"))
                      for k, p in enumerate(prob_cols())])
    return pred.select("model", F.explode(items).alias("i")).select("model", "i.class", "i.score", "i.y")


def roc_points(pred: DataFrame) -> DataFrame:
    """H8: (model, class, threshold, fpr, tpr) at every distinct score.

    Rows are first reduced to distinct (model, class, score) groups, which are
    range-partitioned by a sort and written; running sums then take the sort
    partition as bucket: bucket totals (a row per partition, model and class)
    give the offset, a window inside each bucket the rest.  However the scores
    are spread, the buckets hold about as many groups each."""
    g = _class_scores(pred).groupBy("model", "class", "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    g = written(g.orderBy("model", "class", F.desc("score")).withColumn("_bk", F.spark_partition_id()), "roc")
    bt = g.groupBy("model", "class", "_bk").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    wb = Window.partitionBy("model", "class").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy("model", "class")
    bt = bt.select("model", "class", "_bk",
                   F.coalesce(F.sum("bpos").over(wb), F.lit(0)).alias("pos_before"),
                   F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("neg_before"),
                   F.sum("bpos").over(wt).alias("P"), F.sum("bneg").over(wt).alias("N"))
    j = g.join(bt, ["model", "class", "_bk"])
    wi = Window.partitionBy("model", "class", "_bk").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    j = (j.withColumn("tp", F.col("pos_before") + F.sum("pos").over(wi))
          .withColumn("fp", F.col("neg_before") + F.sum("neg").over(wi)))
    return j.select("model", "class", F.col("score").alias("threshold"), "pos", "neg", "tp", "fp", "P", "N",
                    safe_div("fp", "N").alias("fpr"), safe_div("tp", "P").alias("tpr"))


def auc_by_class(roc: DataFrame) -> DataFrame:
    """H9: trapezoid AUC; the previous ROC point of a group is (fp-neg, tp-pos),
    so no lag is needed.  Equals the tie-averaged rank statistic."""
    return roc.groupBy("model", "class").agg(
        safe_div(F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))),
                 2.0 * F.first("P") * F.first("N")).alias("auc"))


def auc_macro(auc: DataFrame) -> DataFrame:
    """Macro one-vs-rest AUC."""
    return auc.groupBy("model").agg(F.avg("auc").alias("auc_ovr"))


def class_distribution(labels: DataFrame, label_col: str = "label", by: list[str] | None = None) -> DataFrame:
    """Count and percent per tier in tier order, missing tiers = 0."""
    by = by or []
    c = labels.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n"))
    keys = c.select(*by).distinct() if by else labels.sparkSession.range(1).select()
    tiers = F.explode(F.array(*[F.lit(k) for k in range(K)])).alias(label_col)
    grid = keys.select(*by, tiers)
    out = grid.join(c, by + [label_col], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return out.select(*by, _tier(label_col).alias("tier"), "n",
                      F.coalesce(safe_div(F.col("n") * 100.0, F.sum("n").over(w)), F.lit(0.0)).alias("pct"))


def model_summary(pred: DataFrame) -> DataFrame:
    """H12 input: macro F1, weighted F1, macro AUC, accuracy per model.

    F1 and accuracy both come from the same 16-cell confusion table (one pass
    over the predictions); AUC from the ROC running counts."""
    cm = confusion(pred)
    f1 = f1_scores(class_report(cm))
    acc = cm.groupBy("model").agg(F.sum("n").alias("n"),
                                  F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                                        .otherwise(0)).alias("correct"))
    acc = acc.select("model", "n", safe_div("correct", "n").alias("accuracy"))
    auc = auc_macro(auc_by_class(roc_points(pred)))
    return f1.join(auc, "model").join(acc, "model")


def recommend(summary: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Challenger if strictly better on macro F1 and AUC; else 'baseline'
    when its macro F1 is at least the challenger's; else 'none'."""
    j = summary.agg(
        F.max(F.when(F.col("model") == baseline, F.col("f1_macro"))).alias("b_f1"),
        F.max(F.when(F.col("model") == baseline, F.col("auc_ovr"))).alias("b_auc"),
        F.max(F.when(F.col("model") == challenger, F.col("f1_macro"))).alias("c_f1"),
        F.max(F.when(F.col("model") == challenger, F.col("auc_ovr"))).alias("c_auc"))
    rec = (F.when((F.col("c_f1") > F.col("b_f1")) & (F.col("c_auc") > F.col("b_auc")), F.lit(challenger))
            .when(F.col("b_f1") >= F.col("c_f1"), F.lit(baseline)).otherwise(F.lit("none")))
    return j.select(F.lit(baseline).alias("baseline"), F.lit(challenger).alias("challenger"),
                    rec.alias("recommended"))
