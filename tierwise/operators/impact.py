"""Money terms of predictions.

One grouped aggregate per model yields all decision counts; money values are
arithmetic on that tiny table.  The what-if grid is generated by ``sequence``
+ ``explode`` on the per-model row (no cross join, bounded size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (COMPARISON_METRICS, DEFAULT_AVG_LOAN, DEFAULT_P3_RATE, DEFAULT_P4_RATE,
                         HEADLINE_AVOIDED_MEANING, HEADLINE_RESIDUAL_MEANING, HEADLINE_ROWS, LOAN_GRID, P3_RATE_GRID,
                         P4_RATE_GRID, TIER_ACTION_BUSINESS, TIER_CODES, TIER_TEXT_BUSINESS)
from ..functions.numeric import safe_div
from ..functions.text import fill, fmt_crore, fmt_fixed, fmt_pct, fmt_thousands


def decision_counts(pred: DataFrame) -> DataFrame:
    """K1 + K3 + K5 inputs: counts per model in one pass."""
    a, p = F.col("actual"), F.col("pred")
    aggs = [F.count(F.lit(1)).alias("n_test"),
            F.count_if(p <= 1).alias("approved"), F.count_if(p == 2).alias("marginal"),
            F.count_if(p == 3).alias("rejected")]
    aggs += [F.count_if((a == k) & (p == k)).alias(f"tp_{t.lower()}") for k, t in enumerate(TIER_CODES)]
    aggs += [F.count_if((a == 3) & (p <= 1)).alias("fn_p4")]
    c = pred.groupBy("model").agg(*aggs)
    return (c.withColumn("total_correct", F.col("tp_p1") + F.col("tp_p2") + F.col("tp_p3") + F.col("tp_p4"))
             .withColumn("approval_rate", safe_div("approved", "n_test"))
             .withColumn("accuracy", safe_div("total_correct", "n_test")))


def money(counts: DataFrame, avg_loan=DEFAULT_AVG_LOAN, p4_rate=DEFAULT_P4_RATE,
          p3_rate=DEFAULT_P3_RATE) -> DataFrame:
    """K2 + K4 + K5 + K11: avoided and residual exposure (rupees and crore)."""
    loan, r4, r3 = (x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in (avg_loan, p4_rate, p3_rate))
    c = (counts.withColumn("avg_loan", loan).withColumn("p4_rate", r4).withColumn("p3_rate", r3)
               .withColumn("npa_p4", F.col("tp_p4") * F.col("avg_loan") * F.col("p4_rate"))
               .withColumn("npa_p3", F.col("tp_p3") * F.col("avg_loan") * F.col("p3_rate")))
    return (c.withColumn("npa_total", F.col("npa_p4") + F.col("npa_p3"))
             .withColumn("npa_exposure", F.col("fn_p4") * F.col("avg_loan") * F.col("p4_rate"))
             .withColumn("npa_total_cr", F.col("npa_total") / 1e7)
             .withColumn("npa_exposure_cr", F.col("npa_exposure") / 1e7))


def _steps(lo: float, hi: float, step: float, scale: int) -> F.Column:
    """Grid values as exact multiples: sequence of integers, divided once."""
    return F.transform(F.sequence(F.lit(round(lo * scale)), F.lit(round(hi * scale)), F.lit(round(step * scale))),
                       lambda v: v / F.lit(float(scale)))


def whatif_grid(counts: DataFrame) -> DataFrame:
    """K6: every slider combination (20 x 13 x 8) per model."""
    g = (counts.withColumn("avg_loan", F.explode(_steps(*LOAN_GRID, 1)))
               .withColumn("p4_rate", F.explode(_steps(*P4_RATE_GRID, 100)))
               .withColumn("p3_rate", F.explode(_steps(*P3_RATE_GRID, 100))))
    return money(g, F.col("avg_loan"), F.col("p4_rate"), F.col("p3_rate"))


def side_by_side(m: DataFrame, metrics: list[str], baseline: str, challenger: str) -> DataFrame:
    """One row with baseline and challenger values of each metric."""
    aggs = []
    for x in metrics:
        aggs += [F.max(F.when(F.col("model") == baseline, F.col(x))).alias(f"b_{x}"),
                 F.max(F.when(F.col("model") == challenger, F.col(x))).alias(f"c_{x}")]
    return m.agg(*aggs)


def model_vote(m: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """K7: challenger wins over 5 metrics; 4 or more -> recommend it.

    ``m`` has per model: accuracy, npa_total, npa_exposure, f1_macro, auc_ovr."""
    s = side_by_side(m, ["accuracy", "npa_total", "npa_exposure", "f1_macro", "auc_ovr"], baseline, challenger)
    wins = ((F.col("c_accuracy") > F.col("b_accuracy")).cast("int")
            + (F.col("c_npa_total") >= F.col("b_npa_total")).cast("int")
            + (F.col("c_npa_exposure") <= F.col("b_npa_exposure")).cast("int")
            + (F.col("c_f1_macro") > F.col("b_f1_macro")).cast("int")
            + (F.col("c_auc_ovr") > F.col("b_auc_ovr")).cast("int"))
    return s.select(F.lit(baseline).alias("baseline"), F.lit(challenger).alias("challenger"),
                    wins.alias("challenger_wins"),
                    F.when(wins >= 4, F.lit(challenger)).otherwise(F.lit("comparable")).alias("recommendation"))


def tier_table(pred: DataFrame, spark: SparkSession) -> DataFrame:
    """K8: per model and tier: count, share, description, action."""
    dim = spark.createDataFrame(
        [(k, t, TIER_TEXT_BUSINESS[t], TIER_ACTION_BUSINESS[t]) for k, t in enumerate(TIER_CODES)],
        "pred int, tier string, description string, action string")
    c = pred.groupBy("model", "pred").agg(F.count(F.lit(1)).alias("n"))
    tot = pred.groupBy("model").agg(F.count(F.lit(1)).alias("n_test"))
    models = tot.select("model", "n_test", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("pred"))
    return (models.join(c, ["model", "pred"], "left").join(F.broadcast(dim), "pred")
            .select("model", "tier", "description", "action",
                    F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                    F.coalesce(safe_div("n", "n_test"), F.lit(0.0)).alias("share")))


def headline(mm: DataFrame, model: str) -> DataFrame:
    """The 7-row headline table of one model, as (pos, metric, value, meaning)."""
    r = mm.filter(F.col("model") == model)
    share = lambda c: fmt_pct(safe_div(c, "n_test"))
    def row(pos, metric, value, meaning):
        return F.struct(F.lit(pos).alias("pos"), F.lit(metric).alias("metric"), value.alias("value"),
                        (meaning if not isinstance(meaning, str) else F.lit(meaning)).alias("meaning"))
    values = [
        fmt_thousands("n_test"),
        F.concat(fmt_thousands("total_correct"), F.lit(" ("), fmt_pct("accuracy"), F.lit(")")),
        F.concat(fmt_thousands("approved"), F.lit(" ("), fmt_pct("approval_rate"), F.lit(")")),
        F.concat(fmt_thousands("marginal"), F.lit(" ("), share("marginal"), F.lit(")")),
        F.concat(fmt_thousands("rejected"), F.lit(" ("), share("rejected"), F.lit(")")),
        fmt_crore("npa_total"),
        fmt_crore("npa_exposure"),
    ]
    computed = {5: fill(HEADLINE_AVOIDED_MEANING, p4=fmt_pct("p4_rate", 0), p3=fmt_pct("p3_rate", 0)),
                6: fill(HEADLINE_RESIDUAL_MEANING, n=F.col("fn_p4").cast("string"))}
    rows = F.array(*[row(i + 1, metric, values[i], meaning if meaning is not None else computed[i])
                     for i, (metric, meaning) in enumerate(HEADLINE_ROWS)])
    return r.select(F.col("model"), F.inline(rows))


def comparison_report(mm: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """K9 / A10: 9-row comparison with 'Better' (strict; ties to the baseline)."""
    s = side_by_side(mm, ["f1_macro", "f1_weighted", "auc_ovr", "accuracy", "total_correct", "approved", "approval_rate",
                          "npa_total", "npa_exposure", "fn_p4"], baseline, challenger)
    texts = [("f1_macro", lambda x: fmt_fixed(x, 3), 1), ("f1_weighted", lambda x: fmt_fixed(x, 3), 1),
             ("auc_ovr", lambda x: fmt_fixed(x, 3), 1), ("accuracy", fmt_pct, 1), ("total_correct", fmt_thousands, 1),
             ("approved", fmt_thousands, 1), ("npa_total", fmt_crore, 1), ("npa_exposure", fmt_crore, -1),
             ("fn_p4", lambda x: F.col(x).cast("string"), -1)]
    rows = []
    for i, ((c, text, sign), name) in enumerate(zip(texts, COMPARISON_METRICS)):
        def shown(side, c=c, text=text):
            v = text(f"{side}_{c}")
            return F.concat(v, F.lit(" ("), fmt_pct(f"{side}_approval_rate"), F.lit(")")) if c == "approved" else v
        better = F.col(f"c_{c}") > F.col(f"b_{c}") if sign > 0 else F.col(f"c_{c}") < F.col(f"b_{c}")
        rows.append(F.struct(F.lit(i + 1).alias("pos"), F.lit(name).alias("metric"), shown("b").alias("baseline_value"),
                             shown("c").alias("challenger_value"),
                             F.when(better, F.lit(challenger)).otherwise(F.lit(baseline)).alias("better")))
    return s.select(F.inline(F.array(*rows)))
