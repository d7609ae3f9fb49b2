"""Credit-shaped input tables derived from the driver tables (A3, FIXTURES.md).

The reference ships no data, so the internal / external / unseen inputs are
deterministic projections of ``orders``, ``customer`` and ``lineitem``.
Every builder is a lazy DataFrame plan over the whole driver tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from .tables import read_table


def internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ``o_custkey`` with trade-line roll-ups."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    day = F.col("o_orderdate").cast("date")
    prio = F.col("o_orderpriority")
    g = o.groupBy(F.col("o_custkey").alias("PROSPECTID")).agg(
        F.count(F.lit(1)).alias("Total_TL"),
        F.count_if(F.col("o_orderstatus") == "F").alias("Tot_Closed_TL"),
        F.count_if(F.col("o_orderstatus") != "F").alias("Tot_Active_TL"),
        F.count_if(day >= F.lit(_dt.date(2001, 2, 1))).alias("Total_TL_opened_L6M"),
        F.count_if(day >= F.lit(_dt.date(2000, 8, 1))).alias("Total_TL_opened_L12M"),
        F.count_if(prio == "1-URGENT").alias("Auto_TL"),
        F.count_if(prio == "2-HIGH").alias("CC_TL"),
        F.count_if(prio == "3-MEDIUM").alias("Consumer_TL"),
        F.count_if(prio == "4-NOT SPECIFIED").alias("Home_TL"),
        F.count_if(prio == "5-LOW").alias("PL_TL"),
        F.min("o_orderdate").alias("_dmin"),
        F.max("o_orderdate").alias("_dmax"),
    )

    def months(c: str) -> Column:
        return ((F.lit(2001) - F.year(c)) * 12 + 8 - F.month(c)).cast("int")

    return g.select(
        "PROSPECTID", "Total_TL", "Tot_Closed_TL", "Tot_Active_TL",
        "Total_TL_opened_L6M", "Total_TL_opened_L12M",
        r6(F.col("Tot_Active_TL").cast("double") / F.col("Total_TL")).alias("pct_active_tl"),
        r6(F.col("Tot_Closed_TL").cast("double") / F.col("Total_TL")).alias("pct_closed_tl"),
        "Auto_TL", "CC_TL", "Consumer_TL", "Home_TL", "PL_TL",
        months("_dmin").alias("Age_Oldest_TL"),
        months("_dmax").alias("Age_Newest_TL"),
        F.lit(0).cast("int").alias("Const_TL"),
    )


def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer line statistics; lineitem is pre-aggregated per order
    (map-side partial aggregation) before it meets orders."""
    pct = F.col("l_discount") * 100   # rounded half up by whole numbers: F.round makes a BigDecimal of every row
    whole = F.floor(F.abs(pct)).cast("double")
    pct = F.when(F.isnan(pct), pct).otherwise(F.when(pct < 0, -1).otherwise(1) * (whole + F.when(F.abs(pct) - whole >= 0.5, 1).otherwise(0)))
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_returnflag", "l_linestatus")
    per_order = li.groupBy("l_orderkey").agg(
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("dq"),
        F.sum(pct.cast("long")).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "inner")
             .groupBy("o_custkey")
             .agg(F.sum("dq").alias("dq"), F.sum("sd").alias("sd"), F.sum("n").alias("n")))


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bureau-like table, one row per customer.  Customers without orders have
    no internal row, so unmatched keys occur by themselves."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    lines = _customer_lines(spark, sf_dir)
    j = c.join(lines, c.c_custkey == lines.o_custkey, "left")
    k = F.col("c_custkey")
    cs = F.lit(469) + F.floor((F.col("c_acctbal") + 1000) * 342 / 11000).cast("long")
    s = F.when((k * 31) % 10 == 0, cs - 60).otherwise(cs)
    h = (k * 7 + 3) % 13
    education = (F.when(h == 12, F.lit(None).cast("string"))
                  .when(h <= 3, "GRADUATE").when(h <= 5, "12TH").when(h == 6, "SSC")
                  .when(h <= 8, "UNDER GRADUATE").when(h == 9, "OTHERS")
                  .when(h == 10, "POST-GRADUATE").otherwise("PROFESSIONAL"))
    seg = F.col("c_mktsegment")
    last_prod = (F.when(seg == "AUTOMOBILE", "AL").when(seg == "BUILDING", "HL")
                  .when(seg == "FURNITURE", "ConsumerLoan").when(seg == "HOUSEHOLD", "CC").otherwise("others"))
    nk = F.col("c_nationkey") % 6
    first_prod = (F.when(nk == 0, "AL").when(nk == 1, "HL").when(nk == 2, "ConsumerLoan")
                   .when(nk == 3, "CC").when(nk == 4, "PL").otherwise("others"))
    flag = (F.when(k % 503 == 1, F.lit(None).cast("string"))
             .when(k % 251 == 250, "P9")
             .when(s >= 772, "P1").when(s >= 558, "P2").when(s >= 508, "P3").otherwise("P4"))
    cc_util = F.when((k % 5 == 0) | F.col("n").isNull(), F.lit(None).cast("double")).otherwise(
        r6(F.col("sd").cast("double") / F.col("n") / 10))
    return j.select(
        k.alias("prospectid"),
        F.when(k % 8 == 0, "F").otherwise("M").alias("GENDER"),
        education.alias("EDUCATION"),
        F.when(k % 11 < 8, "Married").otherwise("Single").alias("MARITALSTATUS"),
        (F.lit(21) + (k * 37) % 57).alias("AGE"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .otherwise(F.floor((F.col("c_acctbal") + 1000) * 500 + 0.5) / 100).alias("NETMONTHLYINCOME"),
        F.coalesce(F.col("dq"), F.lit(0).cast("long")).alias("num_times_delinquent"),
        cc_util.alias("CC_utilization"),
        last_prod.alias("last_prod_enq2"),
        first_prod.alias("first_prod_enq2"),
        cs.alias("Credit_Score"),
        flag.alias("Approved_Flag"),
    )


def label_expr(c: str = "Approved_Flag") -> Column:
    """P1..P4 -> 0..3, anything else -> null."""
    x = F.col(c)
    return (F.when(x == "P1", 0).when(x == "P2", 1).when(x == "P3", 2).when(x == "P4", 3)
             .otherwise(F.lit(None)).cast("int"))


def _rule_pred(p: Column) -> Column:
    return F.when(p >= 772, 0).when(p >= 558, 1).when(p >= 508, 2).otherwise(3).cast("int")


def rule_predictions(spark: SparkSession, sf_dir: str, ext: DataFrame | None = None) -> DataFrame:
    """Model-free predictions of two rule 'models' in long form (G8 shape).

    rule_a: p = Credit_Score - 2*num_times_delinquent + (k*13)%41 - 20
    rule_b: p = Credit_Score
    """
    ext = external(spark, sf_dir) if ext is None else ext
    e = ext.withColumn("actual", label_expr()).filter(F.col("actual").isNotNull())
    k = F.col("prospectid")
    pa = F.col("Credit_Score") - 2 * F.col("num_times_delinquent") + (k * 13) % 41 - 20
    a = e.select(F.lit("rule_a").alias("model"), k.alias("PROSPECTID"), "actual", _rule_pred(pa).alias("pred"))
    b = e.select(F.lit("rule_b").alias("model"), k.alias("PROSPECTID"), "actual",
                 _rule_pred(F.col("Credit_Score")).alias("pred"))
    return a.unionByName(b)


def unseen(spark: SparkSession, sf_dir: str, merged: DataFrame) -> DataFrame:
    """Scoring input: the merged rows without target, with three features
    absent, one extra column and an unseen GENDER category."""
    k = F.col("PROSPECTID")
    u = merged.drop("Approved_Flag", "EDUCATION", "Auto_TL", "CC_utilization")
    return (u.withColumn("GENDER", F.when(k % 30 == 3, F.lit("X")).otherwise(F.col("GENDER")))
             .withColumn("note", F.concat(F.lit("batch-"), (k % 7).cast("string"))))


# --- fixed values: literal coefficient tables for SQL-checkable scoring -------
# (model, feature, [coef class0..class3]) and (model, [intercept class0..3])
FIXED_COEFS = {
    "fixed_a": {
        "Credit_Score": [2.10, 0.85, -0.40, -1.90],
        "num_times_delinquent": [-0.35, -0.10, 0.20, 0.45],
        "CC_utilization": [-0.20, 0.05, 0.10, 0.30],
        "NETMONTHLYINCOME": [0.15, 0.10, -0.05, -0.12],
        "AGE": [0.05, 0.02, -0.01, -0.03],
        "Total_TL": [0.12, 0.08, -0.06, -0.09],
        "pct_active_tl": [-0.07, 0.03, 0.04, 0.06],
        "Age_Oldest_TL": [0.09, 0.04, -0.02, -0.05],
        "GENDER_F": [0.03, 0.01, -0.02, 0.00],
        "MARITALSTATUS_Married": [0.06, 0.02, -0.03, -0.04],
        "EDUCATION_GRADUATE": [0.08, 0.03, -0.02, -0.06],
        "last_prod_enq2_CC": [-0.05, 0.02, 0.04, 0.07],
    },
    "fixed_b": {
        "Credit_Score": [3.00, 1.00, -1.00, -3.00],
        "AGE": [0.04, 0.01, -0.02, -0.03],
        "GENDER_F": [0.02, 0.00, -0.01, -0.01],
    },
}
FIXED_INTERCEPTS = {
    "fixed_a": [-1.20, 1.40, -0.30, -1.10],
    "fixed_b": [-2.00, 1.50, -0.50, -1.50],
}
# (feature, bin, lo, hi, [score class0..class3]); lo inclusive, hi exclusive, None = open
FIXED_SHAPES = [
    ("Credit_Score", 0, None, -1.0, [-1.50, -0.60, 0.40, 1.20]),
    ("Credit_Score", 1, -1.0, 0.0, [-0.40, 0.10, 0.30, 0.20]),
    ("Credit_Score", 2, 0.0, 1.0, [0.30, 0.40, -0.20, -0.50]),
    ("Credit_Score", 3, 1.0, None, [1.60, 0.20, -0.70, -1.30]),
    ("num_times_delinquent", 0, None, 0.0, [0.20, 0.10, -0.10, -0.20]),
    ("num_times_delinquent", 1, 0.0, None, [-0.30, -0.05, 0.15, 0.35]),
    ("AGE", 0, None, -0.5, [-0.05, 0.00, 0.02, 0.03]),
    ("AGE", 1, -0.5, 0.5, [0.01, 0.02, -0.01, -0.02]),
    ("AGE", 2, 0.5, None, [0.06, 0.01, -0.03, -0.04]),
]


def fixed_coefficients(spark: SparkSession) -> DataFrame:
    """Long literal table (model, class, feature, coef); feature '(intercept)' holds b."""
    rows = []
    for m, feats in FIXED_COEFS.items():
        for f, cs in feats.items():
            rows += [(m, k, f, float(v)) for k, v in enumerate(cs)]
        rows += [(m, k, "(intercept)", float(v)) for k, v in enumerate(FIXED_INTERCEPTS[m])]
    return spark.createDataFrame(rows, "model string, class int, feature string, coef double")


# --- fixed values: literal questions (one per intent + edge cases) -----------
LITERAL_QUESTIONS = [
    (1, "explain applicant 42"),
    (2, "Why was applicant 7 rejected?"),
    (3, "tell me about applicant 15"),
    (4, "compare applicants 5 and 12"),
    (5, "compare applicant 3 vs. 9"),
    (6, "what features drive approvals?"),
    (7, "Which factors matter most?"),
    (8, "show global importance"),
    (9, "fairness for GENDER"),
    (10, "bias in education"),
    (11, "fairness"),
    (12, "discrimination for EDUCATION"),
    (13, "how accurate is the model?"),
    (14, "what is the auc"),
    (15, "help"),
    (16, "What drives approvals?"),
    (17, "explain applicant 99999999"),
    (18, "fairness for INCOME"),
    (19, "fair état"),
    (20, "  EXPLAIN applicant 10 \n"),
    (21, "fairness for maritalstatus"),
    (22, "compare applicants 2 with 99999999"),
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question table: literal cases plus every user turn of ``conversations``."""
    lit = spark.createDataFrame(LITERAL_QUESTIONS, "qid long, text string")
    conv = (read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
            .select((F.lit(1_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text"))
    return lit.unionByName(conv)
