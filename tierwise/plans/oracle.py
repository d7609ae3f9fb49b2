"""DuckDB SQL oracles for the registered queries.

Each oracle recomputes its query from the raw driver views with plain SQL:
the fixtures, the preparation statistics, the split, the scores and the
metrics.  A small CTE library is assembled per query (only the CTEs it
needs).  Shared inputs are only literal tables (coefficients, shapes,
questions, patterns) - never results of the Spark side.
"""

from __future__ import annotations

from ..constants import (ANSWER_COMPARE, ANSWER_EXPLAIN, ANSWER_FAIRNESS, ANSWER_GLOBAL, ANSWER_PERFORMANCE,
                         ATTR_NOT_FOUND, CATEGORICAL_COLS, COMPARE_LINE, COMPARE_OUT_OF_RANGE, COMPARISON_METRICS,
                         DEFAULT_RECOMMENDATION, DPD_VERDICTS, EXPLAIN_OUT_OF_RANGE, EXTERNAL_CONTRACT, FAIRNESS_LINE, GLOBAL_LINE,
                         HEADLINE_AVOIDED_MEANING, HEADLINE_RESIDUAL_MEANING, HEADLINE_ROWS, HELP_TEXT,
                         INTENT_PATTERNS, INTERNAL_CONTRACT, NARRATIVE, NARRATIVE_ACTIONS, NARRATIVE_ACTIONS_HEAD, PERFORMANCE_ROW,
                         PROMPT_EXPLAIN, PROMPT_LINE, REASON_LINE, SENSITIVE_ATTRS, TIER_ACTION_BUSINESS,
                         TIER_CODES, TIER_TEXT_ANALYST, TIER_TEXT_BUSINESS, TIER_TEXT_SCORING, UNKNOWN_TEXT)
from ..functions.text import template_parts
from ..sources.fixtures import FIXED_COEFS, FIXED_INTERCEPTS, FIXED_SHAPES, LITERAL_QUESTIONS

NUMS = ["Total_TL", "Tot_Closed_TL", "Tot_Active_TL", "Total_TL_opened_L6M", "Total_TL_opened_L12M",
        "pct_active_tl", "pct_closed_tl", "Auto_TL", "CC_TL", "Consumer_TL", "Home_TL", "PL_TL",
        "Age_Oldest_TL", "Age_Newest_TL", "Const_TL", "AGE", "NETMONTHLYINCOME", "num_times_delinquent",
        "CC_utilization", "Credit_Score"]
CATS = list(CATEGORICAL_COLS)
UNSEEN_ABSENT = ["EDUCATION", "Auto_TL", "CC_utilization"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill_sql(template: str, **exprs: str) -> str:
    """The same fixed format as ``functions.text.fill``, as SQL concatenation."""
    return "(" + " || ".join(q(p) if kind == "lit" else f"({exprs[p]})" for kind, p in template_parts(template)) + ")"


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def rn(x: str, d: int) -> str:
    return f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"


def tier_of(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {k} THEN '{t}'" for k, t in enumerate(TIER_CODES)) + " END"


def sq(x: str) -> str:
    """An identifier quoted for DuckDB (mixed case, hyphens)."""
    return '"' + x.replace('"', '""') + '"'


def spark_pct(table: str, col: str, pos_expr: str) -> str:
    """Spark's exact percentile (linear interpolation between the order
    statistics at floor/ceil of (n-1)*p) as a scalar subquery."""
    return f"""(SELECT CASE WHEN lo_v = hi_v THEN lo_v ELSE (hp - pos) * lo_v + (pos - lp) * hi_v END FROM (
  SELECT pos, floor(pos) AS lp, ceil(pos) AS hp,
         max(x) FILTER (WHERE i = floor(pos)) AS lo_v, max(x) FILTER (WHERE i = ceil(pos)) AS hi_v
  FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n
        FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL)) s,
       (SELECT ({pos_expr}) AS pos FROM (SELECT count(*) AS n FROM {table} WHERE {col} IS NOT NULL))
  GROUP BY pos))"""


# ------------------------------------------------------------------ CTE library
CTE: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTE[name] = (sql, deps)


cte("internal", [], """
SELECT o_custkey AS PROSPECTID,
  count(*) AS Total_TL,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS Tot_Closed_TL,
  count(*) FILTER (WHERE o_orderstatus <> 'F') AS Tot_Active_TL,
  count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-02-01') AS Total_TL_opened_L6M,
  count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-08-01') AS Total_TL_opened_L12M,
  floor(CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS pct_active_tl,
  floor(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS pct_closed_tl,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS Auto_TL,
  count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS CC_TL,
  count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS Consumer_TL,
  count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS Home_TL,
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS PL_TL,
  CAST((2001 - year(min(o_orderdate))) * 12 + 8 - month(min(o_orderdate)) AS INTEGER) AS Age_Oldest_TL,
  CAST((2001 - year(max(o_orderdate))) * 12 + 8 - month(max(o_orderdate)) AS INTEGER) AS Age_Newest_TL,
  CAST(0 AS INTEGER) AS Const_TL
FROM orders GROUP BY o_custkey""")

cte("cust_lines", [], """
SELECT o.o_custkey,
  count(*) FILTER (WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F') AS dq,
  sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS sd, count(*) AS n
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""")

cte("external0", ["cust_lines"], """
SELECT c.c_custkey AS k, c.c_nationkey, c.c_acctbal, c.c_mktsegment, cl.dq, cl.sd, cl.n,
  469 + CAST(floor((c.c_acctbal + 1000) * 342 / 11000) AS BIGINT) AS cs
FROM customer c LEFT JOIN cust_lines cl ON cl.o_custkey = c.c_custkey""")

cte("external", ["external0"], """
SELECT k AS prospectid,
  CASE WHEN k % 8 = 0 THEN 'F' ELSE 'M' END AS GENDER,
  CASE WHEN (k * 7 + 3) % 13 = 12 THEN NULL WHEN (k * 7 + 3) % 13 <= 3 THEN 'GRADUATE'
       WHEN (k * 7 + 3) % 13 <= 5 THEN '12TH' WHEN (k * 7 + 3) % 13 = 6 THEN 'SSC'
       WHEN (k * 7 + 3) % 13 <= 8 THEN 'UNDER GRADUATE' WHEN (k * 7 + 3) % 13 = 9 THEN 'OTHERS'
       WHEN (k * 7 + 3) % 13 = 10 THEN 'POST-GRADUATE' ELSE 'PROFESSIONAL' END AS EDUCATION,
  CASE WHEN k % 11 < 8 THEN 'Married' ELSE 'Single' END AS MARITALSTATUS,
  21 + (k * 37) % 57 AS AGE,
  CASE WHEN k % 17 = 0 THEN NULL ELSE floor((c_acctbal + 1000) * 500 + 0.5) / 100 END AS NETMONTHLYINCOME,
  coalesce(dq, 0) AS num_times_delinquent,
  CASE WHEN k % 5 = 0 OR n IS NULL THEN NULL ELSE floor(CAST(sd AS DOUBLE) / n / 10 * 1e6 + 0.5) / 1e6 END AS CC_utilization,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AL' WHEN 'BUILDING' THEN 'HL' WHEN 'FURNITURE' THEN 'ConsumerLoan'
       WHEN 'HOUSEHOLD' THEN 'CC' ELSE 'others' END AS last_prod_enq2,
  CASE c_nationkey % 6 WHEN 0 THEN 'AL' WHEN 1 THEN 'HL' WHEN 2 THEN 'ConsumerLoan' WHEN 3 THEN 'CC'
       WHEN 4 THEN 'PL' ELSE 'others' END AS first_prod_enq2,
  cs AS Credit_Score,
  CASE WHEN k % 503 = 1 THEN NULL WHEN k % 251 = 250 THEN 'P9'
       WHEN (CASE WHEN (k * 31) % 10 = 0 THEN cs - 60 ELSE cs END) >= 772 THEN 'P1'
       WHEN (CASE WHEN (k * 31) % 10 = 0 THEN cs - 60 ELSE cs END) >= 558 THEN 'P2'
       WHEN (CASE WHEN (k * 31) % 10 = 0 THEN cs - 60 ELSE cs END) >= 508 THEN 'P3' ELSE 'P4' END AS Approved_Flag
FROM external0""")

cte("merged", ["internal", "external"], """
SELECT i.*, e.* EXCLUDE (prospectid) FROM internal i JOIN external e ON i.PROSPECTID IS NOT DISTINCT FROM e.prospectid""")

LABEL_SQL = "CASE Approved_Flag WHEN 'P1' THEN 0 WHEN 'P2' THEN 1 WHEN 'P3' THEN 2 WHEN 'P4' THEN 3 END"


def _pos_median() -> str:
    return "(n - 1) * 0.5"


cte("medians", ["merged"], "SELECT " + ",\n  ".join(
    f"{spark_pct('merged', c, _pos_median())} AS md_{c}" for c in NUMS))

cte("merge_hot_sides", [], """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 41 = 1 THEN NULL ELSE o_custkey END AS k, o_orderkey AS a, NULL AS b FROM orders
UNION ALL SELECT CASE WHEN c_custkey % 40 = 0 THEN 0 WHEN c_custkey % 41 = 1 THEN NULL ELSE c_custkey END, NULL, c_custkey FROM customer""")

cte("modes", ["merged"], "SELECT " + ",\n  ".join(
    f"(SELECT {c} FROM merged WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mo_{c}"
    for c in CATS))

cte("cats", ["merged"], "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS col, {c} AS cat FROM merged WHERE {c} IS NOT NULL" for c in CATS))

cte("imputed", ["merged", "medians", "modes"], "SELECT m.PROSPECTID, m.Approved_Flag, " + ", ".join(
    f"coalesce(CAST(m.{c} AS DOUBLE), md.md_{c}) AS {c}" for c in NUMS) + ", " + ", ".join(
    f"coalesce(m.{c}, mo.mo_{c}) AS {c}" for c in CATS) + " FROM merged m, medians md, modes mo")

cte("moments", ["imputed"], "SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMS) + " FROM imputed")

cte("prepared", ["imputed", "moments"], "SELECT i.PROSPECTID, " + ", ".join(
    f"(i.{c} - mo.mu_{c}) / CASE WHEN mo.sd_{c} = 0 THEN 1 ELSE mo.sd_{c} END AS {c}" for c in NUMS)
    + ", " + ", ".join(f"i.{c} AS {c}" for c in CATS)
    + f", {LABEL_SQL.replace('Approved_Flag', 'i.Approved_Flag')} AS label FROM imputed i, moments mo")

cte("known", ["prepared"], "SELECT * FROM prepared WHERE label IS NOT NULL")

cte("prep_long", ["prepared", "cats"], "\nUNION ALL\n".join(
    [f"SELECT PROSPECTID, label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM prepared" for c in NUMS]
    + [f"SELECT p.PROSPECTID, p.label, '{c}_' || ct.cat AS feature, CASE WHEN p.{c} = ct.cat THEN 1.0 ELSE 0.0 END "
       f"AS value FROM prepared p JOIN cats ct ON ct.col = '{c}'" for c in CATS]))

# --- unseen: merged rows, three columns absent (raw 0.0 / fitted mode), GENDER 'X' where k%30=3
cte("unseen_prepared", ["merged", "medians", "modes", "moments"], "SELECT m.PROSPECTID, " + ", ".join(
    f"(coalesce({'0.0' if c in UNSEEN_ABSENT else f'CAST(m.{c} AS DOUBLE)'}, md.md_{c}) - mo.mu_{c}) / "
    f"CASE WHEN mo.sd_{c} = 0 THEN 1 ELSE mo.sd_{c} END AS {c}" for c in NUMS) + ", " + ", ".join(
    (f"md2.mo_{c} AS {c}" if c in UNSEEN_ABSENT else
     (f"coalesce(CASE WHEN m.PROSPECTID % 30 = 3 THEN 'X' ELSE m.GENDER END, md2.mo_{c}) AS {c}" if c == "GENDER"
      else f"coalesce(m.{c}, md2.mo_{c}) AS {c}")) for c in CATS)
    + " FROM merged m, medians md, modes md2, moments mo")

cte("unseen_long", ["unseen_prepared", "cats"], "\nUNION ALL\n".join(
    [f"SELECT PROSPECTID, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM unseen_prepared" for c in NUMS]
    + [f"SELECT p.PROSPECTID, '{c}_' || ct.cat AS feature, CASE WHEN p.{c} = ct.cat THEN 1.0 ELSE 0.0 END "
       f"AS value FROM unseen_prepared p JOIN cats ct ON ct.col = '{c}'" for c in CATS]))

# --- exact stratified split: largest-remainder train quota, md5 order within class
cte("class_counts", ["known"], "SELECT label, count(*) AS n_c FROM known GROUP BY label")
cte("split_alloc", ["class_counts"], """
SELECT label, n_c, n_c - (base + CASE WHEN rk <= extra THEN 1 ELSE 0 END) AS test_q FROM (
  SELECT label, n_c, base, row_number() OVER (ORDER BY rem DESC, label) AS rk,
         n_train - sum(base) OVER () AS extra FROM (
    SELECT label, n_c, n_train, (n_c * n_train) // n AS base, n_c * n_train - ((n_c * n_train) // n) * n AS rem
    FROM class_counts, (SELECT sum(n_c) AS n, sum(n_c) - (sum(n_c) * 20 + 99) // 100 AS n_train FROM class_counts)))""")
cte("split", ["known", "split_alloc"], """
SELECT r.*, CASE WHEN r.rn <= a.test_q THEN 'test' ELSE 'train' END AS split FROM (
  SELECT k.*, row_number() OVER (PARTITION BY k.label ORDER BY md5(CAST(k.PROSPECTID AS VARCHAR) || '|split42'),
         k.PROSPECTID) AS rn FROM known k) r JOIN split_alloc a ON a.label = r.label""")
cte("sample_alloc", ["class_counts"], """
SELECT label, base + CASE WHEN rk <= extra THEN 1 ELSE 0 END AS q FROM (
  SELECT label, base, row_number() OVER (ORDER BY rem DESC, label) AS rk, n_draw - sum(base) OVER () AS extra FROM (
    SELECT label, n_draw, (n_c * n_draw) // n AS base, n_c * n_draw - ((n_c * n_draw) // n) * n AS rem
    FROM class_counts, (SELECT sum(n_c) AS n, (sum(n_c) * 25) // 100 AS n_draw FROM class_counts)))""")

# --- fixed models: features as columns of the prepared matrix
FIXED_FEATS = sorted({f for m in FIXED_COEFS.values() for f in m})


def feat_expr(f: str, alias: str = "") -> str:
    p = alias + "." if alias else ""
    if f in NUMS:
        return f"{p}{f}"
    for c in CATS:
        if f.startswith(c + "_"):
            return f"CASE WHEN {p}{c} = {q(f[len(c) + 1:])} THEN 1.0 ELSE 0.0 END"
    raise KeyError(f)


cte("fx_split", ["split"], "SELECT PROSPECTID, label, split, " + ", ".join(
    f"{feat_expr(f)} AS {f}" for f in FIXED_FEATS) + " FROM split")
cte("fx_known", ["known"], "SELECT PROSPECTID, label, " + ", ".join(
    f"{feat_expr(f)} AS {f}" for f in FIXED_FEATS) + " FROM known")
cte("fx_unseen", ["unseen_prepared"], "SELECT PROSPECTID, " + ", ".join(
    f"{feat_expr(f)} AS {f}" for f in FIXED_FEATS) + " FROM unseen_prepared")
cte("bg", ["fx_split"], "SELECT " + ", ".join(f"avg({f}) AS bg_{f}" for f in FIXED_FEATS)
    + " FROM fx_split WHERE split = 'train'")
cte("bg_long", ["bg"], "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, bg_{f} AS mu FROM bg" for f in FIXED_FEATS))


def model_feats(m: str) -> list[str]:
    return sorted(FIXED_COEFS[m])


def logit_sql(m: str, k: int, alias: str = "") -> str:
    p = alias + "." if alias else ""
    z = dbl(FIXED_INTERCEPTS[m][k])
    for f in model_feats(m):
        z = f"{z} + {dbl(FIXED_COEFS[m][f][k])} * {p}{f}"
    return z


def scored_sql(m: str, src: str, keep: str) -> str:
    """Softmax with max shift and argmax (ties to the lower class), like the Spark side."""
    zs = ", ".join(f"{logit_sql(m, k)} AS z{k}" for k in range(4))
    return f"""SELECT {keep}, z0, z1, z2, z3, greatest(z0, z1, z2, z3) AS zm FROM (SELECT {keep}, {zs} FROM {src})"""


def probs_sql(inner: str, keep: str) -> str:
    ex = [f"exp(z{k} - zm)" for k in range(4)]
    tot = f"(({ex[0]} + {ex[1]}) + {ex[2]}) + {ex[3]}"
    pred = "CASE WHEN z0 = zm THEN 0 WHEN z1 = zm THEN 1 WHEN z2 = zm THEN 2 ELSE 3 END"
    return (f"SELECT {keep}, " + ", ".join(f"{ex[k]} / ({tot}) AS Prob_{t}" for k, t in enumerate(TIER_CODES))
            + f", {pred} AS pred FROM ({inner})")


for _m in FIXED_COEFS:
    cte(f"test_{_m}", ["fx_split"], probs_sql(scored_sql(_m, "(SELECT * FROM fx_split WHERE split = 'test')",
                                                          "PROSPECTID, label"), "PROSPECTID, label"))
    cte(f"all_{_m}", ["fx_known"], probs_sql(scored_sql(_m, "fx_known", "PROSPECTID, label"), "PROSPECTID, label"))
cte("unseen_fixed_a", ["fx_unseen"], probs_sql(scored_sql("fixed_a", "fx_unseen", "PROSPECTID"), "PROSPECTID"))

cte("fixed_preds", ["test_fixed_a", "test_fixed_b"], "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, PROSPECTID, label AS actual, pred, Prob_P1, Prob_P2, Prob_P3, Prob_P4 FROM test_{m}"
    for m in FIXED_COEFS))

cte("rule_preds", ["external"], """
SELECT 'rule_a' AS model, prospectid AS PROSPECTID, label AS actual,
  CASE WHEN p >= 772 THEN 0 WHEN p >= 558 THEN 1 WHEN p >= 508 THEN 2 ELSE 3 END AS pred
FROM (SELECT prospectid, Credit_Score - 2 * num_times_delinquent + (prospectid * 13) % 41 - 20 AS p,
             """ + LABEL_SQL + """ AS label FROM external) WHERE label IS NOT NULL
UNION ALL
SELECT 'rule_b' AS model, prospectid AS PROSPECTID, label AS actual,
  CASE WHEN Credit_Score >= 772 THEN 0 WHEN Credit_Score >= 558 THEN 1 WHEN Credit_Score >= 508 THEN 2 ELSE 3 END
FROM (SELECT prospectid, Credit_Score, """ + LABEL_SQL + """ AS label FROM external) WHERE label IS NOT NULL""")

# --- evaluation over a predictions CTE
def eval_ctes(src: str, prefix: str) -> None:
    cte(f"{prefix}_cm", [src], f"""
SELECT m.model, CAST(a.k AS INTEGER) AS actual, CAST(p.k AS INTEGER) AS predicted, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT model FROM {src}) m CROSS JOIN range(4) a(k) CROSS JOIN range(4) p(k)
LEFT JOIN (SELECT model, actual, pred, count(*) AS n FROM {src} GROUP BY ALL) c
  ON c.model = m.model AND c.actual = a.k AND c.pred = p.k""")
    cte(f"{prefix}_rep", [f"{prefix}_cm"], f"""
SELECT s.model, s.class, s.support, s.tp, np.n_pred,
  coalesce(CAST(s.tp AS DOUBLE) / nullif(np.n_pred, 0), 0.0) AS precision,
  coalesce(CAST(s.tp AS DOUBLE) / nullif(s.support, 0), 0.0) AS recall
FROM (SELECT model, actual AS class, CAST(sum(n) AS BIGINT) AS support,
             CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS tp FROM {prefix}_cm GROUP BY ALL) s
JOIN (SELECT model, predicted AS class, CAST(sum(n) AS BIGINT) AS n_pred FROM {prefix}_cm GROUP BY ALL) np
  ON np.model = s.model AND np.class = s.class""")
    cte(f"{prefix}_rep2", [f"{prefix}_rep"], f"""
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM {prefix}_rep""")
    cte(f"{prefix}_f1", [f"{prefix}_rep2"], f"""
SELECT model, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM {prefix}_rep2 GROUP BY model""")
    cte(f"{prefix}_acc", [src], f"""
SELECT model, count(*) AS n, count(*) FILTER (WHERE actual = pred) AS correct,
       CAST(count(*) FILTER (WHERE actual = pred) AS DOUBLE) / count(*) AS accuracy FROM {src} GROUP BY model""")


eval_ctes("rule_preds", "rule")
eval_ctes("fixed_preds", "fx")

cte("roc", ["fixed_preds"], """
SELECT model, class, score, pos, neg,
  CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY model, class) AS BIGINT) AS P, CAST(sum(neg) OVER (PARTITION BY model, class) AS BIGINT) AS N
FROM (SELECT model, class, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM (
        SELECT model, 0 AS class, Prob_P1 AS score, CAST(actual = 0 AS INTEGER) AS y FROM fixed_preds UNION ALL
        SELECT model, 1, Prob_P2, CAST(actual = 1 AS INTEGER) FROM fixed_preds UNION ALL
        SELECT model, 2, Prob_P3, CAST(actual = 2 AS INTEGER) FROM fixed_preds UNION ALL
        SELECT model, 3, Prob_P4, CAST(actual = 3 AS INTEGER) FROM fixed_preds) GROUP BY ALL)
WINDOW w AS (PARTITION BY model, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("auc", ["roc"], """
SELECT model, CAST(class AS INTEGER) AS class,
  sum(neg * (2 * tp - pos)) / (2.0 * first(P) * first(N)) AS auc FROM roc GROUP BY model, class""")
cte("fx_summary", ["fx_f1", "auc", "fx_acc"], """
SELECT f.model, f.f1_macro, f.f1_weighted, a.auc_ovr, c.accuracy FROM fx_f1 f
JOIN (SELECT model, avg(auc) AS auc_ovr FROM auc GROUP BY model) a ON a.model = f.model
JOIN fx_acc c ON c.model = f.model""")


def money_ctes(src: str, prefix: str) -> None:
    cte(f"{prefix}_dc", [src], f"""
SELECT model, count(*) AS n_test,
  count(*) FILTER (WHERE pred <= 1) AS approved, count(*) FILTER (WHERE pred = 2) AS marginal,
  count(*) FILTER (WHERE pred = 3) AS rejected,
  count(*) FILTER (WHERE actual = 0 AND pred = 0) AS tp_p1, count(*) FILTER (WHERE actual = 1 AND pred = 1) AS tp_p2,
  count(*) FILTER (WHERE actual = 2 AND pred = 2) AS tp_p3, count(*) FILTER (WHERE actual = 3 AND pred = 3) AS tp_p4,
  count(*) FILTER (WHERE actual = 3 AND pred <= 1) AS fn_p4
FROM {src} GROUP BY model""")
    cte(f"{prefix}_money", [f"{prefix}_dc"], f"""
SELECT *, tp_p1 + tp_p2 + tp_p3 + tp_p4 AS total_correct,
  CAST(approved AS DOUBLE) / n_test AS approval_rate,
  CAST(tp_p1 + tp_p2 + tp_p3 + tp_p4 AS DOUBLE) / n_test AS accuracy,
  200000.0 AS avg_loan, 0.4 AS p4_rate, 0.15 AS p3_rate,
  tp_p4 * 200000.0 * 0.4 AS npa_p4, tp_p3 * 200000.0 * 0.15 AS npa_p3,
  tp_p4 * 200000.0 * 0.4 + tp_p3 * 200000.0 * 0.15 AS npa_total,
  fn_p4 * 200000.0 * 0.4 AS npa_exposure
FROM {prefix}_dc""")


money_ctes("rule_preds", "rule")
money_ctes("fixed_preds", "fx")
cte("fx_metrics", ["fx_money", "fx_summary"], """
SELECT m.*, s.f1_macro, s.f1_weighted, s.auc_ovr FROM fx_money m JOIN fx_summary s ON s.model = m.model""")

# --- fairness over rule predictions joined to attributes by key
def fair_ctes(src: str, prefix: str, attrs: list[str]) -> None:
    cte(f"{prefix}_long", [src, "external"], "\nUNION ALL\n".join(
        f"""SELECT p.model, p.actual, p.pred, CAST(p.actual IN (0, 1) AS INTEGER) AS y_true,
       CAST(p.pred IN (0, 1) AS INTEGER) AS y_pred, '{a}' AS attr, CAST(e.{a} AS VARCHAR) AS grp
FROM {src} p LEFT JOIN external e ON e.prospectid = p.PROSPECTID WHERE e.{a} IS NOT NULL""" for a in attrs))
    cte(f"{prefix}_rates", [f"{prefix}_long"], f"""
SELECT model, attr, grp, count(*) AS n, avg(y_pred) AS selection_rate,
  avg(CASE WHEN y_true = 1 THEN y_pred END) AS tpr, avg(CASE WHEN y_true = 0 THEN y_pred END) AS fpr,
  """ + ", ".join(f"avg(CAST(pred = {k} AS INTEGER)) AS share_{t}" for k, t in enumerate(TIER_CODES)) + f"""
FROM {prefix}_long GROUP BY model, attr, grp""")
    cte(f"{prefix}_diff", [f"{prefix}_rates"], f"""
SELECT *, greatest(tpr_gap, fpr_gap) AS eod FROM (
  SELECT model, attr, max(selection_rate) - min(selection_rate) AS dpd,
    CASE WHEN count(tpr) > 1 THEN max(tpr) - min(tpr) ELSE 0.0 END AS tpr_gap,
    CASE WHEN count(fpr) > 1 THEN max(fpr) - min(fpr) ELSE 0.0 END AS fpr_gap,
    avg(selection_rate) AS mean_group_rate FROM {prefix}_rates GROUP BY model, attr)""")
    cte(f"{prefix}_ext", [f"{prefix}_rates"], f"""
SELECT model, attr,
  max(grp) FILTER (WHERE rh = 1) AS highest_group, max(selection_rate) FILTER (WHERE rh = 1) AS highest_rate,
  max(grp) FILTER (WHERE rl = 1) AS lowest_group, max(selection_rate) FILTER (WHERE rl = 1) AS lowest_rate
FROM (SELECT *, row_number() OVER (PARTITION BY model, attr ORDER BY selection_rate DESC, grp) AS rh,
             row_number() OVER (PARTITION BY model, attr ORDER BY selection_rate, grp) AS rl FROM {prefix}_rates)
GROUP BY model, attr""")


fair_ctes("rule_preds", "rf", ["GENDER", "EDUCATION", "MARITALSTATUS"])
fair_ctes("rule_preds", "rfx", ["first_prod_enq2", "AGE"])
cte("fixed_a_preds", ["fixed_preds"], "SELECT * FROM fixed_preds WHERE model = 'fixed_a'")
fair_ctes("fixed_a_preds", "af", ["GENDER", "EDUCATION", "MARITALSTATUS", "AGE", "NETMONTHLYINCOME"])


def traffic(x: str) -> str:
    return f"CASE WHEN {x} < 0.05 THEN 'Acceptable' WHEN {x} < 0.1 THEN 'Monitor' ELSE 'Action Required' END"


def pct1(x: str, d: int = 1) -> str:
    """f'{x:.1%}' with half-up rounding first (as the Spark side)."""
    return f"printf('%.{d}f', {rn(f'({x}) * 100.0', d)}) || '%'"


def fixed(x: str, d: int, signed: bool = False) -> str:
    if not signed:
        return f"printf('%.{d}f', {rn(x, d)})"
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '+' END || printf('%.{d}f', {rn(f'abs({x})', d)})"


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def crore(x: str) -> str:
    return f"'Rs ' || printf('%,.2f', {rn(f'({x}) / 1e7', 2)}) || ' Cr'"


# --- explanations (fixed_a over all labelled rows)
def coef_values(m: str) -> str:
    rows = [f"({q(f)}, {k}, {dbl(v)})" for f, cs in FIXED_COEFS[m].items() for k, v in enumerate(cs)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(feature, class, coef)"


def coef_wide(m: str) -> str:
    rows = [f"({q(f)}, " + ", ".join(dbl(v) for v in cs) + ")" for f, cs in FIXED_COEFS[m].items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(feature, c0, c1, c2, c3)"


cte("fa_long", ["fx_known"], "\nUNION ALL\n".join(
    f"SELECT PROSPECTID, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM fx_known"
    for f in model_feats("fixed_a")))
cte("fa_coefs", [], coef_values("fixed_a"))
cte("fa_cw", [], coef_wide("fixed_a"))
cte("fa_phi", ["fa_long", "fa_coefs", "bg_long"], """
SELECT l.PROSPECTID, l.feature, CAST(c.class AS INTEGER) AS class, l.value, c.coef * (l.value - b.mu) AS phi
FROM fa_long l JOIN fa_coefs c ON c.feature = l.feature JOIN bg_long b ON b.feature = l.feature""")
cte("fa_feat", ["fa_long", "fa_cw", "bg_long", "all_fixed_a"], """
SELECT l.PROSPECTID, l.feature, l.value, s.pred,
  (((abs(c.c0 * (l.value - b.mu)) + abs(c.c1 * (l.value - b.mu))) + abs(c.c2 * (l.value - b.mu)))
    + abs(c.c3 * (l.value - b.mu))) / 4.0 AS mean_abs,
  ((((c.c0 * (l.value - b.mu)) + (c.c1 * (l.value - b.mu))) + (c.c2 * (l.value - b.mu)))
    + (c.c3 * (l.value - b.mu))) / 4.0 AS mean_phi,
  CASE s.pred WHEN 0 THEN c.c0 * (l.value - b.mu) WHEN 1 THEN c.c1 * (l.value - b.mu)
              WHEN 2 THEN c.c2 * (l.value - b.mu) ELSE c.c3 * (l.value - b.mu) END AS phi_pred,
  s.Prob_P1, s.Prob_P2, s.Prob_P3, s.Prob_P4
FROM fa_long l JOIN fa_cw c ON c.feature = l.feature JOIN bg_long b ON b.feature = l.feature
JOIN all_fixed_a s ON s.PROSPECTID = l.PROSPECTID""")
cte("fa_topn", ["fa_feat"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PROSPECTID ORDER BY mean_abs DESC, feature) AS rank
               FROM fa_feat) WHERE rank <= 10""")
cte("fa_global", ["fa_feat"], """
SELECT * FROM (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank
               FROM (SELECT feature, avg(mean_abs) AS importance FROM fa_feat GROUP BY feature)) WHERE rank <= 10""")
cte("fa_info", ["all_fixed_a"], f"""
SELECT PROSPECTID, {tier_of('pred')} AS pred_tier,
  CASE pred WHEN 0 THEN Prob_P1 WHEN 1 THEN Prob_P2 WHEN 2 THEN Prob_P3 ELSE Prob_P4 END AS confidence
FROM all_fixed_a""")

# --- questions
_WORD = r"[\p{L}\p{N}_]"
PATS = [p.replace(r"\w", _WORD) for p, _ in INTENT_PATTERNS]
cte("questions", [], "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(t)})" for i, t in LITERAL_QUESTIONS)
    + ") t(qid, text) UNION ALL SELECT 1000000 + conv_id * 1000 + turn AS qid, text FROM conversations "
      "WHERE role = 'user'")
cte("routed0", ["questions"], "SELECT qid, text, q, CASE " + " ".join(
    f"WHEN regexp_matches(q, {q(p)}) THEN {i}" for i, p in enumerate(PATS, start=1))
    + r" ELSE 0 END AS pattern_no FROM (SELECT qid, text, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS q "
      "FROM questions)")
cte("routed", ["routed0"], "SELECT qid, pattern_no, CASE pattern_no " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(INTENT_PATTERNS, start=1))
    + f""" ELSE 'unknown' END AS intent,
  CASE WHEN pattern_no = 1 THEN TRY_CAST(regexp_extract(q, {q(PATS[0])}, 1) AS BIGINT) END AS idx,
  CASE WHEN pattern_no = 2 THEN TRY_CAST(regexp_extract(q, {q(PATS[1])}, 1) AS BIGINT) END AS idx_a,
  CASE WHEN pattern_no = 2 THEN TRY_CAST(regexp_extract(q, {q(PATS[1])}, 2) AS BIGINT) END AS idx_b,
  CASE WHEN pattern_no = 5 THEN upper(coalesce(nullif(regexp_extract(q, {q(PATS[4])}, 1), ''), 'GENDER')) END AS attr
FROM routed0""")
cte("pairs", ["routed"], "SELECT DISTINCT idx_a, idx_b FROM routed WHERE intent = 'compare_applicants'")
cte("fa_delta", ["pairs", "fa_phi", "all_fixed_a"], """
SELECT * FROM (
  SELECT p.idx_a, p.idx_b, a.class, a.feature, a.phi AS va, b.phi AS vb, b.phi - a.phi AS delta,
         row_number() OVER (PARTITION BY p.idx_a, p.idx_b ORDER BY abs(b.phi - a.phi) DESC, a.feature) AS rank
  FROM pairs p JOIN all_fixed_a s ON s.PROSPECTID = p.idx_a
  JOIN fa_phi a ON a.PROSPECTID = p.idx_a AND a.class = s.pred
  JOIN fa_phi b ON b.PROSPECTID = p.idx_b AND b.feature = a.feature AND b.class = s.pred)
WHERE rank <= 5""")


def with_ctes(final: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)
    for n in needs:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS (\n{CTE[n][0]}\n)" for n in order) + "\n" + final


ORACLES: dict[str, str] = {}


def oracle(name: str, needs: list[str], final: str) -> None:
    ORACLES[name] = with_ctes(final, needs)


# =========================================================== G2 boosting
_BOOST = {"Credit_Score": [520.0, 560.0, 640.0, 720.0, 772.0], "AGE": [30.0, 45.0, 60.0], "num_times_delinquent": [1.0, 3.0]}


def _boost_sql() -> None:
    """Two rounds of gradient and Hessian sums: at the class shares, and after a quarter of the Newton step."""
    bins = ", ".join("(" + " + ".join(f"CASE WHEN {f} >= {e} THEN 1 ELSE 0 END" for e in edges) + f") AS b{i}"
                     for i, (f, edges) in enumerate(_BOOST.items()))
    names = list(_BOOST)
    z0 = ", ".join(f"ln((SELECT count(*) FILTER (WHERE label = {k}) FROM known_rows)::DOUBLE / (SELECT count(*) FROM known_rows)) AS z{k}"
                   for k in range(4))

    def sums(src: str, r: int) -> str:
        total = " + ".join(f"exp(z{j} - zm)" for j in range(4))
        return "\nUNION ALL\n".join(
            f"""SELECT {r} AS round, '{f}' AS feature, b{i} AS bin, {k} AS class, count(*) AS n,
  sum(exp(z{k} - zm) / ({total}) - (label = {k})::INTEGER) AS g,
  sum(exp(z{k} - zm) / ({total}) * (1 - exp(z{k} - zm) / ({total}))) AS h
FROM (SELECT *, greatest(z0, z1, z2, z3) AS zm FROM {src}) GROUP BY b{i}""" for i, f in enumerate(names) for k in range(4))

    def moved(k: int) -> str:
        return f"z{k}" + "".join(f" + 0.25 * (SELECT -g / (h + 1) FROM first_round t WHERE t.feature = '{f}' AND t.bin = b{i} AND t.class = {k})"
                                 for i, f in enumerate(names)) + f" AS z{k}"

    cte("known_rows", ["merged"], f"SELECT *, {LABEL_SQL} AS label FROM merged WHERE {LABEL_SQL} IS NOT NULL")
    cte("at_shares", ["known_rows"], f"SELECT label, {bins}, {z0} FROM known_rows")
    cte("first_round", ["at_shares"], sums("at_shares", 0))
    cte("after_step", ["at_shares", "first_round"], f"SELECT label, b0, b1, b2, {', '.join(moved(k) for k in range(4))} FROM at_shares")
    cte("second_round", ["after_step"], sums("after_step", 1))
    oracle("boost_histogram", ["first_round", "second_round"], f"""
SELECT round::INTEGER AS round, feature, bin::INTEGER AS bin, class::INTEGER AS class, n, {r6('g')} AS g, {r6('h')} AS h
FROM (SELECT * FROM first_round UNION ALL SELECT * FROM second_round)""")


_boost_sql()
ORACLES["boost_rounds"] = """SELECT b::INTEGER AS bag, r::INTEGER AS round, true AS falls FROM range(2) bags(b), range(7) rounds(r)"""

# =========================================================== A / B / C / D
oracle("internal_table", ["internal"], "SELECT * FROM internal")
oracle("external_table", ["external"], "SELECT * FROM external")
oracle("merge_inner", ["merged"], "SELECT * FROM merged")
oracle("preview_head", ["merged"], "SELECT * FROM merged ORDER BY PROSPECTID LIMIT 5")
oracle("model_save_load", ["test_fixed_a"], "SELECT PROSPECTID, pred, " + ", ".join(
    f"{r6(f'Prob_{t}')} AS Prob_{t}" for t in TIER_CODES) + " FROM test_fixed_a")

_KEY_CASES = [("documents_labels", "documents", "labels"), ("orders_customer", "orders", "customer"),
              ("conversations_documents", "conversations", "documents"),
              ("benchmark_documents", "benchmark", "documents"), ("lineitem_orders", "lineitem", "orders"),
              ("embeddings_labels", "embeddings", "labels")]
def _key_row(name: str, a: str, b: str, ka: str | None, kb: str | None) -> str:
    side = lambda t, k: (f"(SELECT count(*) FROM {t})", f"(SELECT count(*) FROM {t} WHERE {k} IS NULL)",
                         f"(SELECT count(DISTINCT {k}) FROM {t})")
    if ka is None:
        return (f"SELECT {q(name)} AS case_name, CAST(NULL AS VARCHAR) AS key_left, CAST(NULL AS VARCHAR) AS key_right, "
                + ", ".join(f"CAST(NULL AS BIGINT) AS {n}_{s}" for s in ("left", "right") for n in ("rows", "nulls", "distinct"))
                + ", CAST(NULL AS BIGINT) AS matched, CAST(NULL AS BOOLEAN) AS unique_left, CAST(NULL AS BOOLEAN) AS unique_right")
    values = [f"{v} AS {n}_{s}" for s, t, k in (("left", a, ka), ("right", b, kb))
              for n, v in zip(("rows", "nulls", "distinct"), side(t, k))]
    unique = lambda t, k: f"(SELECT count({k}) = count(DISTINCT {k}) FROM {t})"
    return (f"SELECT {q(name)} AS case_name, {q(ka)} AS key_left, {q(kb)} AS key_right, " + ", ".join(values)
            + f", (SELECT count(DISTINCT {ka}) FROM {a} WHERE {ka} IN (SELECT {kb} FROM {b} WHERE {kb} IS NOT NULL)) AS matched, "
              f"{unique(a, ka)} AS unique_left, {unique(b, kb)} AS unique_right")


_KEYS = {"documents_labels": "doc_id", "conversations_documents": "text", "benchmark_documents": "text"}
oracle("schema_key_detect", ["internal", "external"], " UNION ALL ".join(
    [_key_row(n, a, b, _KEYS.get(n), _KEYS.get(n)) for n, a, b in _KEY_CASES]
    + [_key_row("internal_external", "internal", "external", "PROSPECTID", "prospectid")]))

oracle("column_kinds", ["merged"], ", k AS (SELECT * FROM (VALUES "
       + ", ".join(f"({q(c)}, 'numeric')" for c in NUMS) + ", " + ", ".join(f"({q(c)}, 'categorical')" for c in CATS)
       + ") k(column_name, kind)), p AS (SELECT column_name AS cn, CAST(row_number() OVER () - 1 AS INTEGER) AS position FROM "
       "(DESCRIBE (" + with_ctes("SELECT * FROM merged", ["merged"]) + "))), v AS (" + " UNION ALL ".join(
           f"SELECT {q(c)} AS cn, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM merged" for c in NUMS + CATS)
       + ") SELECT k.column_name, k.kind, p.position, v.n_null, v.n_distinct FROM k JOIN p ON p.cn = k.column_name "
       "JOIN v ON v.cn = k.column_name")
oracle("table_shape", ["merged"], "SELECT count(*) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE ("
       + with_ctes("SELECT * FROM merged", ["merged"]) + "))) AS BIGINT) AS n_cols, "
       "count(DISTINCT Approved_Flag) AS n_classes FROM merged")
oracle("row_count_check", ["internal", "external"], """
SELECT a.rows_left, b.rows_right, a.rows_left = b.rows_right AS counts_match
FROM (SELECT count(*) AS rows_left FROM internal) a, (SELECT count(*) AS rows_right FROM external) b""")
oracle("unknown_labels", ["merged"], """
SELECT Approved_Flag AS value, count(*) AS n FROM merged
WHERE Approved_Flag IS NULL OR Approved_Flag NOT IN ('P1', 'P2', 'P3', 'P4') GROUP BY Approved_Flag""")
oracle("label_encode", ["merged"], f"SELECT PROSPECTID, Approved_Flag, {LABEL_SQL} AS label FROM merged "
       "WHERE Approved_Flag IN ('P1', 'P2', 'P3', 'P4')")
oracle("binary_approval", ["rule_preds"], "SELECT *, CAST(actual IN (0, 1) AS INTEGER) AS y_true, "
       "CAST(pred IN (0, 1) AS INTEGER) AS y_pred FROM rule_preds")
oracle("score_long_probs", ["test_fixed_a"], "\nUNION ALL\n".join(
    f"SELECT PROSPECTID, '{t}' AS tier, {rn(f'Prob_{t}', 4)} AS prob FROM test_fixed_a" for t in TIER_CODES))
oracle("merge_nullsafe", ["internal", "external"], """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE a.k IS NULL) AS n_null_key, count(DISTINCT a.k) AS n_keys
FROM (SELECT CASE WHEN PROSPECTID % 211 = 7 THEN NULL ELSE PROSPECTID END AS k FROM internal) a
JOIN (SELECT CASE WHEN prospectid % 199 = 3 THEN NULL ELSE prospectid END AS k FROM external) b
  ON a.k IS NOT DISTINCT FROM b.k""")
oracle("merge_positional", [], """
SELECT a.c_custkey, a.c_name, b.other_custkey, b.c_acctbal FROM
  (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer) a JOIN
  (SELECT c_custkey AS other_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos
   FROM customer) b ON a.pos = b.pos""")
oracle("attach_attrs", ["rule_preds", "external"], """
SELECT p.*, e.GENDER, e.EDUCATION, e.MARITALSTATUS FROM rule_preds p
LEFT JOIN external e ON e.prospectid = p.PROSPECTID WHERE p.model = 'rule_a'""")
oracle("attach_repeated", ["rule_preds", "external"], """
, p AS (SELECT model, CASE WHEN PROSPECTID % 7 <> 0 THEN PROSPECTID END AS PROSPECTID, actual, pred FROM rule_preds WHERE model = 'rule_a'),
e AS (SELECT CASE WHEN prospectid % 11 <> 0 THEN prospectid // 2 END AS k, GENDER, EDUCATION, MARITALSTATUS FROM external),
one AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY GENDER NULLS FIRST, EDUCATION NULLS FIRST, MARITALSTATUS NULLS FIRST) AS i
        FROM e WHERE k IS NOT NULL)
SELECT p.*, one.GENDER, one.EDUCATION, one.MARITALSTATUS FROM p LEFT JOIN one ON one.k = p.PROSPECTID AND one.i = 1""".replace("\n, p AS", ", p AS", 1))
oracle("merge_skewed", ["merge_hot_sides"], """
SELECT a.*, b.b FROM (SELECT k, a FROM merge_hot_sides WHERE a IS NOT NULL) a
JOIN (SELECT k, b FROM merge_hot_sides WHERE b IS NOT NULL) b ON a.k = b.k""")
oracle("merge_size", ["merge_hot_sides"], """
SELECT sum(na * nb)::BIGINT AS n_rows, max(na * nb)::BIGINT AS largest_key,
  ((SELECT count(*) FROM merge_hot_sides WHERE a IS NOT NULL AND k IS NULL)
   * (SELECT count(*) FROM merge_hot_sides WHERE b IS NOT NULL AND k IS NULL))::BIGINT AS null_pairs
FROM (SELECT k, count(a) AS na, count(b) AS nb FROM merge_hot_sides WHERE k IS NOT NULL GROUP BY k)""")
oracle("all_null_column", ["medians", "moments"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, 'numeric' AS kind, {r6(f'md_{c}')} AS median, {r6(f'mu_{c}')} AS mean, {r6(f'sd_{c}')} AS std FROM medians, moments"
    for c in NUMS) + "\nUNION ALL SELECT 'Never_Filled', 'all_null', NULL, NULL, NULL")
oracle("loan_texts", ["external"], """
SELECT prospectid, 'Rs ' || format('{:,d}', floor(NETMONTHLYINCOME * 60 / 1e5 + 0.5)::BIGINT) || 'L' AS lakh FROM external""")

# =========================================================== E / F
oracle("median_impute", ["medians"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {r6(f'md_{c}')} AS median FROM medians" for c in NUMS))
oracle("standard_scale", ["moments"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {r6(f'mu_{c}')} AS mean, {r6(f'sd_{c}')} AS std FROM moments" for c in NUMS))
oracle("mode_impute", ["modes"], "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, mo_{c} AS mode FROM modes" for c in CATS))
oracle("one_hot", ["prep_long"], f"SELECT PROSPECTID, feature, {r6('value')} AS value FROM prep_long WHERE feature NOT IN ("
       + ", ".join(q(c) for c in NUMS) + ")")
oracle("prepare_train", ["prep_long"], f"SELECT PROSPECTID, feature, {r6('value')} AS value FROM prep_long "
       "WHERE label IS NOT NULL")
oracle("prepare_unseen", ["unseen_long"], f"SELECT PROSPECTID, feature, {r6('value')} AS value FROM unseen_long")
oracle("stratified_split", ["split"], "SELECT PROSPECTID, label, split FROM split")
oracle("stratified_sample", ["known", "sample_alloc"], """
SELECT r.PROSPECTID, r.label FROM (
  SELECT k.PROSPECTID, k.label, row_number() OVER (PARTITION BY k.label ORDER BY
         md5(CAST(k.PROSPECTID AS VARCHAR) || '|sample42'), k.PROSPECTID) AS rn FROM known k) r
JOIN sample_alloc a ON a.label = r.label WHERE r.rn <= a.q""")
oracle("split_balance", ["split"], f"""
SELECT split, {tier_of('label')} AS tier, n, {r6('n * 100.0 / sum(n) OVER (PARTITION BY split)')} AS pct FROM (
  SELECT split, label, count(*) AS n FROM split GROUP BY ALL
  UNION ALL SELECT 'all', label, count(*) FROM split GROUP BY label)""")
oracle("class_distribution", ["known"], f"""
SELECT {tier_of('t.k')} AS tier, coalesce(c.n, 0) AS n,
  {rn('coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER ()', 1)} AS pct
FROM range(4) t(k) LEFT JOIN (SELECT label, count(*) AS n FROM known GROUP BY label) c ON c.label = t.k""")


# =========================================================== G
def scored_table_sql(src: str) -> str:
    desc = "CASE pc " + " ".join(f"WHEN '{t}' THEN {q(TIER_TEXT_SCORING[t])}" for t in TIER_CODES) + " END"
    conf = "CASE pred WHEN 0 THEN Prob_P1 WHEN 1 THEN Prob_P2 WHEN 2 THEN Prob_P3 ELSE Prob_P4 END"
    return (f"SELECT PROSPECTID, pc AS Predicted_Class, {desc} AS Tier_Description, "
            + ", ".join(f"{rn(f'Prob_{t}', 4)} AS Prob_{t}" for t in TIER_CODES)
            + f", {rn(conf, 4)} AS Confidence FROM (SELECT *, {tier_of('pred')} AS pc FROM {src})")


oracle("score_fixed", ["test_fixed_a"], scored_table_sql("test_fixed_a"))
oracle("score_unseen", ["unseen_fixed_a"], scored_table_sql("unseen_fixed_a"))
oracle("score_tier_counts", ["unseen_fixed_a"], f"""
SELECT {tier_of('t.k')} AS Predicted_Class, coalesce(c.n, 0) AS n FROM range(4) t(k)
LEFT JOIN (SELECT pred, count(*) AS n FROM unseen_fixed_a GROUP BY pred) c ON c.pred = t.k""")
oracle("predictions_long", ["fixed_preds"], "SELECT model, PROSPECTID, actual, pred, " + ", ".join(
    f"{r6(f'Prob_{t}')} AS Prob_{t}" for t in TIER_CODES) + " FROM fixed_preds")

# =========================================================== H
oracle("confusion", ["rule_cm"], "SELECT * FROM rule_cm")
oracle("confusion_pct", ["rule_cm"], f"SELECT *, {r6('n * 100.0 / nullif(sum(n) OVER (PARTITION BY model, actual), 0)')}"
       " AS row_pct FROM rule_cm")
oracle("class_report", ["rule_rep2"], f"SELECT model, class, {tier_of('class')} AS tier, {r6('precision')} AS precision, "
       f"{r6('recall')} AS recall, {r6('f1')} AS f1, support FROM rule_rep2")
oracle("macro_weighted_avg", ["rule_rep2"], f"""
SELECT model, 'macro avg' AS average, {r6('avg(precision)')} AS precision, {r6('avg(recall)')} AS recall,
  {r6('avg(f1)')} AS f1, CAST(sum(support) AS BIGINT) AS support FROM rule_rep2 GROUP BY model
UNION ALL
SELECT model, 'weighted avg', {r6('sum(precision * support) / sum(support)')}, {r6('sum(recall * support) / sum(support)')},
  {r6('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM rule_rep2 GROUP BY model""")
oracle("accuracy", ["rule_acc"], f"SELECT model, n, correct, {r6('accuracy')} AS accuracy FROM rule_acc")
oracle("roc_points", ["roc"], f"SELECT model, CAST(class AS INTEGER) AS class, {r6('score')} AS threshold, tp, fp, "
       f"{r6('CAST(fp AS DOUBLE) / nullif(N, 0)')} AS fpr, {r6('CAST(tp AS DOUBLE) / nullif(P, 0)')} AS tpr FROM roc")
oracle("auc_by_class", ["auc"], f"SELECT model, class, {r6('auc')} AS auc FROM auc")
oracle("auc_macro", ["auc"], f"SELECT model, {r6('avg(auc)')} AS auc_ovr FROM auc GROUP BY model")
oracle("model_compare", ["fx_summary"], f"SELECT model, {rn('f1_macro', 4)} AS f1_macro, "
       f"{rn('f1_weighted', 4)} AS f1_weighted, {rn('auc_ovr', 4)} AS auc_ovr FROM fx_summary")
oracle("model_recommend", ["fx_summary"], """
SELECT 'fixed_a' AS baseline, 'fixed_b' AS challenger,
  CASE WHEN c_f1 > b_f1 AND c_auc > b_auc THEN 'fixed_b' WHEN b_f1 >= c_f1 THEN 'fixed_a' ELSE 'none' END AS recommended
FROM (SELECT max(f1_macro) FILTER (WHERE model = 'fixed_a') AS b_f1, max(auc_ovr) FILTER (WHERE model = 'fixed_a') AS b_auc,
             max(f1_macro) FILTER (WHERE model = 'fixed_b') AS c_f1, max(auc_ovr) FILTER (WHERE model = 'fixed_b') AS c_auc
      FROM fx_summary)""")

# =========================================================== I
oracle("phi_linear", ["fa_phi"], f"SELECT PROSPECTID, feature, class, {r6('value')} AS value, {r6('phi')} AS phi FROM fa_phi")

_SHAPE_ROWS = ", ".join(f"({q(f)}, {b}, {dbl(lo) if lo is not None else 'NULL'}, {dbl(hi) if hi is not None else 'NULL'}, "
                        f"{k}, {dbl(v)})" for f, b, lo, hi, sc in FIXED_SHAPES for k, v in enumerate(sc))
_SHAPE_FEATS = sorted({r[0] for r in FIXED_SHAPES})
oracle("phi_additive", ["fx_known"], ", shapes AS (SELECT * FROM (VALUES " + _SHAPE_ROWS
       + ") t(feature, bin, lo, hi, class, score)), lng AS (" + " UNION ALL ".join(
           f"SELECT PROSPECTID, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM fx_known" for f in _SHAPE_FEATS)
       + f") SELECT l.PROSPECTID, l.feature, CAST(s.class AS INTEGER) AS class, {r6('l.value')} AS value, "
       f"{r6('s.score')} AS phi FROM lng l JOIN shapes s ON s.feature = l.feature "
       "AND (s.lo IS NULL OR l.value >= s.lo) AND (s.hi IS NULL OR l.value < s.hi)")
oracle("global_importance", ["fa_global"], f"SELECT feature, {r6('importance')} AS importance, CAST(rank AS INTEGER) AS rank FROM fa_global")
oracle("summary_points", ["fa_phi", "fa_feat"], f"""
SELECT p.PROSPECTID, p.feature, p.class, {r6('p.value')} AS value, {r6('p.phi')} AS phi FROM fa_phi p
JOIN (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY avg(mean_abs) DESC, feature) AS rk
      FROM fa_feat GROUP BY feature) WHERE rk <= 5) t ON t.feature = p.feature""")


def _base_sql(m: str) -> str:
    parts = []
    for k in range(4):
        e = dbl(FIXED_INTERCEPTS[m][k])
        for f in model_feats(m):
            e = f"{e} + {dbl(FIXED_COEFS[m][f][k])} * bg_{f}"
        parts.append(e)
    return "SELECT " + ", ".join(f"{p} AS b{k}" for k, p in enumerate(parts)) + " FROM bg"


oracle("waterfall", ["fa_phi", "all_fixed_a", "bg"], f"""
, base AS ({_base_sql('fixed_a')}),
pp AS (SELECT p.PROSPECTID, s.pred AS class, p.feature, p.phi,
         row_number() OVER (PARTITION BY p.PROSPECTID ORDER BY abs(p.phi) DESC, p.feature) AS rk
       FROM fa_phi p JOIN all_fixed_a s ON s.PROSPECTID = p.PROSPECTID AND p.class = s.pred),
steps AS (SELECT PROSPECTID, class, rk AS step, feature, phi FROM pp WHERE rk <= 9
          UNION ALL SELECT PROSPECTID, any_value(class), 10, CAST(count(*) AS VARCHAR) || ' other features', sum(phi)
          FROM pp WHERE rk > 9 GROUP BY PROSPECTID)
SELECT s.PROSPECTID, CAST(s.class AS INTEGER) AS class, CAST(s.step AS INTEGER) AS step, s.feature, {r6('s.phi')} AS phi,
  {r6('CASE s.class WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 WHEN 2 THEN b.b2 ELSE b.b3 END')} AS base_value,
  {r6('CASE s.class WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 WHEN 2 THEN b.b2 ELSE b.b3 END + sum(s.phi) OVER (PARTITION BY s.PROSPECTID ORDER BY s.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cum_after
FROM steps s, base b""")
oracle("local_topn", ["fa_topn"], f"""
SELECT PROSPECTID, pred, CAST(rank AS INTEGER) AS rank, feature, {r6('value')} AS value, {r6('mean_abs')} AS mean_abs,
  {r6('mean_phi')} AS mean_phi, {r6('phi_pred')} AS phi_pred FROM fa_topn""")
oracle("compare_rows", ["fa_topn", "pairs"], f"""
SELECT PROSPECTID, pred, CAST(rank AS INTEGER) AS rank, feature, {r6('value')} AS value, {r6('mean_abs')} AS mean_abs,
  {r6('mean_phi')} AS mean_phi, {r6('phi_pred')} AS phi_pred FROM fa_topn
WHERE PROSPECTID IN (SELECT idx_a FROM pairs UNION SELECT idx_b FROM pairs)""")
oracle("phi_delta", ["fa_delta"], f"SELECT idx_a, idx_b, class, CAST(rank AS INTEGER) AS rank, feature, {r6('va')} AS va, "
       f"{r6('vb')} AS vb, {r6('delta')} AS delta FROM fa_delta")


def _quartile_sql() -> str:
    parts = []
    for f in model_feats("fixed_a"):
        tbl = "(SELECT * FROM fx_split WHERE split = 'train')"
        qs = [spark_pct(tbl, f, f"(n - 1) * {p}") for p in (0.25, 0.5, 0.75)]
        parts.append(f"SELECT '{f}' AS feature, CAST(({f} > q1) AS INTEGER) + CAST(({f} > q2) AS INTEGER) + "
                     f"CAST(({f} > q3) AS INTEGER) AS bin, CAST({f} AS DOUBLE) AS x FROM "
                     f"(SELECT * FROM fx_split WHERE split = 'train'), (SELECT {qs[0]} AS q1, {qs[1]} AS q2, {qs[2]} AS q3)")
    return " UNION ALL ".join(parts)


oracle("quartile_bins", ["fx_split"], f"""
SELECT feature, bin, count(*) AS n, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std, {r6('min(x)')} AS min,
  {r6('max(x)')} AS max FROM ({_quartile_sql()}) GROUP BY feature, bin""")


def _pdp_sql() -> str:
    feat = "Credit_Score"
    others = [f for f in model_feats("fixed_a") if f != feat]
    lo = spark_pct("fx_known", feat, "least(greatest((n * 0.05 + 0.4 + 0.2 * 0.05 - 1) / (n - 1), 0.0), 1.0) * (n - 1)")
    hi = spark_pct("fx_known", feat, "least(greatest((n * 0.95 + 0.4 + 0.2 * 0.95 - 1) / (n - 1), 0.0), 1.0) * (n - 1)")
    grid = f"""grid AS (
  SELECT CAST(gi AS INTEGER) AS gi, gv FROM (
    SELECT row_number() OVER (ORDER BY v) - 1 AS gi, v AS gv FROM (SELECT DISTINCT CAST({feat} AS DOUBLE) AS v FROM fx_known)
    WHERE (SELECT count(DISTINCT {feat}) FROM fx_known) < 100
    UNION ALL
    SELECT i AS gi, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS gv
    FROM range(100) r(i), (SELECT {lo} AS lo, {hi} AS hi)
    WHERE (SELECT count(DISTINCT {feat}) FROM fx_known) >= 100))"""
    src = f"(SELECT g.gi, g.gv, g.gv AS {feat}, " + ", ".join(f"k.{o}" for o in others) + " FROM fx_known k, grid g)"
    inner = probs_sql(scored_sql("fixed_a", src, "gi, gv"), "gi, gv")
    return (f", {grid}, sc AS ({inner}) SELECT gi, {r6('gv')} AS gv, class, {r6('avg(p)')} AS avg_prob FROM ("
            + " UNION ALL ".join(f"SELECT gi, gv, {k} AS class, Prob_{t} AS p FROM sc" for k, t in enumerate(TIER_CODES))
            + ") GROUP BY gi, gv, class")


oracle("pdp", ["fx_known"], _pdp_sql())

# =========================================================== J
oracle("selection_rate", ["rf_rates"], f"SELECT model, attr, grp, n, {r6('selection_rate')} AS selection_rate FROM rf_rates")
oracle("dpd", ["rf_diff"], f"SELECT model, attr, {r6('dpd')} AS dpd FROM rf_diff")
oracle("tpr_fpr", ["rf_rates"], f"SELECT model, attr, grp, {rn('tpr', 4)} AS tpr, {rn('fpr', 4)} AS fpr FROM rf_rates")
oracle("eod", ["rf_diff"], f"SELECT model, attr, {r6('tpr_gap')} AS tpr_gap, {r6('fpr_gap')} AS fpr_gap, {r6('eod')} AS eod FROM rf_diff")
oracle("class_rate_by_group", ["rf_rates"], "SELECT model, attr, grp, " + ", ".join(
    f"{r6(f'share_{t}')} AS share_{t}" for t in TIER_CODES) + " FROM rf_rates")
oracle("group_extremes", ["rf_ext"], f"SELECT model, attr, highest_group, {r6('highest_rate')} AS highest_rate, "
       f"lowest_group, {r6('lowest_rate')} AS lowest_rate FROM rf_ext")
oracle("rate_vs_mean", ["rf_rates"], f"""
SELECT model, attr, grp, {r6('selection_rate')} AS selection_rate, {r6('avg(selection_rate) OVER w')} AS mean_group_rate,
  {r6('sum(selection_rate * n) OVER w / sum(n) OVER w')} AS weighted_rate,
  selection_rate >= avg(selection_rate) OVER w AS at_or_above_mean
FROM rf_rates WINDOW w AS (PARTITION BY model, attr)""")
oracle("fairness_overview", ["rf_diff"], f"""
SELECT model, attr, {rn('dpd', 4)} AS dpd, {traffic('dpd')} AS dpd_status, {rn('eod', 4)} AS eod,
  {traffic('eod')} AS eod_status, dpd >= 0.1 OR eod >= 0.1 AS action_needed FROM rf_diff""")
oracle("fairness_adhoc", ["rfx_rates"], f"SELECT model, attr, grp, n, {r6('selection_rate')} AS selection_rate, "
       f"{r6('tpr')} AS tpr, {r6('fpr')} AS fpr FROM rfx_rates")

# =========================================================== K
oracle("decision_counts", ["rule_money"], f"SELECT model, n_test, approved, marginal, rejected, {r6('approval_rate')} "
       "AS approval_rate FROM rule_money")
oracle("tier_correct", ["rule_money"], f"SELECT model, tp_p1, tp_p2, tp_p3, tp_p4, total_correct, {r6('accuracy')} "
       "AS accuracy FROM rule_money")
oracle("exposure_avoided", ["rule_money"], f"SELECT model, {r6('npa_p4')} AS npa_p4, {r6('npa_p3')} AS npa_p3, "
       f"{r6('npa_total')} AS npa_total, {r6('npa_total / 1e7')} AS npa_total_cr FROM rule_money")
oracle("exposure_residual", ["rule_money"], f"SELECT model, fn_p4, {r6('npa_exposure')} AS npa_exposure, "
       f"{r6('npa_exposure / 1e7')} AS npa_exposure_cr FROM rule_money")
oracle("whatif_grid", ["rule_dc"], f"""
SELECT model, {r6('l')} AS avg_loan, {r6('r4')} AS p4_rate, {r6('r3')} AS p3_rate,
  {r6('tp_p4 * l * r4 + tp_p3 * l * r3')} AS npa_total, {r6('fn_p4 * l * r4')} AS npa_exposure
FROM rule_dc, (SELECT CAST(x AS DOUBLE) / 1.0 AS l FROM range(50000, 1000001, 50000) t(x)),
     (SELECT CAST(x AS DOUBLE) / 100.0 AS r4 FROM range(10, 71, 5) t(x)),
     (SELECT CAST(x AS DOUBLE) / 100.0 AS r3 FROM range(5, 41, 5) t(x))""")
oracle("model_vote", ["fx_metrics"], """
SELECT 'fixed_a' AS baseline, 'fixed_b' AS challenger, CAST(w AS INTEGER) AS challenger_wins,
  CASE WHEN w >= 4 THEN 'fixed_b' ELSE 'comparable' END AS recommendation FROM (
  SELECT CAST(max(accuracy) FILTER (WHERE model = 'fixed_b') > max(accuracy) FILTER (WHERE model = 'fixed_a') AS INTEGER)
       + CAST(max(npa_total) FILTER (WHERE model = 'fixed_b') >= max(npa_total) FILTER (WHERE model = 'fixed_a') AS INTEGER)
       + CAST(max(npa_exposure) FILTER (WHERE model = 'fixed_b') <= max(npa_exposure) FILTER (WHERE model = 'fixed_a') AS INTEGER)
       + CAST(max(f1_macro) FILTER (WHERE model = 'fixed_b') > max(f1_macro) FILTER (WHERE model = 'fixed_a') AS INTEGER)
       + CAST(max(auc_ovr) FILTER (WHERE model = 'fixed_b') > max(auc_ovr) FILTER (WHERE model = 'fixed_a') AS INTEGER) AS w
  FROM fx_metrics)""")
oracle("tier_table", ["rule_preds"], """
SELECT m.model, d.tier, d.description, d.action, coalesce(c.n, 0) AS n,
  """ + r6("coalesce(CAST(c.n AS DOUBLE) / m.n_test, 0.0)") + """ AS share
FROM (SELECT model, count(*) AS n_test FROM rule_preds GROUP BY model) m
CROSS JOIN (VALUES """ + ", ".join(f"({k}, '{t}', {q(TIER_TEXT_BUSINESS[t])}, {q(TIER_ACTION_BUSINESS[t])})"
                                   for k, t in enumerate(TIER_CODES)) + """) d(k, tier, description, action)
LEFT JOIN (SELECT model, pred, count(*) AS n FROM rule_preds GROUP BY ALL) c ON c.model = m.model AND c.pred = d.k""")
def _cmp_row(pos: int, name: str, b: str, c: str, better: str) -> str:
    return (f"SELECT {pos} AS pos, {q(name)} AS metric, {b} AS baseline_value, {c} AS challenger_value, "
            f"CASE WHEN {better} THEN 'fixed_b' ELSE 'fixed_a' END AS better FROM s")


# =========================================================== L
oracle("intent_route", ["routed"], "SELECT qid, intent FROM routed")
oracle("intent_args", ["routed"], "SELECT qid, intent, idx, idx_a, idx_b, attr FROM routed WHERE intent <> 'unknown'")

oracle("answer_static", ["routed"], f"SELECT qid, intent, CASE WHEN intent = 'help' THEN {q(HELP_TEXT)} ELSE {q(UNKNOWN_TEXT)} END "
       "AS answer FROM routed WHERE intent IN ('help', 'unknown')")

oracle("additive_importance", ["fx_known"], ", shapes AS (SELECT * FROM (VALUES " + _SHAPE_ROWS
       + ") t(feature, bin, lo, hi, class, score)), lng AS (" + " UNION ALL ".join(
           f"SELECT PROSPECTID, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM fx_known" for f in _SHAPE_FEATS)
       + "), per AS (SELECT l.PROSPECTID, l.feature, "
       "(((abs(max(s.score) FILTER (WHERE s.class = 0)) + abs(max(s.score) FILTER (WHERE s.class = 1)))"
       " + abs(max(s.score) FILTER (WHERE s.class = 2))) + abs(max(s.score) FILTER (WHERE s.class = 3))) / 4.0 AS ma"
       " FROM lng l JOIN shapes s ON s.feature = l.feature AND (s.lo IS NULL OR l.value >= s.lo)"
       " AND (s.hi IS NULL OR l.value < s.hi) GROUP BY l.PROSPECTID, l.feature)"
       f" SELECT feature, {r6('avg(ma)')} AS importance FROM per GROUP BY feature")

_DESC_SC = "CASE pc " + " ".join(f"WHEN '{t}' THEN {q(TIER_TEXT_SCORING[t])}" for t in TIER_CODES) + " END"
oracle("applicant_report", ["test_fixed_a", "fa_feat", "fx_split"], f"""
, sc AS (SELECT *, {tier_of('pred')} AS pc,
           CASE pred WHEN 0 THEN Prob_P1 WHEN 1 THEN Prob_P2 WHEN 2 THEN Prob_P3 ELSE Prob_P4 END AS conf FROM test_fixed_a)
SELECT PROSPECTID, 'header' AS section, 1 AS pos, 'tier' AS label, pc AS value, {_DESC_SC} AS note FROM sc
UNION ALL SELECT PROSPECTID, 'header', 2, 'confidence', {pct1('conf')}, '' FROM sc
""" + "".join(f"UNION ALL SELECT PROSPECTID, 'probability', {k + 1}, '{t}', {pct1(f'Prob_{t}')}, {q(TIER_TEXT_SCORING[t])} FROM sc\n"
              for k, t in enumerate(TIER_CODES)) + f"""
UNION ALL SELECT PROSPECTID, 'factor', CAST(rank AS INTEGER), feature, {fixed('phi_pred', 4, True)},
  CASE WHEN phi_pred > 0 THEN 'Positive' ELSE 'Negative' END FROM (
    SELECT *, row_number() OVER (PARTITION BY PROSPECTID ORDER BY abs(phi_pred) DESC, feature) AS rank FROM fa_feat)
  WHERE rank <= 10 AND PROSPECTID IN (SELECT PROSPECTID FROM fx_split WHERE split = 'test')""")

_CONTRACTS = {"internal": ["PROSPECTID", "Total_TL", "Age_Oldest_TL"],
              "external": ["PROSPECTID", "Approved_Flag", "GENDER", "EDUCATION", "MARITALSTATUS", "Credit_Score"],
              "unseen": ["PROSPECTID", "EDUCATION", "Auto_TL", "CC_utilization", "GENDER", "Credit_Score"]}
_UNSEEN_COLS = "SELECT * EXCLUDE (Approved_Flag, EDUCATION, Auto_TL, CC_utilization), 'x' AS note FROM merged"
_ABSENT = {"unseen": ["EDUCATION", "Auto_TL", "CC_utilization"]}
oracle("contract_check", ["merged", "internal", "external"], f", unseen AS ({_UNSEEN_COLS}) " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {q(c)} AS required, {'false' if c in _ABSENT.get(t, []) else 'true'} AS present, "
    + ("CAST(NULL AS BIGINT)" if c in _ABSENT.get(t, []) else f"(SELECT count(*) - count({c}) FROM {t})") + " AS n_null"
    for t, req in _CONTRACTS.items() for c in req))
_FEATURES = ("(SELECT unnest([" + ", ".join(q(c) for c in NUMS) + "]) AS feature UNION ALL SELECT col || '_' || cat FROM cats)")
oracle("logistic_optimum", ["cats"], f"SELECT class, feature, true AS at_optimum FROM {_FEATURES}, "
       "(SELECT unnest([0, 1, 2, 3]) AS class)")
oracle("shape_centred", ["cats"], f"SELECT feature, class, true AS centred FROM {_FEATURES}, (SELECT unnest([0, 1, 2, 3]) AS class)")
oracle("prepare_float32", ["prep_long"], f"SELECT PROSPECTID, feature, {r6('CAST(CAST(value AS FLOAT) AS DOUBLE)')} AS value "
       "FROM prep_long WHERE label IS NOT NULL")


# =========================================================== text outputs from the fixed formats
_VERDICT = (f"CASE WHEN d.dpd < 0.05 THEN {q(DPD_VERDICTS[0])} WHEN d.dpd < 0.1 THEN {q(DPD_VERDICTS[1])} "
            f"ELSE {q(DPD_VERDICTS[2])} END")
_ACTIONS = " || chr(10) || ".join(fill_sql(a, attr="x.attr") for a in NARRATIVE_ACTIONS)
oracle("fairness_narrative", ["rf_ext", "rf_diff"], f"""
SELECT x.model, x.attr, {fill_sql(NARRATIVE, attr="x.attr", high="x.highest_group", high_rate=pct1("x.highest_rate"),
                                  low="x.lowest_group", low_rate=pct1("x.lowest_rate"), dpd=pct1("d.dpd"),
                                  verdict=_VERDICT, eod=fixed("d.eod", 4))}
  || CASE WHEN d.dpd >= 0.1 THEN {q(NARRATIVE_ACTIONS_HEAD)} || {_ACTIONS} ELSE '' END AS narrative
FROM rf_ext x JOIN rf_diff d ON d.model = x.model AND d.attr = x.attr""")

_HEAD_VALUES = [thousands("n_test"),
                f"{thousands('total_correct')} || ' (' || {pct1('accuracy')} || ')'",
                f"{thousands('approved')} || ' (' || {pct1('approval_rate')} || ')'",
                f"{thousands('marginal')} || ' (' || {pct1('CAST(marginal AS DOUBLE) / n_test')} || ')'",
                f"{thousands('rejected')} || ' (' || {pct1('CAST(rejected AS DOUBLE) / n_test')} || ')'",
                crore("npa_total"), crore("npa_exposure")]
_HEAD_MEANINGS = {5: fill_sql(HEADLINE_AVOIDED_MEANING, p4=pct1("p4_rate", 0), p3=pct1("p3_rate", 0)),
                  6: fill_sql(HEADLINE_RESIDUAL_MEANING, n="CAST(fn_p4 AS VARCHAR)")}
oracle("headline", ["rule_money"], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT model, {i + 1} AS pos, {q(metric)} AS metric, {_HEAD_VALUES[i]} AS value, "
    f"{q(meaning) if meaning is not None else _HEAD_MEANINGS[i]} AS meaning FROM rule_money"
    for i, (metric, meaning) in enumerate(HEADLINE_ROWS)) + ") WHERE model = 'rule_b'")

_M = COMPARISON_METRICS
_CMP = [("f1_macro", lambda x: fixed(x, 3), ">"), ("f1_weighted", lambda x: fixed(x, 3), ">"),
        ("auc_ovr", lambda x: fixed(x, 3), ">"), ("accuracy", pct1, ">"), ("total_correct", thousands, ">"),
        ("approved", lambda x: f"{thousands(x)} || ' (' || {pct1(x.replace('approved', 'approval_rate'))} || ')'", ">"),
        ("npa_total", crore, ">"), ("npa_exposure", crore, "<"), ("fn_p4", lambda x: f"CAST({x} AS VARCHAR)", "<")]
oracle("comparison_report", ["fx_metrics"], ", s AS (SELECT " + ", ".join(
    f"max({x}) FILTER (WHERE model = 'fixed_a') AS b_{x}, max({x}) FILTER (WHERE model = 'fixed_b') AS c_{x}"
    for x in [c for c, _, _ in _CMP] + ["approval_rate"]) + " FROM fx_metrics) "
    + " UNION ALL ".join(_cmp_row(i + 1, _M[i], f("b_" + c), f("c_" + c), f"c_{c} {op} b_{c}")
                         for i, (c, f, op) in enumerate(_CMP)))

_TD = "CASE p.pred_tier " + " ".join(f"WHEN '{t}' THEN {q(TIER_TEXT_ANALYST[t])}" for t in TIER_CODES) + " ELSE '' END"
_TOP5 = """, top5 AS (SELECT * FROM (SELECT PROSPECTID, feature, phi_pred,
             row_number() OVER (PARTITION BY PROSPECTID ORDER BY abs(phi_pred) DESC, feature) AS rank FROM fa_feat) WHERE rank <= 5)"""
oracle("answer_explain", ["routed", "fa_feat", "fa_info"], _TOP5 + f""",
per AS (SELECT t.PROSPECTID, i.pred_tier, i.confidence,
          string_agg({fill_sql(REASON_LINE, feature="t.feature", value=fixed("t.phi_pred", 4, True),
                               direction="CASE WHEN t.phi_pred > 0 THEN 'positive' ELSE 'negative' END")},
                     chr(10) ORDER BY t.rank) FILTER (WHERE t.rank <= 3) AS reasons,
          max(t.feature) FILTER (WHERE t.rank = 1) AS rec
        FROM top5 t JOIN fa_info i ON i.PROSPECTID = t.PROSPECTID GROUP BY t.PROSPECTID, i.pred_tier, i.confidence)
SELECT r.qid, 'explain_applicant' AS intent,
  CASE WHEN p.PROSPECTID IS NULL
       THEN {fill_sql(EXPLAIN_OUT_OF_RANGE, idx="CAST(r.idx AS VARCHAR)", n="CAST((SELECT count(*) FROM fa_info) AS VARCHAR)")}
       ELSE {fill_sql(ANSWER_EXPLAIN, idx="CAST(r.idx AS VARCHAR)", tier="p.pred_tier", desc=_TD,
                      confidence=pct1("p.confidence"), reasons="p.reasons",
                      rec=f"coalesce(p.rec, {q(DEFAULT_RECOMMENDATION)})")} END AS answer
FROM routed r LEFT JOIN per p ON p.PROSPECTID = r.idx WHERE r.intent = 'explain_applicant'""")

_HEAD = "You are a credit analyst AI"
oracle("prompt_text", ["routed", "fa_feat", "fa_info", "fa_delta", "fa_global", "af_rates", "af_diff", "fx_summary", "fx_split"],
       _TOP5 + f""",
per AS (SELECT t.PROSPECTID, i.pred_tier, i.confidence,
          string_agg('  ' || t.rank || '. ' || t.feature || ': ' || {fixed("t.phi_pred", 4, True)} || ' ('
                     || CASE WHEN t.phi_pred > 0 THEN 'increases' ELSE 'decreases' END || ' approval chance)',
                     chr(10) ORDER BY t.rank) AS lines
        FROM top5 t JOIN fa_info i ON i.PROSPECTID = t.PROSPECTID GROUP BY t.PROSPECTID, i.pred_tier, i.confidence),
dl AS (SELECT idx_a, idx_b, string_agg('  ' || feature || ': applicant ' || idx_a || '=' || {fixed("va", 4, True)} || ', applicant '
          || idx_b || '=' || {fixed("vb", 4, True)} || ' (delta=' || {fixed("vb - va", 4, True)} || ')', chr(10) ORDER BY rank) AS lines
        FROM fa_delta GROUP BY idx_a, idx_b),
fl AS (SELECT r.attr, string_agg('  ' || r.grp || ': ' || {pct1("r.selection_rate")}, chr(10) ORDER BY -r.selection_rate, r.grp) AS lines,
          any_value(d.dpd) AS dpd, any_value(d.eod) AS eod FROM af_rates r JOIN af_diff d ON d.attr = r.attr GROUP BY r.attr)
SELECT r.qid, '{_HEAD} for an Indian bank. Explain the following credit decision' || chr(10)
  || 'in plain English. Be concise (3-4 sentences). End with one actionable recommendation.' || chr(10) || chr(10)
  || 'Applicant index: ' || r.idx || chr(10) || 'Predicted credit tier: ' || p.pred_tier || ' — ' || {_TD} || chr(10)
  || 'Confidence: ' || {pct1("p.confidence")} || chr(10) || chr(10)
  || 'Top SHAP feature contributions (positive = supports approval):' || chr(10) || p.lines || chr(10) || chr(10)
  || 'Format your response as:' || chr(10) || 'DECISION: [one sentence]' || chr(10) || 'REASONS: [2-3 bullet points]' || chr(10)
  || 'RECOMMENDATION: [one actionable sentence]' AS prompt
FROM routed r JOIN per p ON p.PROSPECTID = r.idx WHERE r.intent = 'explain_applicant'
UNION ALL
SELECT r.qid, '{_HEAD}. Compare two loan applicants concisely (4-5 sentences).' || chr(10) || chr(10)
  || 'Applicant ' || r.idx_a || ': tier ' || a.pred_tier || ' (' || {pct1("a.confidence")} || ' confidence)' || chr(10)
  || 'Applicant ' || r.idx_b || ': tier ' || b.pred_tier || ' (' || {pct1("b.confidence")} || ' confidence)' || chr(10) || chr(10)
  || 'Largest SHAP differences:' || chr(10) || d.lines || chr(10) || chr(10) || 'Explain why applicant ' || r.idx_b || ' received a '
  || CASE WHEN b.pred_tier < a.pred_tier THEN 'better' ELSE 'worse' END || ' tier.'
FROM routed r JOIN dl d ON d.idx_a = r.idx_a AND d.idx_b = r.idx_b JOIN fa_info a ON a.PROSPECTID = r.idx_a
  JOIN fa_info b ON b.PROSPECTID = r.idx_b WHERE r.intent = 'compare_applicants'
UNION ALL
SELECT qid, '{_HEAD}. Explain what drives credit approval decisions' || chr(10)
  || 'in 3-4 plain English sentences for a non-technical audience.' || chr(10) || chr(10)
  || 'Top 10 features by mean absolute SHAP value:' || chr(10) || (SELECT string_agg('  ' || rank || '. ' || feature
       || ' (mean |SHAP| = ' || {fixed("importance", 4)} || ')', chr(10) ORDER BY rank) FROM fa_global)
FROM routed WHERE intent = 'global_importance'
UNION ALL
SELECT r.qid, '{_HEAD} explaining fairness metrics to a compliance officer.' || chr(10) || 'Be concise (3-4 sentences).' || chr(10)
  || chr(10) || 'Attribute: ' || r.attr || chr(10) || 'Demographic Parity Difference: ' || {fixed("f.dpd", 4)} || chr(10)
  || 'Equalized Odds Difference: ' || {fixed("f.eod", 4)} || chr(10) || 'Approval rates: ' || f.lines || chr(10)
  || 'Thresholds: <0.05 acceptable, 0.05-0.10 monitor, >0.10 action required.'
FROM routed r JOIN fl f ON f.attr = r.attr WHERE r.intent = 'fairness'
UNION ALL
SELECT qid, '{_HEAD} explaining model performance to a bank manager.' || chr(10) || 'Write 3-4 plain English sentences.' || chr(10)
  || chr(10) || 'Test applicants: ' || {thousands("(SELECT count(*) FROM fx_split WHERE split = 'test')")} || chr(10)
  || (SELECT string_agg(model || ': Macro F1=' || {fixed("f1_macro", 3)} || ', AUC=' || {fixed("auc_ovr", 3)}, chr(10) ORDER BY model)
      FROM fx_summary)
FROM routed WHERE intent = 'model_performance'""")

oracle("answer_compare", ["routed", "fa_delta", "fa_info"], f"""
, d AS (SELECT idx_a, idx_b, string_agg({fill_sql(COMPARE_LINE, feature="feature", a="CAST(idx_a AS VARCHAR)",
                                                  va=fixed("va", 4, True), b="CAST(idx_b AS VARCHAR)",
                                                  vb=fixed("vb", 4, True))},
                                        chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS lines
        FROM fa_delta GROUP BY idx_a, idx_b)
SELECT r.qid, 'compare_applicants' AS intent,
  CASE WHEN ia.pred_tier IS NULL OR ib.pred_tier IS NULL
       THEN {fill_sql(COMPARE_OUT_OF_RANGE, n="CAST((SELECT count(*) FROM fa_info) AS VARCHAR)",
                      last="CAST((SELECT count(*) - 1 FROM fa_info) AS VARCHAR)")}
       ELSE {fill_sql(ANSWER_COMPARE, a="CAST(r.idx_a AS VARCHAR)", tier_a="ia.pred_tier", conf_a=pct1("ia.confidence"),
                      b="CAST(r.idx_b AS VARCHAR)", tier_b="ib.pred_tier", conf_b=pct1("ib.confidence"),
                      lines="coalesce(d.lines, '')")} END AS answer
FROM routed r LEFT JOIN fa_info ia ON ia.PROSPECTID = r.idx_a LEFT JOIN fa_info ib ON ib.PROSPECTID = r.idx_b
LEFT JOIN d ON d.idx_a = r.idx_a AND d.idx_b = r.idx_b WHERE r.intent = 'compare_applicants'""")

oracle("answer_global", ["routed", "fa_global"], f"""
SELECT qid, 'global_importance' AS intent, (SELECT {fill_sql(ANSWER_GLOBAL, lines="string_agg(" + fill_sql(
    GLOBAL_LINE, rank="CAST(rank AS VARCHAR)", feature="feature", value=fixed("importance", 4)) + ", chr(10) ORDER BY rank)")}
  FROM fa_global) AS answer
FROM routed WHERE intent = 'global_importance'""")

_AVAILABLE = "[" + ", ".join(f"'{a}'" for a in SENSITIVE_ATTRS) + "]"
oracle("answer_fairness", ["routed", "af_rates", "af_diff"], f"""
, texts AS (SELECT r.attr, {fill_sql(ANSWER_FAIRNESS, attr="r.attr",
    lines="string_agg(" + fill_sql(FAIRNESS_LINE, group="r.grp", rate=pct1("r.selection_rate"))
          + ", chr(10) ORDER BY -r.selection_rate, r.grp)",
    dpd=fixed("any_value(d.dpd)", 4), dpd_status=traffic("any_value(d.dpd)"),
    eod=fixed("any_value(d.eod)", 4), eod_status=traffic("any_value(d.eod)"))} AS answer
  FROM af_rates r JOIN af_diff d ON d.attr = r.attr GROUP BY r.attr)
SELECT q.qid, 'fairness' AS intent, coalesce(t.answer, {fill_sql(ATTR_NOT_FOUND, attr="q.attr", available=q(_AVAILABLE))})
  AS answer
FROM routed q LEFT JOIN texts t ON t.attr = q.attr WHERE q.intent = 'fairness'""")

oracle("answer_performance", ["routed", "fx_summary", "fx_split"], f"""
SELECT qid, 'model_performance' AS intent, (SELECT {fill_sql(ANSWER_PERFORMANCE,
    n=thousands("(SELECT count(*) FROM fx_split WHERE split = 'test')"),
    rows="string_agg(" + fill_sql(PERFORMANCE_ROW, model="model", f1=fixed("f1_macro", 3), auc=fixed("auc_ovr", 3))
         + ", chr(10) ORDER BY model)")}
  FROM fx_summary) AS answer FROM routed WHERE intent = 'model_performance'""")

# queries that must give back another query's rows
for _name, _same in {"scored_sink": "score_fixed", "stream_score": "score_unseen", "load_csv": "internal_table", "load_xlsx": "internal_table",
                     "load_inputs": "merge_inner", "additive_save_load": "phi_additive"}.items():
    ORACLES[_name] = ORACLES[_same]

ORACLES["phi_store"] = " UNION ALL ".join(
    f"SELECT '{m}' AS model, 'labelled' AS dataset, * FROM ({ORACLES[o]})"
    for m, o in (("fixed_a", "phi_linear"), ("fixed_shape", "phi_additive")))

# =========================================================== sparse features, fit state, versions, bins
cte("cat_pos", ["cats"], f"SELECT col, cat, {len(NUMS)} - 1 + row_number() OVER (ORDER BY CASE col "
    + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(CATS)) + " END, cat) AS pos FROM cats")
cte("feature_pos", ["cat_pos"], "SELECT col || '_' || cat AS feature, pos FROM cat_pos UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({q(c)}, {i})" for i, c in enumerate(NUMS)) + ") t(feature, pos)")
oracle("sparse_one_hot", ["prep_long", "feature_pos"], f"""
SELECT l.PROSPECTID, CAST(f.pos AS BIGINT) AS pos, {r6('l.value')} AS value
FROM prep_long l JOIN feature_pos f ON f.feature = l.feature WHERE {r6('l.value')} <> 0""")
_WIDE = ["l_partkey", "l_suppkey", "l_returnflag"]
ORACLES["sparse_wide"] = f"""
WITH v AS (""" + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS c, CAST({c} AS VARCHAR) AS value FROM lineitem WHERE {c} IS NOT NULL" for i, c in enumerate(_WIDE)) + """),
p AS (SELECT c, value, row_number() OVER (ORDER BY c, value) AS pos FROM v),
m AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS c, (SELECT CAST({c} AS VARCHAR) FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS mode" for i, c in enumerate(_WIDE)) + f"""),
x AS (SELECT l_orderkey, l_linenumber, coalesce(CAST(l_quantity AS DOUBLE),
  {spark_pct('lineitem', 'l_quantity', _pos_median())}) AS x FROM lineitem),
s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM x),
r AS (SELECT l_orderkey, l_linenumber, CAST(0 AS BIGINT) AS pos, {r6('(x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS value FROM x, s
""" + " ".join(f"""UNION ALL SELECT l.l_orderkey, l.l_linenumber, p.pos, CAST(1.0 AS DOUBLE) FROM lineitem l JOIN m ON m.c = {i}
JOIN p ON p.c = {i} AND p.value = coalesce(CAST(l.{c} AS VARCHAR), m.mode)""" for i, c in enumerate(_WIDE)) + """)
SELECT * FROM r WHERE value <> 0"""
oracle("sparse_score", ["unseen_fixed_a"], "SELECT PROSPECTID, pred, " + ", ".join(
    f"{r6(f'Prob_{t}')} AS Prob_{t}" for t in TIER_CODES) + " FROM unseen_fixed_a")
_ONE_HOT = {f: c for f in model_feats("fixed_a") for c in CATS if f.startswith(c + "_")}
oracle("sparse_phi", ["fa_phi", "fx_known"], f"""
SELECT PROSPECTID, feature, class, {r6('value')} AS value, {r6('phi')} AS phi FROM fa_phi
WHERE feature NOT IN ({", ".join(q(f) for f in _ONE_HOT)}) OR value = 1.0
UNION ALL
SELECT k.PROSPECTID, c.col || '_(others)', CAST(t.class AS INTEGER), 0.0, {r6('coalesce(p.phi, 0.0)')}
FROM fx_known k, (VALUES {", ".join(f"({q(c)})" for c in CATS)}) c(col), range(4) t(class)
LEFT JOIN (SELECT PROSPECTID, class, CASE feature {" ".join(f"WHEN {q(f)} THEN {q(c)}" for f, c in _ONE_HOT.items())} END AS col, phi
  FROM fa_phi WHERE value = 0.0 AND feature IN ({", ".join(q(f) for f in _ONE_HOT)})) p
  ON p.PROSPECTID = k.PROSPECTID AND p.class = t.class AND p.col = c.col""")
oracle("fit_state", ["merged"], " UNION ALL ".join(
    [f"SELECT 'numeric' AS kind, '{c}' AS item, count({c}) AS n, count(*) - count({c}) AS missing, {r6(f'avg(CAST({c} AS DOUBLE))')} AS mean, "
     f"{r6(f'stddev_pop(CAST({c} AS DOUBLE))')} AS std, true AS median_ok FROM merged" for c in NUMS]
    + [f"SELECT '{k}', '{c}=' || {c}, count(*), NULL, NULL, NULL, NULL FROM merged WHERE {c} IS NOT NULL GROUP BY {c}"
       for k, c in [("category", c) for c in CATS] + [("target", "Approved_Flag")]]))
ORACLES["model_versions"] = ORACLES["model_save_load"]
ORACLES["phi_rows_kept"] = ORACLES["phi_linear"]


def _binned_sql() -> None:
    attrs = ["NETMONTHLYINCOME", "Credit_Score", "AGE"]
    rows = []
    for a in attrs:
        ends = ", ".join(spark_pct("external", a, f"(n - 1) * {dbl(i / 5)}") for i in range(6))
        cte(f"ends_{a}", ["external"], f"SELECT list_sort(list_distinct([{ends}])) AS e")
        rows.append(f"""SELECT p.*, '{a}' AS attr, CAST(least(len(list_filter(b.e, lambda v: v <= CAST(x.{a} AS DOUBLE))), len(b.e) - 1) AS BIGINT) AS g, b.e
FROM rule_preds p JOIN external x ON x.prospectid = p.PROSPECTID, ends_{a} b WHERE x.{a} IS NOT NULL""")
    cte("bin_long", ["rule_preds", "external"] + [f"ends_{a}" for a in attrs],
        "SELECT model, actual, pred, attr, CAST(g AS VARCHAR) AS grp, e[g] AS lo, e[g + 1] AS hi FROM (" + " UNION ALL ".join(rows)
        + ") UNION ALL SELECT p.model, p.actual, p.pred, 'EDUCATION', x.EDUCATION, NULL, NULL FROM rule_preds p "
          "JOIN external x ON x.prospectid = p.PROSPECTID WHERE x.EDUCATION IS NOT NULL")
    yes = "CAST(pred IN (0, 1) AS INTEGER)"
    oracle("fairness_binned", ["bin_long"], f"""
SELECT model, attr, grp, {r6('lo')} AS lo, {r6('hi')} AS hi, count(*) AS n, {r6(f'avg({yes})')} AS selection_rate,
  {r6(f'avg(CASE WHEN actual IN (0, 1) THEN {yes} END)')} AS tpr, {r6(f'avg(CASE WHEN actual NOT IN (0, 1) THEN {yes} END)')} AS fpr
FROM bin_long GROUP BY model, attr, grp, lo, hi""")


_binned_sql()


def _contract_sql() -> str:
    unseen = ("SELECT * EXCLUDE (" + ", ".join([*UNSEEN_ABSENT, "Approved_Flag", "GENDER"]) + "), "
              "CASE WHEN PROSPECTID % 30 = 3 THEN 'X' ELSE GENDER END AS GENDER, 'x' AS note FROM merged")
    parts = []
    for name, query, need, contract in (("internal", "SELECT * FROM internal", "internal", INTERNAL_CONTRACT),
                                        ("external", "SELECT * FROM external", "external", EXTERNAL_CONTRACT),
                                        ("unseen", unseen, "merged", INTERNAL_CONTRACT + EXTERNAL_CONTRACT[1:-1])):
        rows = with_ctes(query, [need])
        due = ", ".join(f"({q(c)}, {q(k)})" for c, k in contract)
        parts.append(f"""SELECT {q(name)} AS table_name, coalesce(d.c, t.c) AS column_name, d.k AS expected, t.found, CASE WHEN t.c IS NULL THEN 'missing'
  WHEN d.c IS NULL THEN 'extra' WHEN d.k = 'int' AND s.bad > 0 OR d.k = 'number' AND s.text > 0 THEN 'values' WHEN (d.k = 'text') <> (t.found = 'string') THEN 'type' END AS problem,
  CASE WHEN t.c IS NOT NULL THEN s.n - s.filled END AS n_null, CASE WHEN t.c IS NOT NULL AND d.k IN ('int', 'number') THEN
  CASE WHEN d.k = 'int' THEN s.bad ELSE s.text END WHEN t.c IS NOT NULL THEN 0 END AS n_bad
FROM (VALUES {due}) d(c, k) FULL JOIN (SELECT column_name AS c, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE column_type END AS found FROM (DESCRIBE {rows})) t ON lower(t.c) = lower(d.c)
LEFT JOIN (SELECT c, count(*) AS n, count(v) AS filled, count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS text,
  count(*) FILTER (WHERE v IS NOT NULL AND (try_cast(v AS DOUBLE) IS NULL OR try_cast(v AS DOUBLE) <> floor(try_cast(v AS DOUBLE)))) AS bad
  FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({rows})) UNPIVOT INCLUDE NULLS (v FOR c IN (*)) GROUP BY c) s ON s.c = t.c""")
    return " UNION ALL ".join(parts)


ORACLES["contract_types"] = _contract_sql()
