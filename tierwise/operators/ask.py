"""Question routing over a table of questions.

Intent = first of seven ordered patterns that matches the lower-cased,
stripped text; arguments come from the same pattern's groups.  Answers are
joins of the routed questions to precomputed explanation / fairness /
metric tables, worded with ``format_string``; the prompt text for an
external model is produced the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ANSWER_COMPARE, ANSWER_EXPLAIN, ANSWER_FAIRNESS, ANSWER_GLOBAL, ANSWER_PERFORMANCE,
                         ATTR_NOT_FOUND, COMPARE_LINE, COMPARE_OUT_OF_RANGE, DEFAULT_FAIRNESS_ATTR,
                         DEFAULT_RECOMMENDATION, EXPLAIN_OUT_OF_RANGE, FAIRNESS_LINE, GLOBAL_LINE, GLOBAL_PROMPT_LINE,
                         HELP_TEXT, INTENT_PATTERNS, KEY_COL, PERFORMANCE_ROW, PROMPT_COMPARE, PROMPT_COMPARE_LINE,
                         PROMPT_EXPLAIN, PROMPT_FAIRNESS, PROMPT_GLOBAL, PROMPT_LINE, PROMPT_MODEL_LINE,
                         PROMPT_PERFORMANCE, PROMPT_RATE_LINE, REASON_LINE, SENSITIVE_ATTRS, UNKNOWN_TEXT)
from ..functions.numeric import traffic_light
from ..functions.text import fill, fmt_fixed, fmt_pct, fmt_thousands, py_strip

# Java's \w is ASCII-only; spell out the Unicode word class so that non-ASCII
# words ("état") are captured as the reference's Python patterns capture them.
_WORD = r"[\p{L}\p{N}_]"


def java_pattern(p: str) -> str:
    return p.replace(r"\w", _WORD)


PATTERNS = [(java_pattern(p), intent) for p, intent in INTENT_PATTERNS]


def route(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """L1 + L2: (…, q, intent, pattern_no, idx, idx_a, idx_b, attr)."""
    q = F.lower(py_strip(F.col(text_col)))
    df = questions.withColumn("q", q)
    intent = F.lit("unknown")
    pno = F.lit(0)
    for i, (p, name) in reversed(list(enumerate(PATTERNS, start=1))):
        hit = F.col("q").rlike(p)
        intent = F.when(hit, F.lit(name)).otherwise(intent)
        pno = F.when(hit, F.lit(i)).otherwise(pno)
    df = df.withColumn("intent", intent).withColumn("pattern_no", pno)

    def grp(i: int, g: int) -> Column:
        return F.regexp_extract(F.col("q"), PATTERNS[i - 1][0], g)

    idx = F.when(F.col("pattern_no") == 1, grp(1, 1).try_cast("long"))
    ia = F.when(F.col("pattern_no") == 2, grp(2, 1).try_cast("long"))
    ib = F.when(F.col("pattern_no") == 2, grp(2, 2).try_cast("long"))
    attr = F.when(F.col("pattern_no") == 5,
                  F.upper(F.coalesce(F.nullif(grp(5, 1), F.lit("")), F.lit(DEFAULT_FAIRNESS_ATTR))))
    return df.withColumn("idx", idx).withColumn("idx_a", ia).withColumn("idx_b", ib).withColumn("attr", attr)


def _top_lines(arr: Column, n: int, fmt) -> Column:
    return F.array_join(F.transform(F.slice(arr, 1, n), fmt), "\n")


def _tier_map(tier_text: dict) -> Column:
    return F.create_map(*[x for t, d in tier_text.items() for x in (F.lit(t), F.lit(d))])


def answer_explain(routed: DataFrame, topn: DataFrame, n_rows: Column, tier_text: dict, key: str = KEY_COL) -> DataFrame:
    """L4: template answer for 'explain applicant N'.

    ``topn``: (key, rank, feature, phi_pred, pred_tier, confidence) top-5 rows;
    ``n_rows``: a scalar-subquery column with the number of applicants.
    """
    per = (topn.groupBy(key).agg(
        F.first("pred_tier").alias("pred_tier"), F.first("confidence").alias("confidence"),
        F.sort_array(F.collect_list(F.struct("rank", "feature", "phi_pred"))).alias("top")))
    q = routed.filter(F.col("intent") == "explain_applicant").select("qid", "idx")
    j = q.join(per, q.idx.cast("string") == per[key].cast("string"), "left").withColumn("n_rows", n_rows)
    reasons = _top_lines(F.col("top"), 3, lambda x: fill(
        REASON_LINE, feature=x["feature"], value=fmt_fixed(x["phi_pred"], 4, signed=True),
        direction=F.when(x["phi_pred"] > 0, F.lit("positive")).otherwise(F.lit("negative"))))
    text = fill(ANSWER_EXPLAIN, idx=F.col("idx").cast("string"), tier=F.col("pred_tier"),
                desc=F.coalesce(_tier_map(tier_text)[F.col("pred_tier")], F.lit("")),
                confidence=fmt_pct("confidence"), reasons=reasons,
                rec=F.coalesce(F.element_at("top", 1)["feature"], F.lit(DEFAULT_RECOMMENDATION)))
    missing = fill(EXPLAIN_OUT_OF_RANGE, idx=F.col("idx").cast("string"), n=F.col("n_rows").cast("string"))
    return j.select("qid", F.lit("explain_applicant").alias("intent"),
                    F.when(F.col(key).isNull(), missing).otherwise(text).alias("answer"))


def answer_compare(routed: DataFrame, delta: DataFrame, info: DataFrame, n_rows: Column, key: str = KEY_COL) -> DataFrame:
    """L5: 'compare applicants A and B' with the top-3 differences.

    ``delta``: (idx_a, idx_b, rank, feature, va, vb); ``info``: (key, pred_tier, confidence)."""
    d = delta.groupBy("idx_a", "idx_b").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "va", "vb")))
                                            .alias("top"))
    q = routed.filter(F.col("intent") == "compare_applicants").select("qid", "idx_a", "idx_b")
    ia = info.select(F.col(key).cast("string").alias("key_a"), F.col("pred_tier").alias("pa"), F.col("confidence").alias("ca"))
    ib = info.select(F.col(key).cast("string").alias("key_b"), F.col("pred_tier").alias("pb"), F.col("confidence").alias("cb"))
    j = (q.join(ia, q.idx_a.cast("string") == ia.key_a, "left").join(ib, q.idx_b.cast("string") == ib.key_b, "left")
          .join(d, ["idx_a", "idx_b"], "left")
          .withColumn("n_rows", n_rows))
    a, b = F.col("idx_a").cast("string"), F.col("idx_b").cast("string")
    lines = _top_lines(F.col("top"), 3, lambda x: fill(
        COMPARE_LINE, feature=x["feature"], a=a, va=fmt_fixed(x["va"], 4, signed=True), b=b,
        vb=fmt_fixed(x["vb"], 4, signed=True)))
    text = fill(ANSWER_COMPARE, a=a, tier_a=F.col("pa"), conf_a=fmt_pct("ca"), b=b, tier_b=F.col("pb"),
                conf_b=fmt_pct("cb"), lines=F.coalesce(lines, F.lit("")))
    missing = fill(COMPARE_OUT_OF_RANGE, n=F.col("n_rows").cast("string"), last=(F.col("n_rows") - 1).cast("string"))
    return j.select("qid", F.lit("compare_applicants").alias("intent"),
                    F.when(F.col("pa").isNull() | F.col("pb").isNull(), missing).otherwise(text).alias("answer"))


def global_text(top: DataFrame) -> DataFrame:
    """L6 text from the (feature, importance, rank) top-10 table (bounded)."""
    arr = F.sort_array(F.collect_list(F.struct("rank", "feature", "importance")))
    lines = F.array_join(F.transform(arr, lambda x: fill(
        GLOBAL_LINE, rank=x["rank"].cast("string"), feature=x["feature"], value=fmt_fixed(x["importance"], 4))), "\n")
    return top.agg(fill(ANSWER_GLOBAL, lines=lines).alias("answer"))


def answer_global(routed: DataFrame, top: DataFrame) -> DataFrame:
    q = routed.filter(F.col("intent") == "global_importance").select("qid")
    return q.select("qid", F.lit("global_importance").alias("intent"), global_text(top).scalar().alias("answer"))


def fairness_text(rates: DataFrame, diff: DataFrame) -> DataFrame:
    """L7 text per attribute from group rates (attr, grp, selection_rate) and
    differences (attr, dpd, eod)."""
    r = rates.groupBy("attr").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("selection_rate")).alias("neg"), F.col("grp"), F.col("selection_rate")))).alias("rs"))
    lines = F.array_join(F.transform("rs", lambda x: fill(FAIRNESS_LINE, group=x["grp"],
                                                          rate=fmt_pct(x["selection_rate"]))), "\n")
    j = r.join(diff.select("attr", "dpd", "eod"), "attr")
    text = fill(ANSWER_FAIRNESS, attr=F.col("attr"), lines=lines, dpd=fmt_fixed("dpd", 4),
                dpd_status=traffic_light("dpd"), eod=fmt_fixed("eod", 4), eod_status=traffic_light("eod"))
    return j.select("attr", text.alias("answer"))


def answer_fairness(routed: DataFrame, texts: DataFrame, available: list[str]) -> DataFrame:
    """L3 fairness branch: attribute found -> its text; else the not-found line."""
    q = routed.filter(F.col("intent") == "fairness").select("qid", "attr")
    avail = [a for a in SENSITIVE_ATTRS if a in available]
    listing = "[" + ", ".join(f"'{a}'" for a in avail) + "]"
    j = q.join(texts, "attr", "left")
    nf = fill(ATTR_NOT_FOUND, attr=F.col("attr"), available=listing)
    return j.select("qid", F.lit("fairness").alias("intent"), F.coalesce(F.col("answer"), nf).alias("answer"))


def performance_text(summary: DataFrame, n_test: Column) -> DataFrame:
    """Markdown table of macro F1 and AUC per model (3 dp)."""
    rows = F.sort_array(F.collect_list(F.struct("model", "f1_macro", "auc_ovr")))
    body = F.array_join(F.transform(rows, lambda x: fill(
        PERFORMANCE_ROW, model=x["model"], f1=fmt_fixed(x["f1_macro"], 3), auc=fmt_fixed(x["auc_ovr"], 3))), "\n")
    t = summary.agg(body.alias("body")).withColumn("n_test", n_test)
    return t.select(fill(ANSWER_PERFORMANCE, n=fmt_thousands("n_test"), rows=F.col("body")).alias("answer"))


def answer_performance(routed: DataFrame, text: DataFrame) -> DataFrame:
    q = routed.filter(F.col("intent") == "model_performance").select("qid")
    return q.select("qid", F.lit("model_performance").alias("intent"), text.scalar().alias("answer"))


def answer_static(routed: DataFrame) -> DataFrame:
    """Help and unknown."""
    q = routed.filter(F.col("intent").isin("help", "unknown"))
    return q.select("qid", "intent", F.when(F.col("intent") == "help", F.lit(HELP_TEXT))
                    .otherwise(F.lit(UNKNOWN_TEXT)).alias("answer"))


def prompt_explain(topn_arr: Column, idx: Column, pred_tier: Column, confidence: Column, tier_text: dict) -> Column:
    """The prompt for an external model, built from computed values."""
    lines = F.array_join(F.transform(topn_arr, lambda x, i: fill(
        PROMPT_LINE, rank=(i + 1).cast("string"), feature=x["feature"],
        value=fmt_fixed(x["phi_pred"], 4, signed=True),
        direction=F.when(x["phi_pred"] > 0, F.lit("increases")).otherwise(F.lit("decreases")))), "\n")
    return fill(PROMPT_EXPLAIN, idx=idx.cast("string"), tier=pred_tier,
                desc=F.coalesce(_tier_map(tier_text)[pred_tier], F.lit("")), confidence=fmt_pct(confidence),
                lines=lines)


def prompt_compare(top: Column, a: Column, tier_a: Column, conf_a: Column, b: Column, tier_b: Column,
                   conf_b: Column) -> Column:
    """The prompt that compares two applicants; ``top``: array of (feature, va, vb)."""
    lines = F.array_join(F.transform(top, lambda x: fill(
        PROMPT_COMPARE_LINE, feature=x["feature"], a=a.cast("string"), va=fmt_fixed(x["va"], 4, signed=True),
        b=b.cast("string"), vb=fmt_fixed(x["vb"], 4, signed=True), delta=fmt_fixed(x["vb"] - x["va"], 4, signed=True))), "\n")
    return fill(PROMPT_COMPARE, a=a.cast("string"), tier_a=tier_a, conf_a=fmt_pct(conf_a), b=b.cast("string"),
                tier_b=tier_b, conf_b=fmt_pct(conf_b), lines=lines,
                verdict=F.when(tier_b < tier_a, F.lit("better")).otherwise(F.lit("worse")))


def prompt_global(top: DataFrame) -> DataFrame:
    """The prompt on global importance from the (feature, importance, rank) top-10 table (bounded)."""
    arr = F.sort_array(F.collect_list(F.struct("rank", "feature", "importance")))
    lines = F.array_join(F.transform(arr, lambda x: fill(
        GLOBAL_PROMPT_LINE, rank=x["rank"].cast("string"), feature=x["feature"], value=fmt_fixed(x["importance"], 4))), "\n")
    return top.agg(fill(PROMPT_GLOBAL, lines=lines).alias("prompt"))


def prompt_fairness(rates: DataFrame, diff: DataFrame) -> DataFrame:
    """The fairness prompt per attribute."""
    r = rates.groupBy("attr").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("selection_rate")).alias("neg"), F.col("grp"), F.col("selection_rate")))).alias("rs"))
    lines = F.array_join(F.transform("rs", lambda x: fill(PROMPT_RATE_LINE, group=x["grp"],
                                                          rate=fmt_pct(x["selection_rate"]))), "\n")
    return r.join(diff.select("attr", "dpd", "eod"), "attr").select("attr", fill(
        PROMPT_FAIRNESS, attr=F.col("attr"), dpd=fmt_fixed("dpd", 4), eod=fmt_fixed("eod", 4), lines=lines).alias("prompt"))


def prompt_performance(summary: DataFrame, n_test: Column) -> DataFrame:
    """The performance prompt, a line per model."""
    rows = F.sort_array(F.collect_list(F.struct("model", "f1_macro", "auc_ovr")))
    body = F.array_join(F.transform(rows, lambda x: fill(
        PROMPT_MODEL_LINE, model=x["model"], f1=fmt_fixed(x["f1_macro"], 3), auc=fmt_fixed(x["auc_ovr"], 3))), "\n")
    t = summary.agg(body.alias("body")).withColumn("n_test", n_test)
    return t.select(fill(PROMPT_PERFORMANCE, n=fmt_thousands("n_test"), lines=F.col("body")).alias("prompt"))


def prompts(routed: DataFrame, top: DataFrame, delta: DataFrame, info: DataFrame, gtop: DataFrame, rates: DataFrame,
            diff: DataFrame, summary: DataFrame, n_test: Column, tier_text: dict, key: str = KEY_COL) -> DataFrame:
    """(qid, prompt) for every explain, compare, global, fairness and
    performance question whose applicants or attribute are known."""
    per = top.groupBy(key).agg(F.first("pred_tier").alias("pred_tier"), F.first("confidence").alias("confidence"),
                               F.sort_array(F.collect_list(F.struct("rank", "feature", "phi_pred"))).alias("top"))
    q = routed.filter(F.col("intent") == "explain_applicant").select("qid", "idx")
    explained = q.join(per, F.col("idx").cast("string") == per[key].cast("string")).select("qid", prompt_explain(
        F.col("top"), F.col("idx"), F.col("pred_tier"), F.col("confidence"), tier_text).alias("prompt"))
    d = delta.groupBy("idx_a", "idx_b").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "va", "vb"))).alias("top"))
    both = routed.filter(F.col("intent") == "compare_applicants").select("qid", "idx_a", "idx_b").join(d, ["idx_a", "idx_b"])
    for x in ("a", "b"):
        side = info.select(F.col(key).cast("string").alias(f"key_{x}"), F.col("pred_tier").alias(f"tier_{x}"),
                           F.col("confidence").alias(f"conf_{x}"))
        both = both.join(side, F.col(f"idx_{x}").cast("string") == F.col(f"key_{x}"))
    compared = both.select("qid", prompt_compare(F.col("top"), *[F.col(c) for c in (
        "idx_a", "tier_a", "conf_a", "idx_b", "tier_b", "conf_b")]).alias("prompt"))
    overall = routed.filter(F.col("intent") == "global_importance").select("qid", prompt_global(gtop).scalar().alias("prompt"))
    fair = routed.filter(F.col("intent") == "fairness").select("qid", "attr").join(
        prompt_fairness(rates, diff), "attr").select("qid", "prompt")
    perf = routed.filter(F.col("intent") == "model_performance").select(
        "qid", prompt_performance(summary, n_test).scalar().alias("prompt"))
    return explained.unionByName(compared).unionByName(overall).unionByName(fair).unionByName(perf)
