"""Per-applicant report records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TIER_CODES, TIER_TEXT_SCORING
from ..functions.text import fmt_fixed, fmt_pct
from . import explain, models


def applicant_report(rows: DataFrame, model, key: str, top: int = 10) -> DataFrame:
    """A report per applicant as (key, section, pos, label, value, note): tier
    and confidence, all tier probabilities, and the features that weigh most in
    the predicted tier."""
    s = models.score(rows, model, [key])
    tier = models.tier_of(F.col("pred"))
    desc = F.create_map(*[x for t, v in TIER_TEXT_SCORING.items() for x in (F.lit(t), F.lit(v))])
    head = s.select(key, F.inline(F.array(
        F.struct(F.lit("header").alias("section"), F.lit(1).alias("pos"), F.lit("tier").alias("label"),
                 tier.alias("value"), desc[tier].alias("note")),
        F.struct(F.lit("header").alias("section"), F.lit(2).alias("pos"), F.lit("confidence").alias("label"),
                 fmt_pct("confidence").alias("value"), F.lit("").alias("note")))))
    probs = s.select(key, F.inline(F.array(*[
        F.struct(F.lit("probability").alias("section"), F.lit(k + 1).alias("pos"), F.lit(t).alias("label"),
                 fmt_pct(f"Prob_{t}").alias("value"), F.lit(TIER_TEXT_SCORING[t]).alias("note"))
        for k, t in enumerate(TIER_CODES)])))
    best = explain.local_topn(rows, model, key, top, by="phi_pred")
    factors = best.select(key, F.lit("factor").alias("section"), F.col("rank").alias("pos"),
                          F.col("feature").alias("label"), fmt_fixed("phi_pred", 4, signed=True).alias("value"),
                          F.when(F.col("phi_pred") > 0, "Positive").otherwise("Negative").alias("note"))
    return head.unionByName(probs).unionByName(factors)
