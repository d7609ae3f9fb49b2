"""Group fairness over test predictions.

All attributes and all models are audited in one pass: attributes are
unpivoted to (attr, grp) rows, then one grouped aggregate yields every
per-group rate; differences are a second aggregate over that small table.
Null groups are dropped, like pandas group-bys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (APPROVED_CLASSES, DPD_VERDICTS, NARRATIVE, NARRATIVE_ACTIONS, NARRATIVE_ACTIONS_HEAD,
                         THRESHOLD_AMBER, THRESHOLD_GREEN, TIER_CODES)
from ..functions.numeric import round_half_up, traffic_light
from ..functions.text import fill, fmt_fixed, fmt_pct
from .merge import attach_attributes
from .quantiles import exact_quantiles
from .schema import NUMERIC_TYPES


def binarize(pred: DataFrame) -> DataFrame:
    """Class in {0,1} -> 1 else 0, for truth and prediction."""
    return (pred.withColumn("y_true", F.col("actual").isin(*APPROVED_CLASSES).cast("int"))
                .withColumn("y_pred", F.col("pred").isin(*APPROVED_CLASSES).cast("int")))


def long_groups(pred_attrs: DataFrame, attrs: list[str]) -> DataFrame:
    """Unpivot attribute columns into (attr, grp); null groups removed."""
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("grp"))
                                  for a in attrs])).alias("g")
    keep = [c for c in ("model", "actual", "pred", "y_true", "y_pred") if c in pred_attrs.columns]
    return (pred_attrs.select(*keep, stacked).select(*keep, "g.attr", "g.grp")
            .filter(F.col("grp").isNotNull()))


def group_rates(long: DataFrame) -> DataFrame:
    """J1 + J3 + J5 + J6: selection rate, TPR, FPR, per-class shares and size
    per (model, attr, grp) in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("selection_rate"),
            F.avg(F.when(F.col("y_true") == 1, F.col("y_pred"))).alias("tpr"),
            F.avg(F.when(F.col("y_true") == 0, F.col("y_pred"))).alias("fpr")]
    aggs += [F.avg((F.col("pred") == k).cast("int")).alias(f"share_{t}") for k, t in enumerate(TIER_CODES)]
    return long.groupBy("model", "attr", "grp").agg(*aggs)


def differences(rates: DataFrame) -> DataFrame:
    """J2 + J4: DPD = max - min rate; EOD = max(TPR range, FPR range), a range
    being 0 with fewer than two groups having that rate."""
    g = rates.groupBy("model", "attr").agg(
        (F.max("selection_rate") - F.min("selection_rate")).alias("dpd"),
        F.when(F.count("tpr") > 1, F.max("tpr") - F.min("tpr")).otherwise(F.lit(0.0)).alias("tpr_gap"),
        F.when(F.count("fpr") > 1, F.max("fpr") - F.min("fpr")).otherwise(F.lit(0.0)).alias("fpr_gap"),
        F.avg("selection_rate").alias("mean_group_rate"),
        F.count(F.lit(1)).alias("n_groups"))
    return g.withColumn("eod", F.greatest("tpr_gap", "fpr_gap"))


def audit(pred: DataFrame, external: DataFrame, key_pred: str, key_ext: str, attrs: list[str]) -> DataFrame:
    """D4 + binarize + unpivot: the long (model, attr, grp, y_true, y_pred) table."""
    present = [a for a in attrs if a in external.columns]
    return long_groups(attach_attributes(binarize(pred), external, key_pred, key_ext, present), present)


def binned(external: DataFrame, attrs: list[str], bins: int = 10, above: int = 50) -> tuple[DataFrame, DataFrame]:
    """J12 for continuous attributes: a numeric one with more than ``above`` different values (as
    ``approx_count_distinct`` tells) is replaced by the number of its quantile bin, the others stay as they are.
    Also gives the bins as rows (attr, grp, lo, hi): a bin holds lo <= value < hi, the last one hi too.  Equal
    quantiles make fewer bins; null and NaN have no bin.  So an audit has a bounded number of groups."""
    types = {f.name: f.dataType for f in external.schema.fields}
    numeric = [a for a in attrs if a in types and isinstance(types[a], NUMERIC_TYPES)]
    clean = {a: F.when(~F.isnan(F.col(a).cast("double")), F.col(a).cast("double")) for a in numeric}
    seen = external.agg(*[F.approx_count_distinct(a).alias(a) for a in numeric]).collect()[0].asDict() if numeric else {}
    wide = [a for a in numeric if seen[a] > above]
    at = exact_quantiles(external.select(*[clean[a].alias(a) for a in wide]), wide, [i / bins for i in range(bins + 1)])
    labels, rows = {}, []
    for a in wide:
        ends = sorted(set(at[a]))
        ends = ends if len(ends) > 1 else ends * 2
        width = len(str(len(ends) - 1))
        names = [str(i + 1).zfill(width) for i in range(len(ends) - 1)]
        rows += [(a, n, float(lo), float(hi)) for n, lo, hi in zip(names, ends, ends[1:])]
        label = F.lit(names[0])
        for n, lo in zip(names[1:], ends[1:-1]):
            label = F.when(clean[a] >= F.lit(float(lo)), F.lit(n)).otherwise(label)
        labels[a] = F.when(clean[a].isNotNull(), label)
    table = external.sparkSession.createDataFrame(rows, "attr string, grp string, lo double, hi double")
    return external.select(*[labels[c].alias(c) if c in labels else F.col(c) for c in external.columns]), table


def overview(diff: DataFrame) -> DataFrame:
    """J9 + J10: DPD/EOD with statuses (on unrounded values), 4 dp, action flag."""
    return diff.select(
        "model", "attr",
        round_half_up("dpd", 4).alias("dpd"), traffic_light("dpd").alias("dpd_status"),
        round_half_up("eod", 4).alias("eod"), traffic_light("eod").alias("eod_status"),
        ((F.col("dpd") >= THRESHOLD_AMBER) | (F.col("eod") >= THRESHOLD_AMBER)).alias("action_needed"))


def rate_vs_mean(rates: DataFrame) -> DataFrame:
    """Unweighted mean of group rates (labelled 'overall' by the
    reference), the row-weighted rate, and an at/above-mean flag."""
    w = Window.partitionBy("model", "attr")
    return (rates.withColumn("mean_group_rate", F.avg("selection_rate").over(w))
                 .withColumn("weighted_rate", F.sum(F.col("selection_rate") * F.col("n")).over(w)
                             / F.sum("n").over(w))
                 .withColumn("at_or_above_mean", F.col("selection_rate") >= F.col("mean_group_rate")))


def extremes(rates: DataFrame) -> DataFrame:
    """Highest and lowest group; ties go to the first group in sort order."""
    hi = Window.partitionBy("model", "attr").orderBy(F.desc("selection_rate"), F.asc("grp"))
    lo = Window.partitionBy("model", "attr").orderBy(F.asc("selection_rate"), F.asc("grp"))
    r = rates.withColumn("_h", F.row_number().over(hi)).withColumn("_l", F.row_number().over(lo))
    return r.groupBy("model", "attr").agg(
        F.max(F.when(F.col("_h") == 1, F.col("grp"))).alias("highest_group"),
        F.max(F.when(F.col("_h") == 1, F.col("selection_rate"))).alias("highest_rate"),
        F.max(F.when(F.col("_l") == 1, F.col("grp"))).alias("lowest_group"),
        F.max(F.when(F.col("_l") == 1, F.col("selection_rate"))).alias("lowest_rate"))


def narrative(ext: DataFrame, diff: DataFrame) -> DataFrame:
    """Summary text per (model, attr), with action lines at or above 0.10."""
    j = ext.join(diff, ["model", "attr"])
    verdict = (F.when(F.col("dpd") < THRESHOLD_GREEN, F.lit(DPD_VERDICTS[0]))
                .when(F.col("dpd") < THRESHOLD_AMBER, F.lit(DPD_VERDICTS[1]))
                .otherwise(F.lit(DPD_VERDICTS[2])))
    body = fill(NARRATIVE, attr=F.col("attr"), high=F.col("highest_group"), high_rate=fmt_pct("highest_rate"),
                low=F.col("lowest_group"), low_rate=fmt_pct("lowest_rate"), dpd=fmt_pct("dpd"), verdict=verdict,
                eod=fmt_fixed("eod", 4))
    actions = F.concat(F.lit(NARRATIVE_ACTIONS_HEAD),
                       F.concat_ws("\n", *[fill(a, attr=F.col("attr")) for a in NARRATIVE_ACTIONS]))
    text = F.when(F.col("dpd") >= THRESHOLD_AMBER, F.concat(body, actions)).otherwise(body)
    return j.select("model", "attr", text.alias("narrative"))
