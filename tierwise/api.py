"""User-facing API over your own tables: the reference's whole flow
(upload -> merge -> preprocess -> sample/split -> train -> evaluate ->
score new data -> explain -> fairness -> business terms -> questions).

Every function takes and returns DataFrames (plus small fitted parameter
objects); nothing is collected except bounded parameter tables.

    from tierwise import api
    res = api.train(spark, internal_df, external_df)
    res.metrics.show(); api.audit(res, external_df)["overview"].show()
    scored = api.score(res, unseen_df, model="additive")
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import (DEFAULT_AVG_LOAN, DEFAULT_P3_RATE, DEFAULT_P4_RATE, SENSITIVE_ATTRS,
                        TARGET_COL, TIER_TEXT_ANALYST)
from .operators import ask as ask_ops
from .operators import boosting, evaluate, explain, fairness, impact, lime, merge, models, prepare, report, schema, split
from .plans.workbench import materialize


@dataclass
class TrainResult:
    key: str
    params: prepare.PrepParams
    split_df: DataFrame                      # key, features, label, split
    models: dict = field(default_factory=dict)
    predictions: DataFrame | None = None     # long: model, key, actual, pred, Prob_*, confidence
    metrics: DataFrame | None = None         # per model: F1s, AUC, accuracy, money at defaults

    @property
    def train(self) -> DataFrame:
        return self.split_df.filter(F.col("split") == "train").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.split_df.filter(F.col("split") == "test").drop("split")


def merge_inputs(internal: DataFrame, external: DataFrame, key: tuple[str, str] | None = None) -> DataFrame:
    """B1 + D1 + D2: detect the shared key (or use ``key``) and merge."""
    return merge.merge(internal, external, key)


def train(spark: SparkSession, internal: DataFrame, external: DataFrame, key: str | None = None,
          sample_pct: int = 100, test_pct: int = 20, seed: int = 42, fit_on: str = "all",
          model_names: tuple[str, ...] = ("logistic", "additive")) -> TrainResult:
    """Merge, prepare, stratified sample + split, fit both models, evaluate.
    ``key`` is the shared key's name in ``internal``; by default it is detected."""
    pair = schema.find_common_key(internal.columns, external.columns) if key is None else \
        (key, schema.find_common_key([key], external.columns)[1])
    if not pair[0] or not pair[1]:
        raise ValueError("the two inputs share no key column; merge them with merge.merge_positional first")
    key = pair[0]
    merged = materialize(spark, merge_inputs(internal, external, pair), "merged")
    schema.require_target(merged)
    fit_rows = merged                         # reference: statistics fitted on all rows (QUIRK 10)
    if fit_on == "train":                     # option: fit on the rows of the train split only
        from .sources.fixtures import label_expr
        lab = merged.select(key, label_expr(TARGET_COL).alias("label")).filter(F.col("label").isNotNull())
        if sample_pct < 100:
            lab = split.stratified_sample(lab, key, "label", sample_pct, seed)
        keys = split.stratified_split(lab, key, "label", test_pct, seed).filter(F.col("split") == "train")
        fit_rows = merged.join(keys.select(key), key, "left_semi")
    params = prepare.fit(fit_rows, key, TARGET_COL)
    labelled = prepare.known_labels(prepare.transform(merged, params, key, TARGET_COL))
    if sample_pct < 100:
        labelled = split.stratified_sample(labelled, key, "label", sample_pct, seed)
    split_df = materialize(spark, split.stratified_split(labelled, key, "label", test_pct, seed), "split")
    res = TrainResult(key, params, split_df)
    feats = params.feature_names
    if "logistic" in model_names:
        res.models["logistic"] = models.fit_logistic(res.train, feats, "label", name="logistic")
    if "additive" in model_names:
        res.models["additive"] = boosting.fit_boosted(res.train, feats, "label", name="additive").model
    bg = models.background_means(res.train, models.LinearModel("all", feats, [], []))
    for m in res.models.values():
        if isinstance(m, models.LinearModel):
            m.background = {f: bg[f] for f in m.features}
    res.predictions = materialize(spark, models.predictions_long(res.test, list(res.models.values()), key, "label"),
                                  "predictions")
    summ = evaluate.model_summary(res.predictions).drop("accuracy", "n")
    res.metrics = impact.money(impact.decision_counts(res.predictions)).join(summ, "model")
    return res


def evaluation(res: TrainResult) -> dict[str, DataFrame]:
    """H1-H13 tables for every trained model."""
    cm = evaluate.confusion(res.predictions)
    rep = evaluate.class_report(cm)
    roc = evaluate.roc_points(res.predictions)
    return {"confusion": cm, "confusion_pct": evaluate.confusion_pct(cm), "report": rep,
            "averages": evaluate.averages(rep), "roc": roc, "auc": evaluate.auc_by_class(roc),
            "summary": evaluate.model_summary(res.predictions)}


def score(res: TrainResult, unseen: DataFrame, model: str = "additive", missing_numeric: str = "zero") -> DataFrame:
    """E7 + G3-G6: transform new rows with the fitted parameters and score."""
    prepared = prepare.transform(unseen, res.params, res.key, TARGET_COL, missing_numeric=missing_numeric)
    return models.scored_table(prepared, res.models[model], res.key, keep_features=True)


def explanations(res: TrainResult, model: str = "logistic", rows: DataFrame | None = None,
                 top: int = 10) -> dict[str, DataFrame]:
    """I1-I7 over ``rows`` (default: all labelled rows of the split)."""
    m = res.models[model]
    rows = res.split_df.drop("split") if rows is None else rows
    return {"phi": explain.phi_long(rows, m, res.key), "global": explain.global_importance(rows, m, top),
            "local_top": explain.local_topn(rows, m, res.key, top), "waterfall": explain.waterfall(rows, m, res.key)}


def audit(res: TrainResult, external: DataFrame, attrs: list[str] = SENSITIVE_ATTRS,
          external_key: str | None = None) -> dict[str, DataFrame]:
    """J1-J11 for every trained model and attribute in one pass."""
    ek = external_key or schema.find_common_key([res.key], external.columns)[1]
    rates = fairness.group_rates(fairness.audit(res.predictions, external, res.key, ek, attrs))
    diff = fairness.differences(rates)
    ext = fairness.extremes(rates)
    return {"rates": rates, "differences": diff, "overview": fairness.overview(diff),
            "narrative": fairness.narrative(ext, diff), "vs_mean": fairness.rate_vs_mean(rates)}


def business(res: TrainResult, baseline: str = "logistic", challenger: str = "additive",
             avg_loan: float = DEFAULT_AVG_LOAN, p4_rate: float = DEFAULT_P4_RATE,
             p3_rate: float = DEFAULT_P3_RATE) -> dict[str, DataFrame]:
    """K1-K11 with the given assumptions, plus the full what-if grid."""
    counts = impact.decision_counts(res.predictions)
    mm = impact.money(counts, avg_loan, p4_rate, p3_rate).join(
        evaluate.model_summary(res.predictions).drop("accuracy", "n"), "model")
    return {"money": mm, "whatif": impact.whatif_grid(counts),
            "vote": impact.model_vote(mm, baseline, challenger),
            "headline": impact.headline(mm, challenger),
            "comparison": impact.comparison_report(mm, baseline, challenger)}


def partial_dependence(res: TrainResult, feature: str, model: str = "logistic") -> DataFrame:
    """Average probability per (grid value, class) over all labelled rows."""
    rows = res.split_df.drop("split")
    return explain.partial_dependence(rows, res.models[model], feature, explain.pdp_grid(rows, feature))


def local_surrogates(res: TrainResult, ids: DataFrame, model: str = "logistic", num_features: int = 12) -> DataFrame:
    """LIME weights for the applicants whose keys ``ids`` lists (a column named as the key)."""
    return lime.lime_batch(res.train, res.split_df.drop("split"), ids, res.models[model], res.key, num_features=num_features)


def compare(res: TrainResult, pairs: DataFrame, model: str = "logistic", top: int = 5) -> DataFrame:
    """The features in which the applicants of ``pairs`` (idx_a, idx_b) differ most."""
    return explain.pair_delta(res.split_df.drop("split"), res.models[model], res.key, pairs, top)


def reports(res: TrainResult, model: str = "additive", rows: DataFrame | None = None) -> DataFrame:
    """Report records per applicant (default: the test split)."""
    return report.applicant_report(res.test if rows is None else rows, res.models[model], res.key)


def explain_once(res: TrainResult, store: explain.PhiStore, dataset: str = "labelled", model: str = "logistic") -> DataFrame:
    """Long explanations of all labelled rows, kept in ``store`` and computed on first use only."""
    return store.of(res.split_df.drop("split"), res.models[model], res.key, dataset)


def save(res: TrainResult, path: str) -> None:
    """Preparation parameters and both models as tables under ``path``."""
    spark = res.split_df.sparkSession
    res.params.to_table(spark).write.mode("overwrite").parquet(f"{path}/params")
    for name, m in res.models.items():
        kind = "linear" if isinstance(m, models.LinearModel) else "additive"
        table = m.to_table(spark, background=True) if kind == "linear" else m.to_table(spark)
        table.write.mode("overwrite").parquet(f"{path}/{kind}-{name}")


def load(spark: SparkSession, path: str, linear: tuple[str, ...] = ("logistic",),
         additive: tuple[str, ...] = ("additive",)) -> tuple[prepare.PrepParams, dict]:
    """The saved parameters and models; score new rows with ``prepare.transform`` and ``models.scored_table``."""
    params = prepare.PrepParams.from_table(spark.read.parquet(f"{path}/params"))
    found = {n: models.linear_from_table(spark.read.parquet(f"{path}/linear-{n}"), n) for n in linear}
    found |= {n: models.additive_from_table(spark.read.parquet(f"{path}/additive-{n}"), n) for n in additive}
    return params, found


def _asked(res: TrainResult, questions: DataFrame, external: DataFrame, model: str) -> dict:
    """What answers and prompts are made of, for the applicants and attributes that questions name."""
    m = res.models[model]
    rows = res.split_df.drop("split")
    routed = ask_ops.route(questions)
    text_key = F.col(res.key).cast("string")

    def info(some: DataFrame) -> DataFrame:
        return models.score(some, m, [res.key]).select(res.key, models.tier_of(F.col("pred")).alias("pred_tier"), "confidence")

    named = routed.filter(F.col("intent") == "explain_applicant").select(F.col("idx").cast("string").alias("_asked"))
    one = rows.join(named, text_key == F.col("_asked"), "left_semi")
    pairs = routed.filter(F.col("intent") == "compare_applicants").select("idx_a", "idx_b").distinct()
    ids = pairs.select(F.explode(F.array(F.col("idx_a").cast("string"), F.col("idx_b").cast("string"))).alias("_asked"))
    two = rows.join(ids, text_key == F.col("_asked"), "left_semi")
    cols = [c for c in external.columns if c.upper() == c and c not in (TARGET_COL, res.key)]
    wanted = routed.filter((F.col("intent") == "fairness") & F.col("attr").isin(cols)).select("attr").distinct().collect()
    cols = [c for c in cols if c in {r["attr"] for r in wanted}] or cols[:1]  # names of columns: a few rows
    ek = schema.find_common_key([res.key], external.columns)[1]
    rates = fairness.group_rates(fairness.audit(res.predictions.filter(F.col("model") == model), external, res.key, ek, cols))
    return {"routed": routed, "top": explain.local_topn(one, m, res.key, 5, by="phi_pred").join(info(one), res.key),
            "delta": explain.pair_delta(two, m, res.key, pairs, 5), "info": info(two),
            "gtop": explain.global_importance(rows, m, 10), "rates": rates, "diff": fairness.differences(rates),
            "summary": evaluate.model_summary(res.predictions), "n_test": res.test.agg(F.count(F.lit(1))).scalar(),
            "n_rows": rows.agg(F.count(F.lit(1))).scalar()}


def ask(res: TrainResult, questions: DataFrame, external: DataFrame, model: str = "logistic") -> DataFrame:
    """Route (qid, text) questions and answer them from the tables."""
    x = _asked(res, questions, external, model)
    return (ask_ops.answer_explain(x["routed"], x["top"], x["n_rows"], TIER_TEXT_ANALYST, res.key)
            .unionByName(ask_ops.answer_compare(x["routed"], x["delta"], x["info"], x["n_rows"], res.key))
            .unionByName(ask_ops.answer_global(x["routed"], x["gtop"]))
            .unionByName(ask_ops.answer_fairness(x["routed"], ask_ops.fairness_text(x["rates"], x["diff"]), external.columns))
            .unionByName(ask_ops.answer_performance(x["routed"], ask_ops.performance_text(x["summary"], x["n_test"])))
            .unionByName(ask_ops.answer_static(x["routed"])))


def prompts(res: TrainResult, questions: DataFrame, external: DataFrame, model: str = "logistic") -> DataFrame:
    """Prompts for an external text model, one per question that can be answered."""
    x = _asked(res, questions, external, model)
    return ask_ops.prompts(x["routed"], x["top"], x["delta"], x["info"], x["gtop"], x["rates"], x["diff"], x["summary"],
                           x["n_test"], TIER_TEXT_ANALYST, res.key)
