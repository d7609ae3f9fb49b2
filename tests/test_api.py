"""End-to-end user API on the sf0.001 fixtures: train -> evaluate -> score ->
explain -> audit -> business -> ask."""

from pyspark.sql import functions as F

from tierwise import api
from tierwise.sources import fixtures

from conftest import SF


def test_api_end_to_end(spark):
    internal = fixtures.internal(spark, SF)
    external = fixtures.external(spark, SF)
    res = api.train(spark, internal, external, sample_pct=100)
    assert set(res.models) == {"logistic", "additive"}
    m = {r["model"]: r for r in res.metrics.collect()}
    assert set(m) == {"logistic", "additive"}
    for r in m.values():
        assert 0.0 <= r["accuracy"] <= 1.0
        assert r["auc_ovr"] is None or 0.0 <= r["auc_ovr"] <= 1.0
    ev = api.evaluation(res)
    assert ev["confusion"].count() == 32
    merged = api.merge_inputs(internal, external)
    unseen = fixtures.unseen(spark, SF, merged)
    scored = api.score(res, unseen, "additive")
    assert scored.count() == unseen.count()
    ex = api.explanations(res, "logistic")
    assert ex["global"].count() == 10
    au = api.audit(res, external)
    assert au["overview"].count() == 2 * 3
    bz = api.business(res)
    assert bz["whatif"].count() == 2 * 20 * 13 * 8
    qs = spark.createDataFrame([(1, "explain applicant 42"), (2, "fairness for GENDER"), (3, "help"),
                                (4, "how accurate is the model?")], "qid long, text string")
    ans = {r["qid"]: r["answer"] for r in api.ask(res, qs, external).collect()}
    assert set(ans) == {1, 2, 3, 4}
    assert ans[2].startswith("**Fairness — GENDER:**")
    assert "Logistic" not in ans[4] and "| logistic |" in ans[4]


def test_fit_on_train_option(spark):
    internal = fixtures.internal(spark, SF)
    external = fixtures.external(spark, SF)
    res = api.train(spark, internal, external, fit_on="train", model_names=("logistic",))
    assert res.predictions.filter(F.col("model") == "logistic").count() > 0


def test_other_key_name_and_string_keys(spark, tmp_path):
    """The whole flow with key CUST_ID of type string, then save, load, score and explain both models."""
    key = lambda c: F.concat(F.lit("A"), F.col(c)).alias("CUST_ID")
    internal, external = fixtures.internal(spark, SF), fixtures.external(spark, SF)
    internal = internal.select(key("PROSPECTID"), *[c for c in internal.columns if c != "PROSPECTID"])
    external = external.select(key("prospectid").alias("cust_id"), *[c for c in external.columns if c != "prospectid"])
    res = api.train(spark, internal, external)
    assert res.key == "CUST_ID"
    someone = [r["CUST_ID"] for r in res.split_df.select("CUST_ID").orderBy("CUST_ID").limit(2).collect()]
    qs = spark.createDataFrame([(1, "explain applicant 42"), (2, "compare applicants 3 and 9"), (3, "fairness for GENDER"),
                                (4, "what features drive approvals?"), (5, "how accurate is the model?")], "qid long, text string")
    assert {r["qid"] for r in api.ask(res, qs, external).collect()} == {1, 2, 3, 4, 5}
    assert {r["qid"] for r in api.prompts(res, qs, external).collect()} == {3, 4, 5}   # no applicant is named 42, 3 or 9
    ids = spark.createDataFrame([(x,) for x in someone], "CUST_ID string")
    lime = api.local_surrogates(res, ids, "additive", 3).collect()
    assert {r["CUST_ID"] for r in lime} == set(someone) and len(lime) == 6
    pairs = spark.createDataFrame([tuple(someone)], "idx_a string, idx_b string")
    assert api.compare(res, pairs).filter("delta <> 0").count() > 0
    assert api.partial_dependence(res, "Credit_Score").count() > 0
    assert api.reports(res).select("CUST_ID").distinct().count() == res.test.count()
    api.save(res, str(tmp_path / "m"))
    params, loaded = api.load(spark, str(tmp_path / "m"))
    assert params.feature_names == res.params.feature_names
    assert params.target_counts == res.params.target_counts
    from tierwise.operators import explain, models
    for name, m in res.models.items():
        a = models.scored_table(res.test, m, "CUST_ID", keep_features=False)
        b = models.scored_table(res.test, loaded[name], "CUST_ID", keep_features=False)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        assert explain.phi_long(res.test, m, "CUST_ID").exceptAll(explain.phi_long(res.test, loaded[name], "CUST_ID")).isEmpty()


def test_fitted_explanations_name_reasons(spark):
    """On a fitted softmax model the mean contribution over classes cancels out; the words use the predicted class's."""
    res = api.train(spark, fixtures.internal(spark, SF), fixtures.external(spark, SF), model_names=("logistic",))
    k = res.split_df.agg(F.min("PROSPECTID")).first()[0]
    qs = spark.createDataFrame([(1, f"explain applicant {k}")], "qid long, text string")
    answer = api.ask(res, qs, fixtures.external(spark, SF)).first()["answer"]
    assert "SHAP +" in answer or "SHAP -" in answer
    assert "0.0000" not in answer
