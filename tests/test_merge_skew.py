"""D1 and D4 on hot, repeated and null keys; I9 on one class; G8 from one scan; C14 lakh."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tierwise.constants import KEY_COL
from tierwise.functions.text import fmt_lakh
from tierwise.operators import explain, fairness, merge, models
from tierwise.plans.workbench import Workbench


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 200).cast("long").alias("k"),
                                 F.col("id").alias("a"), F.lit(1).alias("same"))
    b = spark.range(400).select(F.when(F.col("id") % 10 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).cast("long").alias("K"),
                                F.col("id").alias("b"), F.lit(2).alias("same"))
    return a, b


@pytest.mark.parametrize("null_safe", [True, False])
def test_spread_merge_is_the_merge(spark, sides, null_safe):
    plain = merge.merge(*sides, ("k", "K"), null_safe=null_safe)
    hot = merge.merge(*sides, ("k", "K"), null_safe=null_safe, hot_rows=500)
    assert hot.columns == plain.columns
    assert sorted(map(tuple, hot.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    size = merge.merge_size(*sides, ("k", "K")).first()
    assert plain.count() == size.n_rows + (size.null_pairs if null_safe else 0) and size.null_pairs > 0


def test_no_task_holds_the_hot_key(spark, sides):
    joined = merge.spread(sides[0].select("k", "a"), sides[1].select(F.col("K").alias("r"), "b"), "k", "r", False, 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = sides[0].join(sides[1].withColumnRenamed("K", "r"), F.col("k") == F.col("r")).groupBy(F.spark_partition_id()).count()
        worst = max(r["count"] for r in plain.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(rows) <= 4 * sum(rows) / 40 < worst / 4


def test_hot_rows_are_repeated_by_the_rows_and_not_by_the_pairs(spark):
    """A key with 4 million pairs: what meets in the join stays near the input."""
    a = spark.range(4_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("a"))
    b = spark.range(1_000).select(F.lit(1).cast("long").alias("r"), F.col("id").alias("b"))
    joined = merge.spread(a, b, "k", "r", False, 10)
    assert joined.columns == ["k", "a", "r", "b"]
    got = joined.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("a").alias("x")).first()
    assert tuple(got) == (4_000_000, 1_000 * sum(range(4_000)), 4_000 * sum(range(1_000)), 3_999)
    for large, small, hot in ((20_000, 2_000, 10), (1_800_000, 22_500, 10_000), (10_000_000, 10_000_000, 1), (10_000_000, 3, 100)):
        cuts_large, cuts_small = spark.range(1).select(*merge.grid(F.lit(large).cast("long"), F.lit(small).cast("long"), hot)).first()
        assert large * cuts_small + small * cuts_large <= 2 * 64 * (large + small)


def test_rows_of_a_hot_key_stand_so_that_they_are_written_small(spark, tmp_path):
    """A key with 18 million pairs of rows that tell nothing of each other: a pair costs a fraction of a byte."""
    a = spark.range(6_000).select(F.lit(1).cast("long").alias("k"), F.xxhash64("id").alias("a"))
    b = spark.range(3_000).select(F.lit(1).cast("long").alias("r"), F.xxhash64(F.col("id") + 6_000).alias("b"))
    merge.spread(a, b, "k", "r", False, 10_000_000).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(got.agg(F.count(F.lit(1)), F.countDistinct("b")).first()) == (18_000_000, 3_000)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.2 * 18_000_000


def test_attributes_never_multiply_predictions(spark):
    pred = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (None, 2, 0), (None, 3, 0), (9, 0, 0)], "id long, actual int, pred int").withColumn("model", F.lit("m"))
    ext = spark.createDataFrame([(1, "F", None), (1, "F", "X"), (None, "M", "Y"), (None, "F", "Z"), (None, "M", "Y"), (2, "M", "Y")], "key long, g string, e string")
    got = merge.attach_attributes(pred, ext, "id", "key", ["g", "e", "absent"])
    assert sorted(((r.id, r.actual, r.g, r.e) for r in got.collect()), key=str) == sorted(
        [(1, 0, "F", None), (1, 1, "F", None), (None, 2, None, None), (None, 3, None, None), (9, 0, None, None)], key=str)
    rates = fairness.group_rates(fairness.audit(pred, ext, "id", "key", ["g"])).collect()
    assert [(r.grp, r.n) for r in rates] == [("F", 2)]
    assert merge.attach_attributes(pred, ext, "id", "key", ["absent"]).count() == 5


def test_delta_is_on_one_class(spark):
    wb = Workbench(spark, SF01)
    m = wb.fixed_a
    scored = models.score(wb.test, m, [KEY_COL]).orderBy(KEY_COL).collect()
    a, b = next((x, y) for x in scored for y in scored if x.pred != y.pred)
    pairs = spark.createDataFrame([(a[KEY_COL], b[KEY_COL])], "idx_a long, idx_b long")
    rows = explain.pair_delta(wb.test, m, KEY_COL, pairs, n=len(m.features)).collect()
    assert {r["class"] for r in rows} == {a.pred} and len(rows) == len(m.features)
    x = {r[KEY_COL]: r for r in wb.test.filter(F.col(KEY_COL).isin(a[KEY_COL], b[KEY_COL])).collect()}
    logit = [m.intercept[a.pred] + sum(m.coef[a.pred][j] * x[i[KEY_COL]][f] for j, f in enumerate(m.features)) for i in (a, b)]
    assert abs(sum(r.delta for r in rows) - (logit[1] - logit[0])) < 1e-9


def test_predictions_of_all_models_read_the_rows_once(spark):
    wb = Workbench(spark, SF01)
    rows = wb.test.select(KEY_COL, "label", *sorted({*wb.fixed_a.features, *wb.fixed_b.features, *wb.fixed_shape_model.features}))
    path_rows = spark.createDataFrame(rows.collect(), rows.schema)
    each = [wb.fixed_a, wb.fixed_shape_model, wb.fixed_b]
    together = models.predictions_long(path_rows, each, KEY_COL)
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan
    for m in each:
        alone = models.score(path_rows, m, [KEY_COL, "label"]).select(KEY_COL, "pred", "Prob_P1", "Prob_P4", "confidence").collect()
        mine = together.filter(F.col("model") == m.name).select(KEY_COL, "pred", "Prob_P1", "Prob_P4", "confidence").collect()
        assert sorted(map(tuple, alone)) == sorted(map(tuple, mine))


def test_lakh(spark):
    got = spark.createDataFrame([(0.0,), (149_999.0,), (150_000.0,), (1.234567e11,), (None,)], "x double").select(fmt_lakh("x")).collect()
    assert [r[0] for r in got] == ["Rs 0L", "Rs 1L", "Rs 2L", "Rs 1,234,567L", None]
