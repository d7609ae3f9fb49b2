"""End-to-end plans: train (merge -> prepare -> split -> score -> evaluate),
score new rows, audit fairness, money terms.

``Workbench`` wires the operators over one input directory.  Attributes are
lazy DataFrames; fitted parameters (bounded tables) are computed on first use.
Every registered query plans over the whole input tables.  Tables that several
of its jobs read stay persisted until the session's cache is cleared (the bench
does so after each query); a later query may find them there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import KEY_COL, SENSITIVE_ATTRS, TARGET_COL, TIER_CODES
from ..operators import evaluate, impact, merge, models, prepare, split
from ..sources import fixtures

BASELINE, CHALLENGER = "fixed_a", "fixed_b"
RULE_BASELINE, RULE_CHALLENGER = "rule_a", "rule_b"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Reuse point for a table that several jobs read (parameter fits, split
    histogram, scoring).  ``tierwise.materialize=table`` writes it as parquet
    under the shared checkpoint folder (cuts lineage; survives executor loss
    without recomputation); the default keeps it in the block manager
    (memory, spilling to disk; lost blocks are recomputed from lineage)."""
    mode = spark.conf.get("tierwise.materialize", "persist")
    if mode == "table":
        import uuid
        from ..config import scratch_path
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    if mode == "none":
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Workbench:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # ------------------------------------------------------------ inputs
    @cached_property
    def internal(self) -> DataFrame:
        return fixtures.internal(self.spark, self.sf_dir)

    @cached_property
    def external(self) -> DataFrame:
        return materialize(self.spark, fixtures.external(self.spark, self.sf_dir), "external")

    @cached_property
    def merged(self) -> DataFrame:
        return materialize(self.spark, merge.merge(self.internal, self.external), "merged")

    @cached_property
    def unseen_raw(self) -> DataFrame:
        return fixtures.unseen(self.spark, self.sf_dir, self.merged)

    @cached_property
    def rule_preds(self) -> DataFrame:
        return fixtures.rule_predictions(self.spark, self.sf_dir, self.external)

    # ------------------------------------------------------------ prepare
    @cached_property
    def params(self) -> prepare.PrepParams:
        return prepare.fit(self.merged, KEY_COL, TARGET_COL)

    @cached_property
    def prepared_all(self) -> DataFrame:
        return prepare.transform(self.merged, self.params, KEY_COL, TARGET_COL)

    @cached_property
    def labelled(self) -> DataFrame:
        return prepare.known_labels(self.prepared_all)

    @cached_property
    def split_df(self) -> DataFrame:
        tiers = {t: i for i, t in enumerate(TIER_CODES)}
        counts = {tiers[v]: n for v, n in self.params.target_counts.items() if v in tiers}
        return materialize(self.spark, split.stratified_split(self.labelled, KEY_COL, "label", counts=counts), "split")

    @cached_property
    def train(self) -> DataFrame:
        return self.split_df.filter(F.col("split") == "train").drop("split")

    @cached_property
    def test(self) -> DataFrame:
        return self.split_df.filter(F.col("split") == "test").drop("split")

    @cached_property
    def unseen_prepared(self) -> DataFrame:
        return prepare.transform(self.unseen_raw, self.params, KEY_COL, TARGET_COL, missing_numeric="zero")

    # ------------------------------------------------------------ models
    @cached_property
    def fixed_models(self) -> dict[str, models.LinearModel]:
        """Both fixed models; background means of all their features in one pass."""
        table = fixtures.fixed_coefficients(self.spark)
        ms = {n: models.linear_from_table(table, n) for n in (BASELINE, CHALLENGER)}
        union = models.LinearModel("all", sorted({f for m in ms.values() for f in m.features}), [], [])
        bg = models.background_means(self.train, union)
        for m in ms.values():
            m.background = {f: bg[f] for f in m.features}
        return ms

    @property
    def fixed_a(self) -> models.LinearModel:
        return self.fixed_models[BASELINE]

    @property
    def fixed_b(self) -> models.LinearModel:
        return self.fixed_models[CHALLENGER]

    @cached_property
    def fixed_shape_model(self) -> models.AdditiveModel:
        feats = sorted({r[0] for r in fixtures.FIXED_SHAPES})
        return models.additive_from_shapes(fixtures.FIXED_SHAPES, feats, "fixed_shape")

    @cached_property
    def fixed_preds(self) -> DataFrame:
        """Test-split predictions of both fixed models, long form."""
        return materialize(self.spark, models.predictions_long(self.test, [self.fixed_a, self.fixed_b], KEY_COL,
                                                               "label"), "fixed_preds")

    # ------------------------------------------------------------ summaries
    def model_metrics(self, preds: DataFrame) -> DataFrame:
        """Per model: f1_macro, f1_weighted, auc_ovr, accuracy + money at defaults."""
        summ = evaluate.model_summary(preds).drop("accuracy", "n")
        mm = impact.money(impact.decision_counts(preds))
        return mm.join(summ, "model")

    def attrs_long(self, preds: DataFrame, attrs=SENSITIVE_ATTRS) -> DataFrame:
        from ..operators import fairness
        return fairness.audit(preds, self.external, KEY_COL, "prospectid", attrs)
