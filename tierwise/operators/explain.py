"""Explanations computed as column arithmetic over model parameter tables.

Per-row explanations stay as arrays inside the row until a top-k is taken
(no n x features x classes shuffle); global views are single aggregates.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TIER_CODES
from ..sources.store import exists, names
from .models import AdditiveModel, LinearModel, score
from .quantiles import exact_quantiles

K = len(TIER_CODES)


def phi_exprs(model) -> dict[tuple[str, int], Column]:
    """Contribution of feature f to the logit of class k.

    linear:   coef[k][f] * (x_f - background mean_f)   (exact, no sampling)
    additive: the shape-function score of x_f's bin     (exact by construction)
    """
    out = {}
    if isinstance(model, LinearModel):
        for j, f in enumerate(model.features):
            mu = float(model.background.get(f, 0.0) or 0.0)
            for k in range(len(model.intercept)):
                out[(f, k)] = F.lit(float(model.coef[k][j])) * (F.col(f) - F.lit(mu))
    elif isinstance(model, AdditiveModel):
        for f in model.features:
            b = model.bin_col(f) if model.bucketize else model.bin_expr(f)
            for k in range(K):
                out[(f, k)] = model.term(f, k, b)
    else:
        raise TypeError(type(model))
    return out


def with_bins(df: DataFrame, model) -> DataFrame:
    """``df`` with the bin columns that ``phi_exprs`` reads for a fitted
    additive model: one binary search per feature, shared by all classes."""
    return model.add_bins(df) if isinstance(model, AdditiveModel) and model.bucketize else df


def base_values(model) -> list[float]:
    """Expected logit per class over the background (sum(phi) + base = logit)."""
    if isinstance(model, LinearModel):
        return [float(model.intercept[k]) + sum(float(model.coef[k][j]) * float(model.background.get(f, 0.0) or 0.0)
                                                 for j, f in enumerate(model.features))
                for k in range(len(model.intercept))]
    return [float(b) for b in model.intercept]


def phi_long(df: DataFrame, model, key: str) -> DataFrame:
    """Long explanation table (key, feature, class, value, phi)."""
    ph = phi_exprs(model)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("class"),
                               F.col(f).cast("double").alias("value"), e.alias("phi"))
                      for (f, k), e in ph.items()])
    return with_bins(df, model).select(key, F.inline(items))


class PhiStore:
    """Long explanation tables kept under a path, one per (model, dataset).
    A table is looked for before it is computed, so every later view of the
    same model and rows reads it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def of(self, df: DataFrame, model, key: str, dataset: str) -> DataFrame:
        """The explanations of ``df`` (named ``dataset``) by ``model``, from the store if it has them.  A table
        is complete once its folder has Spark's success mark; one cut off half way is written anew."""
        place = f"{self.path}/model={model.name}/dataset={dataset}"
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
        if not mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
            phi_long(df, model, key).write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)

    def all(self) -> DataFrame:
        """All kept explanations with their model and dataset."""
        return self.spark.read.option("basePath", self.path).parquet(self.path)


class RowPhiStore:
    """I3 row by row: explanations kept by (model, row), a row being its key and the values of the model's
    features.  Only rows that are not there are computed; a changed row is another row.  New explanations are one
    folder a call and count once it has Spark's success mark.  Of a row given several times, one explanation is
    kept and all are returned."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, model) -> str:
        facts = model.to_table(self.spark, background=True) if isinstance(model, LinearModel) else model.to_table(self.spark)
        rows = sorted(str(tuple(r)) for r in facts.collect())          # bounded: features x bins x classes
        return f"{self.path}/model={hashlib.sha256(chr(10).join(rows).encode()).hexdigest()[:32]}"

    def _stored(self, place: str, schema) -> DataFrame:
        done = [f"{place}/{b}" for b in names(self.spark, place) if exists(self.spark, f"{place}/{b}/_SUCCESS")]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def missing(self, df: DataFrame, model, key: str) -> DataFrame:
        """One of each of the rows that have no explanation yet, with ``row_id``."""
        place = self._place(model)
        stored = self._stored(place, "row_id string").distinct()
        return self._named(df, model, key).dropDuplicates(["row_id"]).join(stored, "row_id", "left_anti")

    @staticmethod
    def _named(df: DataFrame, model, key: str) -> DataFrame:
        values = F.to_json(F.struct(F.col(key).alias("key"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(model.features)]))
        return df.select(key, *[f for f in model.features if f != key], F.sha2(values, 256).alias("row_id"))

    def of(self, df: DataFrame, model, key: str) -> DataFrame:
        """The long explanations of the rows of ``df``.  A row's are kept as two arrays and made long only behind the
        join, so what is written and shuffled is one entry a row."""
        place = self._place(model)
        ph = phi_exprs(model)
        new = with_bins(self.missing(df, model, key), model).select(
            "row_id", F.array(*[F.col(f).cast("double") for f in model.features]).alias("values"), F.array(*ph.values()).alias("phis"))
        new.write.parquet(f"{place}/{uuid.uuid4().hex}")
        now = self._named(df, model, key).select("row_id", key)
        kept = now.join(self._stored(place, new.schema).dropDuplicates(["row_id"]), "row_id")
        at = {f: i for i, f in enumerate(model.features)}
        items = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("class"), F.get("values", at[f]).alias("value"),
                                   F.get("phis", i).alias("phi")) for i, (f, k) in enumerate(ph)])
        return kept.select(key, F.inline(items))


def feature_structs(model, by: str = "mean_abs") -> Column:
    """Per row: array<struct<k, feature, value, mean_abs, mean_phi, phi_pred>>,
    where ``k`` is minus the ranking value, so that ``sort_array`` ranks by
    mean |phi| over classes (``by="mean_abs"``) or by |phi| of the predicted
    class (``by="phi_pred"``), then feature name (codegen'd; no lambda).  Over
    all classes the phi of a softmax model can cancel out; the predicted
    class's does not.  Reads the predicted class from ``pred``."""
    ph = phi_exprs(model)
    items = []
    for f in model.features:
        terms = [ph[(f, k)] for k in range(K)]
        mean_abs = sum((F.abs(t) for t in terms[1:]), F.abs(terms[0])) / F.lit(float(K))
        mean_phi = sum(terms[1:], terms[0]) / F.lit(float(K))
        phi_pred = F.element_at(F.array(*terms), F.col("pred") + 1)
        k = -mean_abs if by == "mean_abs" else -F.abs(phi_pred)
        items.append(F.struct(k.alias("k"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                              mean_abs.alias("mean_abs"), mean_phi.alias("mean_phi"), phi_pred.alias("phi_pred")))
    return F.array(*items)


def local_topn(df: DataFrame, model, key: str, n: int = 10, by: str = "mean_abs") -> DataFrame:
    """Per row, top-n features by mean |phi| over classes (or, with
    ``by="phi_pred"``, by the predicted class's |phi|), with the mean signed
    phi (reference display) and the predicted-class phi."""
    s = with_bins(score(df, model, [key] + list(model.features)), model)
    arr = F.slice(F.sort_array(feature_structs(model, by)), 1, n)
    return (s.select(key, "pred", F.posexplode(arr).alias("pos", "t"))
             .select(key, "pred", (F.col("pos") + 1).alias("rank"), "t.feature", "t.value", "t.mean_abs",
                     "t.mean_phi", "t.phi_pred"))


def global_importance(df: DataFrame, model, top: int | None = 10) -> DataFrame:
    """I4: mean |phi| over rows and classes per feature (one aggregate), top-k."""
    ph = phi_exprs(model)
    aggs = []
    for i, f in enumerate(model.features):
        tot = sum((F.abs(ph[(f, k)]) for k in range(1, K)), F.abs(ph[(f, 0)]))
        aggs.append(F.avg(tot / F.lit(float(K))).alias(f"i{i}"))
    row = with_bins(df, model).agg(*aggs)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"i{i}").alias("importance"))
                      for i, f in enumerate(model.features)])
    long = row.select(F.inline(items))
    if top is None:
        return long
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    # one row per feature: a bounded table
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def summary_points(df: DataFrame, model, key: str, max_display: int = 15) -> DataFrame:
    """(key, feature, value, class, phi) for the top ``max_display`` features."""
    top = global_importance(df, model, max_display).select("feature")
    return phi_long(df, model, key).join(F.broadcast(top), "feature")   # top: <= max_display rows


def waterfall(df: DataFrame, model, key: str, max_display: int = 10, cls: int | None = None) -> DataFrame:
    """For the predicted class (or ``cls``): base value, the top
    ``max_display - 1`` contributions by |phi| with running totals, and the
    remaining features folded into one step.  In-row array work, no shuffle."""
    ph = phi_exprs(model)
    base = base_values(model)
    s = with_bins(score(df, model, [key] + list(model.features)), model)
    k_col = F.col("pred") if cls is None else F.lit(cls)
    items = []
    for f in model.features:
        phi = F.element_at(F.array(*[ph[(f, k)] for k in range(K)]), k_col + 1)
        items.append(F.struct((-F.abs(phi)).alias("k"), F.lit(f).alias("feature"), phi.alias("phi")))
    ranked = F.sort_array(F.array(*items))          # |phi| desc, then feature
    m = min(max_display - 1, len(model.features))
    nrest = len(model.features) - m
    b = F.element_at(F.array(*[F.lit(v) for v in base]), k_col + 1)
    s2 = s.select(key, k_col.alias("class"), b.alias("base_value"), ranked.alias("_r"))
    steps = [F.struct(F.element_at("_r", i + 1)["feature"].alias("feature"),
                      F.element_at("_r", i + 1)["phi"].alias("phi")) for i in range(m)]
    if nrest > 0:
        rest = F.element_at("_r", m + 1)["phi"]
        for i in range(m + 1, len(model.features)):
            rest = rest + F.element_at("_r", i + 1)["phi"]
        steps.append(F.struct(F.lit(f"{nrest} other features").alias("feature"), rest.alias("phi")))
    # running totals as explicit prefix sums over the (bounded) step list
    cums, acc = [], F.col("base_value")
    for st in steps:
        acc = acc + st["phi"]
        cums.append(acc)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), st["feature"].alias("feature"), st["phi"].alias("phi"),
                              c.alias("cum_after")) for i, (st, c) in enumerate(zip(steps, cums))])
    return s2.select(key, "class", "base_value", F.inline(rows)).select(
        key, "class", "step", "feature", "phi", "base_value", "cum_after")


def pair_delta(df: DataFrame, model, key: str, pairs: DataFrame, n: int = 5) -> DataFrame:
    """I9 + D8: for each (idx_a, idx_b), the top-n features by |phi(b) - phi(a)|.  Both contributions are to one class,
    the one predicted for ``idx_a`` (column ``class``), so their difference is what moves that class's logit."""
    ph = phi_exprs(model)
    by_class = [F.array(*[ph[(f, k)] for f in model.features]) for k in range(K)]
    ex = with_bins(score(df, model, [key] + list(model.features)), model).select(
        F.col(key).cast("string").alias("_key"), "pred", F.array(*by_class).alias("phis"))
    a = ex.select(F.col("_key").alias("_key_a"), F.col("pred").alias("class"), F.element_at("phis", F.col("pred") + 1).alias("pa"))
    b = ex.select(F.col("_key").alias("_key_b"), F.col("phis").alias("pb"))
    j = (pairs.join(a, F.col("idx_a").cast("string") == F.col("_key_a"))
              .join(b, F.col("idx_b").cast("string") == F.col("_key_b")))
    j = j.select("idx_a", "idx_b", "class", "pa", F.element_at("pb", F.col("class") + 1).alias("pb"))
    items = []
    for i, f in enumerate(model.features, 1):
        x, y = F.element_at("pa", i), F.element_at("pb", i)
        items.append(F.struct((-F.abs(y - x)).alias("k"), F.lit(f).alias("feature"), x.alias("va"), y.alias("vb")))
    top = F.slice(F.sort_array(F.array(*items)), 1, n)
    return (j.select("idx_a", "idx_b", "class", F.posexplode(top).alias("pos", "t"))
             .select("idx_a", "idx_b", "class", (F.col("pos") + 1).alias("rank"), "t.feature", "t.va", "t.vb",
                     (F.col("t.vb") - F.col("t.va")).alias("delta")))


def quartile_bins(train: DataFrame, features: list[str]) -> DataFrame:
    """Quartile cut points per feature and (feature, bin) statistics."""
    cuts = exact_quantiles(train, features, [0.25, 0.5, 0.75])
    items = []
    for f in features:
        b = sum((F.when(F.col(f) > F.lit(c), 1).otherwise(0) for c in cuts[f][1:]),
                F.when(F.col(f) > F.lit(cuts[f][0]), 1).otherwise(0))
        items.append(F.struct(F.lit(f).alias("feature"), b.alias("bin"), F.col(f).cast("double").alias("x")))
    long = train.select(F.inline(F.array(*items)))
    stats = long.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    return stats, cuts


def pdp_grid(df: DataFrame, feature: str, resolution: int = 100, lo_p: float = 0.05, hi_p: float = 0.95):
    """Grid of I12: the unique values if fewer than ``resolution``, else an even
    grid between the (alphap=betap=0.4) 5th and 95th empirical percentiles."""
    x = F.col(feature).cast("double")
    r = df.agg(F.count(x).alias("n"), F.count_distinct(x).alias("d")).collect()[0]
    n, d = r["n"], r["d"]
    if d < resolution:
        vals = [row[0] for row in df.select(x).distinct().orderBy(1).collect()]  # < resolution rows
        return vals

    def pos(p):
        aleph = n * p + 0.4 + 0.2 * p
        return min(max((aleph - 1) / (n - 1), 0.0), 1.0)
    lo, hi = exact_quantiles(df, [feature], [pos(lo_p), pos(hi_p)])[feature]
    step = (hi - lo) / (resolution - 1)
    return [lo + i * step for i in range(resolution - 1)] + [hi]


def partial_dependence(df: DataFrame, model, feature: str, grid: list[float]) -> DataFrame:
    """I12 + D9: average predicted probability per (grid value, class).

    The grid (bounded, at most ``resolution`` values) is expanded inside each
    row; partial aggregation then reduces before any shuffle."""
    g = F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(float(v)).alias("gv")) for i, v in enumerate(grid)])
    others = [f for f in model.features if f != feature]
    e = df.select(*others, F.inline(g)).withColumn(feature, F.col("gv"))
    s = score(e, model, ["gi", "gv"])
    probs = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"Prob_{t}").alias("p"))
                      for k, t in enumerate(TIER_CODES)])
    return (s.select("gi", "gv", F.inline(probs)).groupBy("gi", "gv", "class")
             .agg(F.avg("p").alias("avg_prob")))


def additive_importance(train: DataFrame, model: AdditiveModel) -> DataFrame:
    """Mean |score| per feature over training rows (bin-count weighted)."""
    return global_importance(train, model, None)
