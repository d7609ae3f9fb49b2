"""Models: coefficient/shape tables compiled into column expressions.

A fitted model is a small parameter table (classes x features, or
features x bins x classes).  Scoring compiles it into plain column
arithmetic - logits, max-shifted softmax, argmax - so predicting is a
narrow, codegen'd projection with no shuffle and no Python worker.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TIER_CODES, TIER_TEXT_SCORING
from ..functions.numeric import round_half_up

K = len(TIER_CODES)


# --------------------------------------------------------------------------- linear
@dataclass
class LinearModel:
    name: str
    features: list[str]
    coef: list[list[float]]            # [class][feature]
    intercept: list[float]             # [class]
    background: dict[str, float] = field(default_factory=dict)   # feature means for phi

    def logits(self) -> list[Column]:
        out = []
        for k in range(len(self.intercept)):
            z = F.lit(float(self.intercept[k]))
            for j, f in enumerate(self.features):
                z = z + F.lit(float(self.coef[k][j])) * F.col(f)
            out.append(z)
        return out

    def to_table(self, spark: SparkSession, background: bool = False) -> DataFrame:
        """Coefficients and intercepts; with ``background`` also the feature
        means, as rows of class -1."""
        rows = [(self.name, k, f, float(self.coef[k][j])) for k in range(len(self.intercept))
                for j, f in enumerate(self.features)]
        rows += [(self.name, k, "(intercept)", float(b)) for k, b in enumerate(self.intercept)]
        if background:
            rows += [(self.name, -1, f, float(v)) for f, v in self.background.items() if v is not None]
        return spark.createDataFrame(rows, "model string, class int, feature string, coef double")


def linear_from_table(table: DataFrame, name: str) -> LinearModel:
    """Build from a long (model, class, feature, coef) table; bounded size."""
    found = table.filter(F.col("model") == name).collect()
    rows = [r for r in found if r["class"] >= 0]
    feats = []
    for r in sorted(rows, key=lambda r: (r["class"], r["feature"])):
        if r["feature"] != "(intercept)" and r["feature"] not in feats:
            feats.append(r["feature"])
    n_cls = max(r["class"] for r in rows) + 1
    coef = [[0.0] * len(feats) for _ in range(n_cls)]
    icpt = [0.0] * n_cls
    for r in rows:
        if r["feature"] == "(intercept)":
            icpt[r["class"]] = r["coef"]
        else:
            coef[r["class"]][feats.index(r["feature"])] = r["coef"]
    return LinearModel(name, feats, coef, icpt, {r["feature"]: r["coef"] for r in found if r["class"] < 0})


def fit_logistic(train: DataFrame, features: list[str], label: str = "label", C: float = 1.0,
                 max_iter: int = 1000, tol: float = 1e-4, name: str = "logistic",
                 weight_col: str | None = None) -> LinearModel:
    """G1: multinomial L2 logistic regression on Spark ML (distributed L-BFGS).

    The reference minimises C*sum(loss) + |w|^2/2; Spark minimises
    mean(loss) + regParam*|w|^2/2, hence regParam = 1/(C*n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = train.count()
    va = VectorAssembler(inputCols=features, outputCol="_features")
    data = va.transform(train.select(*features, label)).select("_features", label).persist()
    lr = LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial",
                            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=tol)
    if weight_col:
        lr.setWeightCol(weight_col)
    m = lr.fit(data)
    data.unpersist()
    cm = m.coefficientMatrix.toArray().tolist()
    icpt = m.interceptVector.toArray().tolist()
    while len(cm) < K:       # a class absent from training keeps zero weights
        cm.append([0.0] * len(features))
        icpt.append(-1e9)
    return LinearModel(name, list(features), cm, icpt)


def background_means(df: DataFrame, model) -> dict[str, float]:
    """Feature means over the background rows (the full training set)."""
    feats = model.features
    r = df.agg(*[F.avg(F.col(f)).alias(f"b{i}") for i, f in enumerate(feats)]).collect()[0]
    return {f: r[f"b{i}"] for i, f in enumerate(feats)}


# --------------------------------------------------------------------------- additive
@dataclass
class AdditiveModel:
    """Per-feature shape functions: score(feature, bin, class); no interactions."""
    name: str
    features: list[str]
    edges: dict[str, list[float]]      # bin b covers [edges[b-1], edges[b]); open ends
    scores: dict[str, list[list[float]]]   # feature -> [bin][class]
    intercept: list[float]
    bucketize: bool = False                # bins by Bucketizer (binary search) instead of comparisons

    def add_bins(self, df: DataFrame) -> DataFrame:
        """Bin columns ``_bin_<feature>`` via one multi-column Bucketizer."""
        from pyspark.ml.feature import Bucketizer
        cut = [f for f in self.features if self.edges[f]]
        if not cut:
            return df
        return Bucketizer(splitsArray=[[-float("inf")] + list(self.edges[f]) + [float("inf")] for f in cut],
                          inputCols=cut, outputCols=[f"_bin_{f}" for f in cut]).transform(df)

    def bin_col(self, f: str) -> Column:
        return F.col(f"_bin_{f}").cast("int") if self.edges[f] else F.lit(0)

    def bin_expr(self, f: str) -> Column:
        x = F.col(f)
        b = F.lit(0)
        for e in self.edges[f]:
            b = b + F.when(x >= F.lit(float(e)), 1).otherwise(0)
        return b

    def term(self, f: str, k: int, bin_col: Column | None = None) -> Column:
        b = self.bin_expr(f) if bin_col is None else bin_col
        arr = F.array(*[F.lit(float(s[k])) for s in self.scores[f]])
        return F.element_at(arr, b + 1)

    def logits(self, from_bin_cols: bool = False) -> list[Column]:
        bins = {f: (self.bin_col(f) if from_bin_cols else self.bin_expr(f)) for f in self.features}
        out = []
        for k in range(K):
            z = F.lit(float(self.intercept[k]))
            for f in self.features:
                z = z + self.term(f, k, bins[f])
            out.append(z)
        return out

    def shape_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for f in self.features:
            e = self.edges[f]
            for b, sc in enumerate(self.scores[f]):
                lo = float(e[b - 1]) if b > 0 else None
                hi = float(e[b]) if b < len(e) else None
                rows += [(self.name, f, b, lo, hi, k, float(sc[k])) for k in range(K)]
        return spark.createDataFrame(
            rows, "model string, feature string, bin int, lo double, hi double, class int, score double")


    def to_table(self, spark: SparkSession) -> DataFrame:
        """Shapes, intercept and feature order: all that scoring and explaining needs."""
        order = {f: i for i, f in enumerate(self.features)}
        shapes = self.shape_table(spark).withColumn("position", F.lit(0))
        rank = F.lit(len(order))
        for f, i in order.items():
            rank = F.when(F.col("feature") == f, F.lit(i)).otherwise(rank)
        icpt = spark.createDataFrame([(self.name, "(intercept)", 0, None, None, k, float(v), -1)
                                      for k, v in enumerate(self.intercept)], shapes.schema)
        return shapes.withColumn("position", rank).unionByName(icpt)


def additive_from_table(table: DataFrame, name: str) -> AdditiveModel:
    """Rebuild a saved model (features x bins x classes rows, bounded)."""
    rows = sorted(table.filter(F.col("model") == name).collect(), key=lambda r: (r["position"], r["bin"], r["class"]))
    shapes: dict[str, dict] = {}
    for r in rows:
        if r["position"] >= 0:
            shapes.setdefault(r["feature"], {}).setdefault(r["bin"], (r["lo"], r["hi"], []))[2].append(r["score"])
    literal = [(f, b, lo, hi, sc) for f, bins in shapes.items() for b, (lo, hi, sc) in bins.items()]
    model = additive_from_shapes(literal, list(shapes), name, [r["score"] for r in rows if r["position"] < 0])
    model.bucketize = True
    return model


def additive_from_shapes(spark_rows: list, features: list[str], name: str, intercept=None) -> AdditiveModel:
    """From literal (feature, bin, lo, hi, [scores]) rows (the fixed shape table)."""
    edges, scores = {}, {}
    for f in features:
        rs = sorted([r for r in spark_rows if r[0] == f], key=lambda r: r[1])
        edges[f] = [r[3] for r in rs if r[3] is not None]
        scores[f] = [list(r[4]) for r in rs]
    return AdditiveModel(name, features, edges, scores, list(intercept or [0.0] * K))


def fit_additive(train: DataFrame, features: list[str], label: str = "label", n_bins: int = 32,
                 reg: float = 1e-3, max_iter: int = 100, name: str = "additive",
                 accuracy: int = 2_000) -> AdditiveModel:
    """Binned additive multinomial logit (glass-box, no interactions).

    Bins: approximate quantiles per feature (one aggregate for all features;
    0/1 columns get their natural 2 bins).  Bin indicators go to Spark ML's
    distributed multinomial logistic regression; its coefficients are the
    shape functions, centred per (feature, class) on the training bin
    frequencies with the offset moved to the intercept.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    probs = [i / n_bins for i in range(1, n_bins)]
    aggs = [F.percentile_approx(F.col(f), probs, accuracy).alias(f"q{i}") for i, f in enumerate(features)]
    r = train.agg(*aggs).collect()[0]
    edges = {}
    for i, f in enumerate(features):
        qs = sorted(set(float(v) for v in (r[f"q{i}"] or [])))
        edges[f] = [v for v in qs if v > qs[0]] if qs else []
    from pyspark.ml.feature import Bucketizer
    bin_cols = [f"_bin{i}" for i in range(len(features))]
    # JVM binary search per feature; bucket b = number of edges <= x (same as bin_expr)
    cut = [(f, bc) for f, bc in zip(features, bin_cols) if edges[f]]
    src = train.select(label, *features)
    if cut:
        src = Bucketizer(splitsArray=[[-float("inf")] + edges[f] + [float("inf")] for f, _ in cut],
                         inputCols=[f for f, _ in cut], outputCols=[bc for _, bc in cut]).transform(src)
    binned = src.select(label, *[(F.col(bc).cast("int") if edges[f] else F.lit(0)).alias(bc)
                                 for f, bc in zip(features, bin_cols)]).persist()
    sizes = [len(edges[f]) + 1 for f in features]
    ohe = OneHotEncoder(inputCols=bin_cols, outputCols=[c + "_v" for c in bin_cols], dropLast=False)
    ohe_model = ohe.fit(binned)
    widths = ohe_model.categorySizes
    va = VectorAssembler(inputCols=[c + "_v" for c in bin_cols], outputCol="_x")
    data = va.transform(ohe_model.transform(binned)).select("_x", label).persist()
    lr = LogisticRegression(featuresCol="_x", labelCol=label, family="multinomial", regParam=reg,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-5)
    m = lr.fit(data)
    cm = m.coefficientMatrix.toArray()
    icpt = list(m.interceptVector.toArray())
    # bin frequencies for centring (one small aggregate: features x bins rows)
    freq_rows = binned.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(bc).alias("b"))
                                                    for i, bc in enumerate(bin_cols)])).alias("fb")) \
                      .groupBy("fb.f", "fb.b").agg(F.count(F.lit(1)).alias("n")).collect()
    freq = {(row["f"], row["b"]): row["n"] for row in freq_rows}
    data.unpersist()
    binned.unpersist()
    scores = {}
    off = 0
    n_cls = cm.shape[0]
    icpt = icpt + [-1e9] * (K - n_cls)
    for i, f in enumerate(features):
        w = widths[i]
        sc = [[float(cm[k][off + b]) if (k < n_cls and b < w) else 0.0 for k in range(K)] for b in range(sizes[i])]
        off += w
        for k in range(K):
            tot = sum(freq.get((i, b), 0) for b in range(sizes[i]))
            mean = sum(freq.get((i, b), 0) * sc[b][k] for b in range(sizes[i])) / max(tot, 1)
            for b in range(sizes[i]):
                sc[b][k] -= mean
            icpt[k] += mean
        scores[f] = sc
    return AdditiveModel(name, list(features), edges, scores, icpt, bucketize=True)


# --------------------------------------------------------------------------- scoring
def prob_cols() -> list[str]:
    return [f"Prob_{c}" for c in TIER_CODES]


def score(df: DataFrame, model, keep: list[str]) -> DataFrame:
    """Logits -> probabilities (max-shifted softmax) -> argmax (ties to
    the lower class) -> confidence.  Two narrow projections, no shuffle."""
    if isinstance(model, AdditiveModel) and model.bucketize:
        df = model.add_bins(df)
        z = model.logits(from_bin_cols=True)
    else:
        z = model.logits()
    zc = [f"_z{k}" for k in range(len(z))]
    s1 = df.select(*keep, *[e.alias(n) for e, n in zip(z, zc)])
    m = F.greatest(*[F.col(c) for c in zc])
    ex = [F.exp(F.col(c) - m) for c in zc]
    tot = ex[0]
    for e in ex[1:]:
        tot = tot + e
    pred = F.lit(len(zc) - 1)
    for k in reversed(range(len(zc) - 1)):
        pred = F.when(F.col(zc[k]) == m, F.lit(k)).otherwise(pred)
    s2 = s1.select(*keep, *[(e / tot).alias(p) for e, p in zip(ex, prob_cols())], pred.cast("int").alias("pred"))
    conf = F.element_at(F.array(*[F.col(p) for p in prob_cols()]), F.col("pred") + 1)
    return s2.withColumn("confidence", conf)


def tier_of(pred: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIER_CODES]), pred + 1)


def scored_table(df: DataFrame, model, key: str, keep_features: bool = True,
                 tiers: dict = TIER_TEXT_SCORING) -> DataFrame:
    """Features + Predicted_Class + Tier_Description + Prob_* (4 dp) +
    Confidence (4 dp).  The applicant key is kept (the reference drops it)."""
    feats = list(model.features) if keep_features else []
    s = score(df, model, [key] + [f for f in feats if f != key])
    desc = F.create_map(*[x for t in TIER_CODES for x in (F.lit(t), F.lit(tiers[t]))])
    cls = tier_of(F.col("pred"))
    return s.select(key, *[f for f in feats if f != key], cls.alias("Predicted_Class"),
                    desc[cls].alias("Tier_Description"),
                    *[round_half_up(p, 4).alias(p) for p in prob_cols()],
                    round_half_up("confidence", 4).alias("Confidence"))


def predictions_long(df: DataFrame, models: list, key: str, label: str = "label",
                     extra: list[str] | None = None) -> DataFrame:
    """Every model over the same rows, in long form with ``model``.  The rows are read once: each model adds its
    logits as columns, and one projection makes a row per model of them.  Of fitted additive models (hundreds of
    lookups each) only one shares a scan, as generated code for more would outgrow what the JVM compiles."""
    extra = extra or []
    fitted = [m for m in models if isinstance(m, AdditiveModel) and m.bucketize]
    if len(fitted) > 1:
        first = predictions_long(df, [m for m in models if m not in fitted[1:]], key, label, extra)
        for m in fitted[1:]:
            first = first.unionByName(predictions_long(df, [m], key, label, extra))
        return first
    held = [key, label, *extra]
    features = [f for m in models for f in m.features]
    base = list(dict.fromkeys(held + features))
    wide, kept = df.select(*[F.col(f"`{c}`") for c in base]), base
    for i, m in enumerate(models):
        by_search = isinstance(m, AdditiveModel) and m.bucketize
        src = m.add_bins(wide) if by_search else wide
        z = m.logits(from_bin_cols=True) if by_search else m.logits()
        wide = src.select(*[F.col(f"`{c}`") for c in kept], *[e.alias(f"_z{i}_{k}") for k, e in enumerate(z)])
        kept = kept + [f"_z{i}_{k}" for k in range(len(z))]
    def named(i: int, what: str) -> list[str]:
        return [f"_{what}{i}_{k}" for k in range(K)]

    each = range(len(models))
    top = {i: F.greatest(*[F.col(c) for c in named(i, "z")]) for i in each}
    ex = wide.select(*held, *[F.exp(F.col(z) - top[i]).alias(e) for i in each for z, e in zip(named(i, "z"), named(i, "e"))],
                     *[_first_greatest(named(i, "z"), top[i]).alias(f"_pred{i}") for i in each])
    probs = ex.select(*held, *[f"_pred{i}" for i in each], *[(F.col(e) / _sum(named(i, "e"))).alias(p)
                                                              for i in each for e, p in zip(named(i, "e"), named(i, "p"))])
    rows = F.array(*[F.struct(
        F.lit(m.name).alias("model"), F.col(f"_pred{i}").alias("pred"), *[F.col(p).alias(n) for p, n in zip(named(i, "p"), prob_cols())],
        F.greatest(*[F.col(p) for p in named(i, "p")]).alias("confidence")) for i, m in enumerate(models)])
    out = probs.select(F.col(key), F.col(label).alias("actual"), *extra, F.inline(rows))
    return out.select("model", key, "actual", "pred", *prob_cols(), "confidence", *extra)


def _sum(names: list[str]) -> Column:
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return total


def _first_greatest(names: list[str], top: Column) -> Column:
    """The place of the first column that equals the greatest: ties go to the lower class."""
    at = F.lit(len(names) - 1)
    for k in reversed(range(len(names) - 1)):
        at = F.when(F.col(names[k]) == top, F.lit(k)).otherwise(at)
    return at.cast("int")


def tier_counts(scored: DataFrame, spark: SparkSession) -> DataFrame:
    """G7 + C10: tier counts of a scored batch on the complete 4-tier grid."""
    dim = spark.createDataFrame([(t, i) for i, t in enumerate(TIER_CODES)], "Predicted_Class string, _o int")
    c = scored.groupBy("Predicted_Class").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(dim).join(c, "Predicted_Class", "left")
            .select("Predicted_Class", F.coalesce("n", F.lit(0).cast("long")).alias("n")))

