"""Sparse one-hot features (E4, E5): categories are rows of a table, not columns.

``prepare`` makes one column per category, which suits a handful of them.
Here the categories of all columns are one index table (column, value, n,
pos), a row's features are an array of (pos, value) pairs without zeros, and
a model is a table of weights by position.  Encoding, scoring and explaining
join each categorical column with the index once; Spark broadcasts the index
while it is small and splits hot categories where it is not.  No task holds
all categories of a column, and the driver gets one row per column.

Null takes the column's mode, an unseen value has no entry, as in ``prepare``.
Rows are kept as they are, repeated keys and null keys included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import written
from ..constants import KEY_COL, TARGET_COL
from . import models, prepare
from .schema import column_kinds


FEATURES = "array<struct<pos:bigint,value:double>>"


@dataclass
class SparseParams:
    numeric: prepare.PrepParams          # the numeric columns' parameters
    cat_cols: list[str]
    modes: dict[str, str]
    sizes: dict[str, int]                # categories per column
    index: DataFrame                     # column, value, n, pos

    @property
    def num_cols(self) -> list[str]:
        return self.numeric.num_cols

    @property
    def width(self) -> int:
        return len(self.num_cols) + sum(self.sizes.values())

    def first(self, c: str) -> int:
        """Position of the column's first category."""
        return len(self.num_cols) + sum(self.sizes[x] for x in self.cat_cols[:self.cat_cols.index(c)])


@dataclass
class SparseModel:
    """Weights by position; ``background`` is a feature's mean over the training rows."""
    name: str
    intercept: list[float]
    weights: DataFrame                   # pos, coefs array<double>, background


@dataclass
class _Logits:
    given: list[Column]

    def logits(self) -> list[Column]:
        return self.given


def category_counts(df: DataFrame, cats: list[str]) -> DataFrame:
    """Rows per (column number, value), nulls left out."""
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cats)])
    return (df.select(F.inline(items)).filter(F.col("value").isNotNull())
              .groupBy("c", "value").agg(F.count(F.lit(1)).alias("n")))


def fit(df: DataFrame, key: str | None = KEY_COL, target: str | None = TARGET_COL, nums: list[str] | None = None,
        cats: list[str] | None = None) -> SparseParams:
    """Parameters of ``df``.  ``nums`` and ``cats`` are told from the types unless given.  Positions: the
    numeric columns, then each column's values in ascending order.  A column without values has no features."""
    found_nums, found_cats, _ = column_kinds(df, key, target)
    nums, cats = found_nums if nums is None else nums, found_cats if cats is None else cats
    numeric = prepare.fit(df.select(*nums), key, target) if nums else prepare.PrepParams([], [], {}, {}, {}, {}, {})
    if not cats:
        empty = df.sparkSession.createDataFrame([], "column string, value string, n long, pos long")
        return SparseParams(numeric, [], {}, {}, empty)
    counts = written(category_counts(df, cats).orderBy("c", "value").withColumn("part", F.spark_partition_id()), "categories")
    per_column = counts.groupBy("c").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
                                         F.count(F.lit(1)).alias("size")).collect()
    parts = counts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    start, starts = len(numeric.num_cols), []
    for r in parts:
        starts.append((r["part"], start))
        start += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "part int, start long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("c", "value"))
    names = F.array(*[F.lit(c) for c in cats])
    index = counts.withColumn("rank", rank).join(offsets, "part").select(
        F.element_at(names, F.col("c") + 1).alias("column"), "value", "n", (F.col("start") + F.col("rank") - 1).alias("pos"))
    got = {cats[r["c"]]: r for r in per_column}
    kept = [c for c in cats if c in got]
    return SparseParams(numeric, kept, {c: got[c]["mode"] for c in kept}, {c: got[c]["size"] for c in kept},
                        written(index, "category-index"))


def _numeric_values(df: DataFrame, p: SparseParams, missing_numeric: str) -> list[Column]:
    return [prepare.numeric_expr(df.columns, c, p.numeric, missing_numeric) for c in p.num_cols]


def _looked_up(df: DataFrame, p: SparseParams, table: DataFrame, keep: list[str], missing_numeric: str) -> DataFrame:
    """``keep``, the numeric values ``_x<i>`` and, per categorical column, the index row of its value as ``_f<i>``
    (null where unseen)."""
    cols = df.columns
    values = [F.coalesce(F.col(c).cast("string"), F.lit(p.modes[c])) if c in cols else F.lit(p.modes[c]) for c in p.cat_cols]
    out = df.select(*keep, *[x.alias(f"_x{i}") for i, x in enumerate(_numeric_values(df, p, missing_numeric))],
                    *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    fields = [c for c in table.columns if c != "column"]
    for i, c in enumerate(p.cat_cols):
        side = table.filter(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.struct(*fields).alias(f"_f{i}"))
        out = out.join(side, f"_v{i}", "left")
    return out


def encode(df: DataFrame, p: SparseParams, keep: list[str], missing_numeric: str = "zero") -> DataFrame:
    """``keep`` and ``features``: (pos, value) pairs in order of position, zeros left out."""
    rows = _looked_up(df, p, p.index, keep, missing_numeric)
    pairs = [F.struct(F.lit(i).cast("long").alias("pos"), F.col(f"_x{i}").alias("value")) for i in range(len(p.num_cols))]
    pairs += [F.struct(F.col(f"_f{i}.pos").alias("pos"), F.lit(1.0).alias("value")) for i in range(len(p.cat_cols))]
    return rows.select(*keep, F.filter(F.array(*pairs).cast(FEATURES), lambda f: f["pos"].isNotNull() & (f["value"] != 0)).alias("features"))


def background(encoded: DataFrame) -> DataFrame:
    """(pos, background): every feature's mean over the rows of ``encoded``; one not seen there has no row."""
    n = encoded.count()
    return (encoded.select(F.inline("features")).groupBy("pos")
                   .agg((F.sum("value") / F.lit(float(max(n, 1)))).alias("background")))


def _feature_names(spark: SparkSession, p: SparseParams) -> DataFrame:
    named = p.index.select("pos", F.concat_ws("_", "column", "value").alias("feature"))
    nums = [(i, c) for i, c in enumerate(p.num_cols)]
    return named.unionByName(spark.createDataFrame(nums, "pos long, feature string"))


def model_of(table: DataFrame, name: str, p: SparseParams, means: DataFrame) -> SparseModel:
    """The model ``name`` of a (model, class, feature, coef) table, its features found in the index."""
    mine = table.filter(F.col("model") == name)
    icpt = {r["class"]: r["coef"] for r in mine.filter((F.col("feature") == "(intercept)") & (F.col("class") >= 0)).collect()}
    k = max(icpt) + 1
    by_class = [F.coalesce(F.max(F.when(F.col("class") == j, F.col("coef"))), F.lit(0.0)) for j in range(k)]
    coefs = (mine.filter((F.col("feature") != "(intercept)") & (F.col("class") >= 0))
                 .groupBy("feature").agg(F.array(*by_class).alias("coefs")))
    weights = (coefs.join(_feature_names(table.sparkSession, p), "feature").join(means, "pos", "left")
                    .select("pos", "coefs", F.coalesce("background", F.lit(0.0)).alias("background")))
    return SparseModel(name, [icpt.get(j, 0.0) for j in range(k)], written(weights, "sparse-weights"))


def fit_logistic(df: DataFrame, p: SparseParams, label: Column, C: float = 1.0, max_iter: int = 1000,
                 tol: float = 1e-4, name: str = "logistic") -> SparseModel:
    """G1 on sparse vectors: the same objective as ``models.fit_logistic``.  Spark ML's encoder turns a position
    within its column into a vector; the weights, features x classes numbers, pass through the driver as every
    Spark ML model does.  Rows without label are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    rows = _looked_up(df.withColumn("_label", label.cast("double")).filter(F.col("_label").isNotNull()), p, p.index,
                      ["_label"], "zero")
    at = []
    for i, c in enumerate(p.cat_cols):
        size = p.sizes[c]
        local = F.coalesce(F.col(f"_f{i}.pos") - p.first(c), F.lit(size)).cast("double")
        at.append(local.alias(f"_i{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": size}}))
    data = rows.select("_label", *[f"_x{i}" for i in range(len(p.num_cols))], *at)
    inputs = [f"_x{i}" for i in range(len(p.num_cols))]
    if p.cat_cols:
        ins, outs = [f"_i{i}" for i in range(len(p.cat_cols))], [f"_o{i}" for i in range(len(p.cat_cols))]
        data = OneHotEncoder(inputCols=ins, outputCols=outs, handleInvalid="keep", dropLast=True).fit(data).transform(data)
        inputs += outs
    data = VectorAssembler(inputCols=inputs, outputCol="_features").transform(data).select("_features", "_label")
    data = data.persist()
    n = data.count()
    fitted = LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial", elasticNetParam=0.0,
                                regParam=1.0 / (C * max(n, 1)), standardization=False, maxIter=max_iter, tol=tol).fit(data)
    data.unpersist()
    coefs = fitted.coefficientMatrix.toArray().T.tolist()
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(coefs)), "pos long, coefs array<double>")
    means = background(encode(df.filter(label.isNotNull()), p, []))
    weights = table.join(means, "pos", "left").select("pos", "coefs", F.coalesce("background", F.lit(0.0)).alias("background"))
    return SparseModel(name, fitted.interceptVector.toArray().tolist(), written(weights, "sparse-weights"))


def _weighted(df: DataFrame, p: SparseParams, model: SparseModel, keep: list[str], missing_numeric: str):
    """Rows with the weights of their categories, and the numeric columns' (coefs, background)."""
    table = p.index.join(model.weights, "pos").select("column", "value", "coefs", "background")
    numeric = {r["pos"]: (r["coefs"], r["background"])
               for r in model.weights.filter(F.col("pos") < len(p.num_cols)).collect()}
    return _looked_up(df, p, table, keep, missing_numeric), numeric, table


def score(df: DataFrame, p: SparseParams, model: SparseModel, keep: list[str], missing_numeric: str = "zero") -> DataFrame:
    """G3-G5 from weights by position: ``keep``, probabilities, predicted class, confidence."""
    rows, numeric, _ = _weighted(df, p, model, keep, missing_numeric)
    logits = []
    for k, b in enumerate(model.intercept):
        z = F.lit(float(b))
        for i, (coefs, _) in sorted(numeric.items()):
            z = z + F.lit(float(coefs[k])) * F.col(f"_x{i}")
        for i in range(len(p.cat_cols)):
            z = z + F.coalesce(F.col(f"_f{i}.coefs")[k], F.lit(0.0))
        logits.append(z)
    return models.score(rows, _Logits(logits), keep)


OTHERS = "(others)"


def phi(df: DataFrame, p: SparseParams, model: SparseModel, key: str, missing_numeric: str = "zero") -> DataFrame:
    """I1 in sparse form: (key, feature, class, value, phi).  Numeric features and the row's own categories have
    their contribution; the categories of a column that the row does not have are one row ``<column>_(others)``,
    the sum of theirs.  Over a row everything adds up to its logit less the base value.  Features without
    weights have no row of their own."""
    rows, numeric, table = _weighted(df, p, model, [key], missing_numeric)
    k_all = range(len(model.intercept))
    total = {r["column"]: r for r in table.groupBy("column").agg(
        *[F.sum(F.col("coefs")[k] * F.col("background")).alias(f"t{k}") for k in k_all]).collect()}

    def item(feature, k, value, contribution):
        return F.struct(feature.alias("feature"), F.lit(k).alias("class"), value.alias("value"), contribution.alias("phi"))

    items = []
    for k in k_all:
        for i, (coefs, mean) in sorted(numeric.items()):
            items.append(item(F.lit(p.num_cols[i]), k, F.col(f"_x{i}"), F.lit(float(coefs[k])) * (F.col(f"_x{i}") - F.lit(mean))))
        for i, c in enumerate(p.cat_cols):
            coef, mean = F.col(f"_f{i}.coefs")[k], F.col(f"_f{i}.background")
            own = item(F.concat(F.lit(f"{c}_"), F.col(f"_f{i}.value")), k, F.lit(1.0), coef * (F.lit(1.0) - mean))
            items.append(F.when(F.col(f"_f{i}").isNotNull(), own))
            rest = F.coalesce(coef * mean, F.lit(0.0)) - F.lit(float(total[c][f"t{k}"]) if c in total else 0.0)
            items.append(item(F.lit(f"{c}_{OTHERS}"), k, F.lit(0.0), rest))
    return rows.select(key, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
