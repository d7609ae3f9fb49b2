"""Feature preparation: fit parameter tables, transform with expressions.

Fitting runs aggregates over the whole input (medians, modes + category sets,
target counts, at once; then means + population stds of the imputed values);
the result is a small parameter object (bounded by the number of features and categories)
that is compiled into one ``select`` for transform, so scoring stays inside
whole-stage codegen and never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import KEY_COL, TARGET_COL
from ..sources.fixtures import label_expr
from .quantiles import exact_quantiles
from .schema import column_kinds


@dataclass
class PrepParams:
    num_cols: list[str]
    cat_cols: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]]
    dropped: list[str] = field(default_factory=list)       # B6 non-numeric, non-categorical
    all_null: list[str] = field(default_factory=list)      # E8 removed by the imputer
    target_counts: dict = field(default_factory=dict)      # target value -> rows (B5, split quotas)

    @property
    def feature_names(self) -> list[str]:
        names = list(self.num_cols)
        for c in self.cat_cols:
            names += [f"{c}_{v}" for v in self.categories[c]]
        return names

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The parameters as a table (persistable next to a model)."""
        rows = [(c, "numeric", self.medians[c], self.means[c], self.stds[c], None, None, None) for c in self.num_cols]
        rows += [(c, "categorical", None, None, None, self.modes[c], self.categories[c], None) for c in self.cat_cols]
        rows += [(c, kind, None, None, None, None, None, None) for kind, cs in (("dropped", self.dropped), ("all_null", self.all_null))
                 for c in cs]
        rows += [(v, "target", None, None, None, None, None, n) for v, n in self.target_counts.items()]
        return spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)],
            "position int, feature string, kind string, median double, mean double, std double, "
            "mode string, categories array<string>, rows long")

    @staticmethod
    def from_table(df: DataFrame) -> "PrepParams":
        """Rebuild from a saved parameter table (bounded size)."""
        rows = sorted(df.collect(), key=lambda r: r.position)
        nums = [r for r in rows if r.kind == "numeric"]
        cats = [r for r in rows if r.kind == "categorical"]
        return PrepParams(
            num_cols=[r.feature for r in nums], cat_cols=[r.feature for r in cats],
            medians={r.feature: r.median for r in nums}, means={r.feature: r.mean for r in nums},
            stds={r.feature: r.std for r in nums}, modes={r.feature: r.mode for r in cats},
            categories={r.feature: list(r.categories) for r in cats},
            dropped=[r.feature for r in rows if r.kind == "dropped"],
            all_null=[r.feature for r in rows if r.kind == "all_null"],
            target_counts={r.feature: r.rows for r in rows if r.kind == "target"})


def fit(df: DataFrame, key: str = KEY_COL, target: str = TARGET_COL, median: str = "exact",
        accuracy: int = 100_000) -> PrepParams:
    """E6 fit on all rows of ``df`` (the reference fits before the label filter).

    ``median="exact"`` finds the middle order statistics of a distributed
    sort; ``"approx"`` uses ``percentile_approx``, one pass without a sort.
    """
    nums, cats, dropped = column_kinds(df, key, target)

    def all_medians() -> dict:
        if median == "exact":
            return {c: v[0] for c, v in exact_quantiles(df, nums, [0.5]).items()}
        if not nums:
            return {}
        r = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(f"m{i}")
                     for i, c in enumerate(nums)]).collect()[0]
        return {c: r[f"m{i}"] for i, c in enumerate(nums)}

    # medians, categories and target counts do not depend on each other:
    # submit the jobs at once (Spark runs concurrent jobs from threads)
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=3) as pool:
        f1 = pool.submit(all_medians)
        f2 = pool.submit(lambda: _category_counts(df, cats))
        f3 = pool.submit(lambda: _target_counts(df, target))
        medians = f1.result()
        modes, categories = f2.result()
        target_counts = f3.result()
    all_null = [c for c in nums if medians[c] is None]
    nums = [c for c in nums if medians[c] is not None]
    cats_kept = [c for c in cats if modes.get(c) is not None]
    categories = {c: categories[c] for c in cats_kept}

    second = []
    for i, c in enumerate(nums):
        x = F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c])))
        second += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"d{i}")]
    r2 = df.agg(*second).collect()[0] if second else None
    means = {c: r2[f"a{i}"] for i, c in enumerate(nums)}
    stds = {c: r2[f"d{i}"] for i, c in enumerate(nums)}
    modes = {c: modes[c] for c in cats_kept}
    return PrepParams(nums, cats_kept, {c: medians[c] for c in nums}, means, stds, modes, categories,
                      dropped=dropped, all_null=all_null, target_counts=target_counts)


def _category_counts(df: DataFrame, cats: list[str]) -> tuple[dict, dict]:
    """E3 + E4 fit: one distributed (column, value) count table for all
    categoricals; mode = highest count, ties to the smallest value, found in
    Spark.  The driver gets one row per column: its mode and its sorted
    categories, which are the names of the one-hot columns."""
    if not cats:
        return {}, {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cats]))
    counts = (df.select(pairs.alias("p")).select("p.c", "p.v").filter(F.col("v").isNotNull())
                .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"),
                                   F.sort_array(F.collect_list("v")).alias("values")).collect()
    return {r["c"]: r["mode"] for r in rows}, {r["c"]: list(r["values"]) for r in rows}


def _target_counts(df: DataFrame, target: str) -> dict:
    """Rows per target value; a handful of rows."""
    if target not in df.columns:
        return {}
    g = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("t"))
    return {r["t"]: r["n"] for r in g.agg(F.count(F.lit(1)).alias("n")).collect()}


def numeric_expr(df_cols: list[str], c: str, p: PrepParams, missing_numeric: str = "zero") -> Column:
    """E1 + E2 (+ E7 absent column): impute, then (x - mean) / population std."""
    if c in df_cols:
        raw = F.col(c).cast("double")
    else:
        raw = F.lit(0.0 if missing_numeric == "zero" else float(p.medians[c]))
    imputed = F.coalesce(raw, F.lit(float(p.medians[c])))
    sd = p.stds[c]
    div = 1.0 if (sd is None or sd == 0.0) else float(sd)
    return (imputed - F.lit(float(p.means[c]))) / F.lit(div)


def onehot_exprs(df_cols: list[str], c: str, p: PrepParams) -> list[Column]:
    """E3 + E4: impute with the mode, then one indicator per fitted category
    (sorted; unseen value -> all zeros)."""
    v = F.col(c).cast("string") if c in df_cols else F.lit(p.modes[c])
    v = F.coalesce(v, F.lit(p.modes[c]))
    return [F.when(v == F.lit(cat), 1.0).otherwise(0.0).alias(f"{c}_{cat}") for cat in p.categories[c]]


def transform(df: DataFrame, p: PrepParams, key: str = KEY_COL, target: str | None = TARGET_COL,
              missing_numeric: str = "zero", as_float: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One projection producing key, the ordered features and the label.

    Absent numeric columns are filled with raw 0.0 before scaling (reference
    behaviour; ``missing_numeric="median"`` is the alternative); absent
    categoricals take the fitted mode; extra columns are ignored.
    """
    cols = df.columns
    feats = []
    for c in p.num_cols:
        feats.append(numeric_expr(cols, c, p, missing_numeric).alias(c))
    for c in p.cat_cols:
        feats += onehot_exprs(cols, c, p)
    if as_float:
        feats = [f.cast("float").alias(n) for f, n in zip(feats, p.feature_names)]
    out = [F.col(key)] if key in cols else []
    out += [F.col(c) for c in (keep or []) if c in cols]
    out += feats
    if target and target in cols:
        out.append(label_expr(target).alias("label"))
    return df.select(*out)


def known_labels(prepared: DataFrame) -> DataFrame:
    """C4: keep rows with a known label (statistics were fitted before this)."""
    return prepared.filter(F.col("label").isNotNull())
