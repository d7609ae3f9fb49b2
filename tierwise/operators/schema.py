"""Schema inspection and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CATEGORICAL_COLS, TARGET_COL, TIER_CODES

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def find_common_key(a_cols: list[str], b_cols: list[str]) -> tuple[str | None, str | None]:
    """B1: the first column of A whose name, in any case, B has too; with B's spelling."""
    named = {c.lower(): c for c in reversed(b_cols)}
    return next(((c, named[c.lower()]) for c in a_cols if c.lower() in named), (None, None))


def key_quality(a: DataFrame, b: DataFrame) -> DataFrame:
    """B1: the detected key and how well it serves, one row: per side rows,
    null keys, distinct keys and whether the key is unique; and how many
    distinct keys both sides have.  Null columns if no key is shared."""
    ka, kb = find_common_key(a.columns, b.columns)
    names = ["rows", "nulls", "distinct"]
    if ka is None:
        empty = [F.lit(None).cast("long").alias(f"{n}_{side}") for side in ("left", "right") for n in names]
        return a.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("key_left"), F.lit(None).cast("string").alias("key_right"), *empty,
            F.lit(None).cast("long").alias("matched"), *[F.lit(None).cast("boolean").alias(f"unique_{s}") for s in ("left", "right")])
    sides = [df.groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s))
             for df, k, s in ((a, ka, 0), (b, kb, 1))]
    keys = sides[0].unionByName(sides[1]).groupBy("k").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n{s}") for s in (0, 1)])
    known = F.col("k").isNotNull()
    aggs = []
    for s, side in enumerate(("left", "right")):
        n = F.col(f"n{s}")
        aggs += [F.coalesce(F.sum(n), F.lit(0)).alias(f"rows_{side}"),
                 F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias(f"nulls_{side}"),
                 F.count_if(known & (n > 0)).alias(f"distinct_{side}"), F.max(F.when(known, n)).alias(f"most_{side}")]
    both = keys.agg(*aggs, F.count_if(known & (F.col("n0") > 0) & (F.col("n1") > 0)).alias("matched"))
    return both.select(F.lit(ka).alias("key_left"), F.lit(kb).alias("key_right"),
                       *[f"{n}_{side}" for side in ("left", "right") for n in names], "matched",
                       *[(F.coalesce(F.col(f"most_{s}"), F.lit(0)) <= 1).alias(f"unique_{s}") for s in ("left", "right")])


def require_target(df: DataFrame, target: str = TARGET_COL) -> None:
    if target not in df.columns:
        raise ValueError(f"Target column `{target}` not found.")


def column_kinds(df: DataFrame, key: str | None, target: str = TARGET_COL,
                 categorical: list[str] = CATEGORICAL_COLS) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, dropped) by schema; key and target excluded."""
    skip = {c for c in (key, target) if c}
    cats = [c for c in categorical if c in df.columns and c not in skip]
    nums, dropped = [], []
    for f in df.schema.fields:
        if f.name in skip or f.name in cats:
            continue
        if isinstance(f.dataType, NUMERIC_TYPES):
            nums.append(f.name)
        else:
            dropped.append(f.name)
    return nums, cats, dropped


def column_kinds_table(spark: SparkSession, df: DataFrame, key: str | None,
                       target: str = TARGET_COL) -> DataFrame:
    """B6 with what the rows say: nulls and distinct values per column.  The
    columns are unpivoted and counted by value, so no column is one task."""
    nums, cats, dropped = column_kinds(df, key, target)
    order = {c: i for i, c in enumerate(df.columns)}
    rows = ([(c, "numeric", order[c]) for c in nums] + [(c, "categorical", order[c]) for c in cats]
            + [(c, "dropped", order[c]) for c in dropped])
    kinds = spark.createDataFrame(rows, "column_name string, kind string, position int")
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c, _, _ in rows])
    values = df.select(F.inline(items)).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    facts = values.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("v").alias("n_distinct"))
    return kinds.join(facts, "column_name")


def shape(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """Rows, columns and distinct target values in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols")]
    if target in df.columns:
        aggs.append(F.count_distinct(F.col(target)).alias("n_classes"))
    return df.agg(*aggs)


def same_row_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of both inputs and whether they match (one job)."""
    nb = b.agg(F.count(F.lit(1))).scalar()          # scalar subquery, no join
    return (a.agg(F.count(F.lit(1)).alias("rows_left")).withColumn("rows_right", nb)
             .withColumn("counts_match", F.col("rows_left") == F.col("rows_right")))


def tier_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(TIER_CODES)], "tier string, label int")


def unknown_labels(spark: SparkSession, df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """Target values outside P1..P4 (null included) with their counts.

    Grouped first (partial aggregation), then anti-joined to the 4-row tier
    dimension (broadcast: fixed size)."""
    counts = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dim = F.broadcast(tier_dim(spark).select(F.col("tier").alias("value")))
    return counts.join(dim, "value", "left_anti")


def contract_differences(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """A table against a typed contract of (column, kind), kinds being int, number and text.  One row per
    column in question: ``problem`` is ``missing`` (no such column, letter case aside), ``type`` (another type),
    ``values`` (text that is no number, or a fraction where an int is due), ``extra`` (not in the contract) or null
    where all is well; ``n_null`` and ``n_bad`` count over all rows, in one aggregate.  Names of ``df`` that differ
    in letter case only are taken by their first."""
    fields = {}
    for f in df.schema.fields:
        fields.setdefault(f.name.lower(), f)
    due = {c.lower(): kind for c, kind in contract}
    rows = [(c, kind, fields.get(c.lower())) for c, kind in contract]
    rows += [(f.name, None, f) for low, f in fields.items() if low not in due]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (_, kind, f) in enumerate(rows):
        if f is None:
            continue
        x = F.col("`" + f.name.replace("`", "``") + "`")
        number = x.cast("double") if isinstance(f.dataType, NUMERIC_TYPES) else x.cast("string").try_cast("double")
        bad = number.isNull() | ((number != F.floor(number)) if kind == "int" else F.lit(False))
        aggs += [F.count(x).alias(f"n{i}"),
                 (F.count_if(x.isNotNull() & bad) if kind in ("int", "number") else F.lit(0).cast("long")).alias(f"b{i}")]

    def item(i: int, c: str, kind: str | None, f) -> Column:
        if f is None:
            found, problem, nulls, bad = F.lit(None).cast("string"), F.lit("missing"), F.lit(None).cast("long"), F.lit(None).cast("long")
        else:
            numeric = isinstance(f.dataType, NUMERIC_TYPES)
            fits = isinstance(f.dataType, T.StringType) if kind == "text" else numeric
            found, nulls, bad = F.lit(f.dataType.simpleString()), F.col("rows") - F.col(f"n{i}"), F.col(f"b{i}")
            problem = (F.lit("extra") if kind is None else F.when(bad > 0, "values").otherwise(F.lit(None if fits else "type")))
        return F.struct(F.lit(c).alias("column_name"), F.lit(kind).cast("string").alias("expected"), found.alias("found"),
                        problem.cast("string").alias("problem"), nulls.alias("n_null"), bad.alias("n_bad"))

    return df.agg(*aggs).select(F.inline(F.array(*[item(i, *r) for i, r in enumerate(rows)])))
