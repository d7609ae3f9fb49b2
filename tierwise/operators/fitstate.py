"""Mergeable fit state (E6): what preparation learns, as rows that add up.

``state_of`` reads a batch once and gives rows (kind, column, lo, value, n,
mean, m2, least, most):

* numeric: one row per bucket of values.  ``lo`` is the bucket's end next to
  zero; a power of two is cut into 64 buckets, so values of one bucket differ
  by at most 1/64 of ``lo``.  ``mean`` and ``m2`` (squared distances from the
  mean) are merged around the joint mean, so a small spread of large values
  keeps its digits.
* missing: null and non-finite values of a numeric column.
* category, target: one row per value.

States of batches are merged by rows of the same bucket, so the state of A and
the state of B make that of A and B together.  Counts, least and most values
are equal whatever the order, means and m2 up to rounding.  A median found from
a state lies between the least and the most value of the buckets that hold the
middle order statistics, so it is off by 1/64 of the exact one at most, and
exact where these hold one value; ``prepare.fit`` stays the exact way.

A numeric column has at most 64 buckets for each power of two and sign that
occurs; category rows stay a table.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import KEY_COL, TARGET_COL
from ..sources.store import exists, names
from .prepare import PrepParams
from .schema import column_kinds

BUCKETS = 64
KEYS = ["kind", "column", "lo", "value"]
SCHEMA = ("kind string, column string, lo double, value string, n long, mean double, m2 double, "
          "least double, most double")


def bucket(x: Column) -> Column:
    """The end next to zero of the bucket that holds ``x``; 0 for 0."""
    size = F.abs(x)
    octave = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(size))), F.lit(sys.float_info.min))
    lo = octave * (F.lit(1.0) + F.floor((size / octave - 1.0) * BUCKETS) / F.lit(float(BUCKETS)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * lo)


def state_of(df: DataFrame, key: str = KEY_COL, target: str = TARGET_COL, nums: list[str] | None = None,
             cats: list[str] | None = None) -> DataFrame:
    """The state of one batch: one scan and one shuffle of partial sums."""
    found_nums, found_cats, _ = column_kinds(df, key, target)
    nums, cats = found_nums if nums is None else nums, found_cats if cats is None else cats

    def item(kind: str, c: str, x: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), x.cast("double").alias("x"),
                        value.cast("string").alias("value"))

    none = F.lit(None)
    items = [item("numeric", c, F.col(c), none) for c in nums] + [item("category", c, none, F.col(c)) for c in cats]
    items += [item("target", target, none, F.col(target))] if target in df.columns else []
    if not items:
        return df.sparkSession.createDataFrame([], SCHEMA)
    number = F.col("kind") == "numeric"
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    x = F.when(finite, F.col("x"))
    rows = (df.select(F.inline(F.array(*items))).filter(number | F.col("value").isNotNull())
              .select(F.when(number & ~finite, "missing").otherwise(F.col("kind")).alias("kind"), "column",
                      bucket(x).alias("lo"), "value", x.alias("x")))
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"),
                                   (F.var_pop("x") * F.count("x")).alias("m2"),
                                   F.min("x").alias("least"), F.max("x").alias("most"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all batches together: one shuffle, at most one row a batch and bucket."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return _around_joint_mean(union, KEYS).groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.max("joint").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("joint")) * (F.col("mean") - F.col("joint"))).alias("m2"),
        F.min("least").alias("least"), F.max("most").alias("most"))


def _around_joint_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``joint``, the mean of the rows' means by their n, summed up from the smallest of them.  Rows
    without mean (missing values, texts) don't count."""
    w = Window.partitionBy(*keys)
    n = F.when(F.col("mean").isNotNull(), F.col("n"))
    start = F.min("mean").over(w)
    return rows.withColumn("joint", start + F.sum((F.col("mean") - start) * n).over(w) / F.sum(n).over(w))


def medians(state: DataFrame) -> DataFrame:
    """(column, median, median_low, median_high) per numeric column with values; the exact median lies between
    the two bounds.  A window per column orders its buckets, whose number is bounded."""
    w = Window.partitionBy("column")
    run = (state.filter(F.col("kind") == "numeric").withColumn("total", F.sum("n").over(w))
                .withColumn("upto", F.sum("n").over(w.orderBy("lo"))))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)

    def at(place: Column, c: str) -> Column:
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col(c)))

    ends = run.groupBy("column").agg(at(low, "least").alias("a"), at(low, "most").alias("b"),
                                     at(high, "least").alias("c"), at(high, "most").alias("d"))
    return ends.select("column", ((F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4).alias("median"),
                       ((F.col("a") + F.col("c")) / 2).alias("median_low"), ((F.col("b") + F.col("d")) / 2).alias("median_high"))


def moments(state: DataFrame) -> DataFrame:
    """(column, n, missing, mean, std) of the values as they are, one row per numeric column."""
    number = F.col("kind") == "numeric"
    rows = _around_joint_mean(state.filter(F.col("kind").isin("numeric", "missing")), ["column"])
    off = F.col("mean") - F.col("joint")
    sums = rows.groupBy("column").agg(
        F.coalesce(F.sum(F.when(number, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~number, F.col("n"))), F.lit(0)).alias("missing"),
        F.max("joint").alias("mean"), F.sum(F.when(number, F.col("m2") + F.col("n") * off * off)).alias("squares"))
    return sums.select("column", "n", "missing", "mean", F.when(F.col("n") > 0, F.sqrt(F.col("squares") / F.col("n"))).alias("std"))


def params(state: DataFrame, columns: list[str]) -> PrepParams:
    """Preparation parameters from a state, columns in the order of ``columns``.  Means and deviations are those
    of the values with the state's median in the place of missing ones.  Categories pass through the driver, as
    in ``prepare``."""
    stats = {r["column"]: r for r in moments(state).join(medians(state), "column", "left").collect()}
    values = state.filter(F.col("kind") == "category").groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.sort_array(F.collect_list("value")).alias("values")).collect()
    cats = {r["column"]: r for r in values}
    out = PrepParams([], [], {}, {}, {}, {}, {})
    for c in columns:
        if c in cats:
            out.cat_cols.append(c)
            out.modes[c], out.categories[c] = cats[c]["mode"], list(cats[c]["values"])
        elif c in stats and stats[c]["n"] == 0:
            out.all_null.append(c)
        elif c in stats:
            r = stats[c]
            rows, gap = r["n"] + r["missing"], r["median"] - r["mean"]
            share = r["missing"] / rows
            out.num_cols.append(c)
            out.medians[c], out.means[c] = r["median"], r["mean"] + share * gap
            out.stds[c] = ((1 - share) * r["std"] ** 2 + share * (1 - share) * gap * gap) ** 0.5
    out.target_counts = {r["value"]: r["n"] for r in state.filter(F.col("kind") == "target").collect()}
    return out


class FitStore:
    """States of batches under a path.  A batch counts once its folder has Spark's success mark; adding a batch
    that counts already changes nothing, one cut off half way is written anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch: str, df: DataFrame, **columns) -> bool:
        """Whether the batch was new."""
        place = f"{self.path}/batch={batch}"
        if exists(self.spark, f"{place}/_SUCCESS"):
            return False
        state_of(df, **columns).write.mode("overwrite").parquet(place)
        return True

    def state(self) -> DataFrame:
        """The state of all batches that count."""
        done = [b for b in names(self.spark, self.path) if exists(self.spark, f"{self.path}/{b}/_SUCCESS")]
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        return merge_states(self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{b}" for b in done]))
