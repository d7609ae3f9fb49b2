"""Exact quantiles of many columns at once, without one task per column.

Every column's distinct values are counted and sorted by a range partition
(one written table); partition totals, a few rows, tell in which partition a
wanted order statistic lies, and only those partitions get running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import written


def exact_quantiles(df: DataFrame, cols: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Per column the quantiles of its non-null values, linearly interpolated
    between the order statistics at floor and ceil of ``(n - 1) * p``; None
    for a column without values."""
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in cols}
    if not cols:
        return out
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.inline(items)).filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.orderBy("c", "v").withColumn("part", F.spark_partition_id()), "quantiles")
    parts = counts.groupBy("c", "part").agg(F.sum("n").alias("n")).orderBy("c", "part").collect()
    totals: dict[int, int] = {}
    for r in parts:
        totals[r["c"]] = totals.get(r["c"], 0) + r["n"]
    wanted = {(c, k) for c, n in totals.items() for p in probabilities
              for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    places, before, last = [], 0, None
    for r in parts:
        before = 0 if r["c"] != last else before
        last = r["c"]
        places += [(r["c"], r["part"], k, k - before) for c, k in wanted if c == r["c"] and before <= k < before + r["n"]]
        before += r["n"]
    if not places:
        return out
    asked = df.sparkSession.createDataFrame(places, "c int, part int, k long, at long")
    run = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v"))
    near = counts.join(asked.select("c", "part").distinct(), ["c", "part"], "left_semi").withColumn("upto", run)
    found = near.join(asked, ["c", "part"]).filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
    value = {(r["c"], r["k"]): r["v"] for r in found.select("c", "k", "v").collect()}
    for i, c in enumerate(cols):
        if i in totals:
            for j, p in enumerate(probabilities):
                at = (totals[i] - 1) * p
                lo, hi = math.floor(at), math.ceil(at)
                a, b = value[i, lo], value[i, hi]
                out[c][j] = a if a == b else (hi - at) * a + (at - lo) * b
    return out
