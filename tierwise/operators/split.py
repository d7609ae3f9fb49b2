"""Exact stratified sampling and splitting.

Row order inside a stratum is ``(md5(key|salt), hash of the whole row)``; a
null key hashes like an empty one.  Selecting the first ``q`` rows of each
stratum is done without a per-stratum window over all rows (which would put a
whole class, maybe a third of the data, in one task):

1. histogram of rows per (stratum, 16-bit hash prefix) - a partial aggregate;
2. cumulative counts over that table give, per bucket, "all selected", "none
   selected" or "boundary";
3. the rows of boundary buckets (about n / 65536 per stratum) get a second
   histogram, by key hash and 16 bits of the row hash, so that the many rows
   of a repeated key are spread as well;
4. only rows in boundary cells of the second one are ranked.

Quotas follow the largest-remainder rule over class counts (ties to the
lower class id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import written
from ..constants import SPLIT_SEED, TEST_PCT

PREFIX_HEX = 4                      # 16-bit buckets


def allocate(counts: dict, n_draw: int) -> dict:
    """Largest-remainder allocation of ``n_draw`` over strata counts."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (c * n_draw) // n for k, c in counts.items()}
    rem = {k: c * n_draw - base[k] * n for k, c in counts.items()}
    extra = n_draw - sum(base.values())
    order = sorted(counts, key=lambda k: (-rem[k], k))
    for k in order[:extra]:
        base[k] += 1
    return base


def order_hash(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|" + salt)))


def _settled(rows: DataFrame, stratum: str, cell: list[str], need: str, flag: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` at cell level: those whose cell is wholly in or out, with
    ``flag`` set, and those in boundary cells with ``_left``, how many of the
    cell's rows are still to be taken.  ``need`` (rows to take of a stratum) is
    the same for all rows of a stratum.  The cell table is written, so the
    optimizer broadcasts it only if it is small."""
    w = Window.partitionBy(stratum).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(stratum, *cell).agg(F.count(F.lit(1)).alias("_cnt"), F.max(need).alias("_q"))
    cells = cells.select(stratum, *cell, "_cnt", (F.col("_q") - F.coalesce(F.sum("_cnt").over(w), F.lit(0))).alias("_left"))
    cells = written(cells, name).withColumnRenamed(stratum, "_stratum")
    on = rows[stratum].eqNullSafe(cells["_stratum"])
    for c in cell:
        on = on & (rows[c] == cells[c])
    j = rows.join(cells, on).drop(cells["_stratum"], *[cells[c] for c in cell])
    whole = (F.col("_left") <= 0) | (F.col("_left") >= F.col("_cnt"))
    done = j.filter(whole).withColumn(flag, F.col("_left") >= F.col("_cnt")).drop("_cnt", "_left", need)
    return done, j.filter(~whole).drop("_cnt", need)


def first_k_per_stratum(df: DataFrame, key: str, stratum: str, quotas: dict, salt: str,
                        flag: str = "_first") -> DataFrame:
    """Add boolean ``flag``: row is among the first ``quotas[s]`` rows of its
    stratum in hash order.  Exact, every row comes out once (null strata with
    ``false``, as they have no quota), and no stratum and no repeated key is
    gathered into a single task."""
    quota = F.lit(0).cast("long")
    for value, q in quotas.items():
        quota = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(int(q)).cast("long")).otherwise(quota)
    content = F.xxhash64(*[F.col(f.name) if f.dataType.simpleString().find("map<") < 0 else F.to_json(f.name)
                           for f in df.schema.fields])
    h = df.withColumns({"_h": order_hash(key, salt), "_row": content, "_need": quota})
    h = h.withColumn("_b", F.conv(F.substring("_h", 1, PREFIX_HEX), 16, 10).cast("int"))
    done, rest = _settled(h, stratum, ["_b"], "_need", flag, "split-buckets")
    rest = rest.withColumn("_part", F.shiftrightunsigned("_row", 48)).withColumnRenamed("_left", "_need")
    finer, rest = _settled(rest, stratum, ["_h", "_part"], "_need", flag, "split-cells")
    rank = F.row_number().over(Window.partitionBy(stratum, "_h", "_part").orderBy("_row"))
    rest = rest.withColumn(flag, rank <= F.col("_left"))
    out = [x.select(*df.columns, flag) for x in (done, finer, rest)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """Counts per stratum; bounded by the number of classes."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def split_quotas(counts: dict, test_pct: int = TEST_PCT) -> dict:
    """Test quota per class: n_test = ceil(n * pct / 100); the train quota is
    allocated first (as the reference's splitter does), test = rest."""
    n = sum(counts.values())
    n_test = (n * test_pct + 99) // 100
    train = allocate(counts, n - n_test)
    return {k: counts[k] - train[k] for k in counts}


def stratified_split(df: DataFrame, key: str, label: str = "label", test_pct: int = TEST_PCT,
                     seed: int = SPLIT_SEED, counts: dict | None = None) -> DataFrame:
    """add ``split`` = 'test' / 'train' (one lineage, not two).
    ``counts`` (rows per class) may come from an earlier aggregate."""
    q = split_quotas(counts if counts else class_counts(df, label), test_pct)
    out = first_k_per_stratum(df, key, label, q, f"split{seed}", "_test")
    return out.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def sample_quotas(counts: dict, pct: int) -> dict:
    n = sum(counts.values())
    return allocate(counts, (n * pct) // 100)


def stratified_sample(df: DataFrame, key: str, label: str = "label", pct: int = 25,
                      seed: int = SPLIT_SEED) -> DataFrame:
    """exact-size stratified subsample, n = trunc(N * pct / 100); 100 = all."""
    if pct >= 100:
        return df
    q = sample_quotas(class_counts(df, label), pct)
    out = first_k_per_stratum(df, key, label, q, f"sample{seed}", "_in")
    return out.filter("_in").drop("_in")


def split_balance(split_df: DataFrame, label: str = "label") -> DataFrame:
    """count and percent per (split, class) plus the overall split."""
    counts = split_df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    overall = split_df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.lit("all"))
    both = counts.unionByName(overall)
    w = Window.partitionBy("split")
    return both.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(w))
