"""Joins: key merge (D1, D2), positional merge (D3), attribute recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import written
from .schema import find_common_key

_MID_BITS = 33  # monotonically_increasing_id keeps the row-in-partition in the low 33 bits
MOST_CELLS = 1024  # cells of one hot key's pairs, unless its sides differ more than that
BLOCK_ROWS = 256  # rows of one side of a hot key that move as one
LOT_BLOCKS = 16  # blocks that are cut from rows collected together, about
_CUTS = ["__cut___na", "__cut___nb"]


def merge(a: DataFrame, b: DataFrame, key: tuple[str, str] | None = None,
          null_safe: bool = True, suffixes: tuple[str, str] = ("_int", "_ext"), hot_rows: int | None = None) -> DataFrame:
    """D1 + D2: inner equi-join on the detected (or given) key.

    Overlapping non-key columns (case-insensitive) get suffixes; the right key
    is dropped.  ``null_safe`` reproduces pandas' null-matches-null merge, which
    makes every pair of rows without key; ``merge_size`` tells how many that is.
    Catalyst/AQE choose broadcast vs sort-merge and split skewed partitions.
    With ``hot_rows``, keys that would make more output rows than that are
    dealt out (``spread``), so no task holds one key's pairs alone.
    """
    ka, kb = key if key else find_common_key(a.columns, b.columns)
    if ka is None:
        raise ValueError("no common key column; use merge_positional with explicit order columns")
    a_low = {c.lower() for c in a.columns if c != ka}
    b_low = {c.lower() for c in b.columns if c != kb}
    both = (a_low & b_low) - {ka.lower()}
    left = a.select(*[F.col(c).alias(c + suffixes[0]) if c.lower() in both else F.col(c) for c in a.columns])
    rk = "__right_key"
    right = b.select(*[F.col(c).alias(rk) if c == kb else
                       (F.col(c).alias(c + suffixes[1]) if c.lower() in both else F.col(c))
                       for c in b.columns if not (c.lower() == ka.lower() and c != kb)])
    if hot_rows is not None:
        return spread(left, right, ka, rk, null_safe, hot_rows).drop(rk)
    cond = left[ka].eqNullSafe(right[rk]) if null_safe else left[ka] == right[rk]
    return left.join(right, cond, "inner").drop(rk)


def key_counts(a: DataFrame, b: DataFrame, ka: str, kb: str) -> DataFrame:
    """Rows of each side per key (``__k``, na, nb; a null key is a key here), counted before any join."""
    each = [df.groupBy(F.col(k).alias("__k")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(i))
            for i, (df, k) in enumerate(((a, ka), (b, kb)))]
    both = each[0].unionByName(each[1]).groupBy("__k")
    return both.agg(*[F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).alias(n) for i, n in enumerate(("na", "nb"))])


def merge_size(a: DataFrame, b: DataFrame, key: tuple[str, str] | None = None) -> DataFrame:
    """One row, before anything is merged: how many rows the merge makes, how many its largest key, and how many
    pairs of rows without key there are (made only by ``null_safe``)."""
    ka, kb = key if key else find_common_key(a.columns, b.columns)
    pairs, known = F.col("na") * F.col("nb"), F.col("__k").isNotNull()
    return key_counts(a, b, ka, kb).agg(
        F.coalesce(F.sum(F.when(known, pairs)), F.lit(0)).alias("n_rows"), F.coalesce(F.max(F.when(known, pairs)), F.lit(0)).alias("largest_key"),
        F.coalesce(F.sum(F.when(~known, pairs)), F.lit(0)).alias("null_pairs"))


def grid(large: Column, small: Column, hot_rows: int) -> tuple[Column, Column]:
    """Into how many parts ``spread`` cuts the larger and the smaller side of a key with so many rows each."""
    cells = F.least(F.ceil(large * small / hot_rows), F.greatest(F.lit(MOST_CELLS), F.floor(large / small)))
    cuts_small = F.least(small, F.greatest(F.lit(1), F.round(F.sqrt(cells * small / large)))).cast("int")
    return F.least(large, F.ceil(cells / cuts_small)).cast("int"), cuts_small


def spread(left: DataFrame, right: DataFrame, ka: str, kb: str, null_safe: bool, hot_rows: int) -> DataFrame:
    """The equi-join with hot keys dealt out: a key that makes more than ``hot_rows`` output rows is cut into a grid of
    cells, as many as keep each below that, yet no more than ``MOST_CELLS`` or the sides' ratio, so that the repeats
    grow with the rows and not with the pairs.  A row gets one of its own side's cuts, by a hash of the row; the rows of
    a cut are packed into blocks of ``BLOCK_ROWS``, and a block is repeated for every cut of the other side.  Of two blocks
    that meet, each row of the left one is followed through all rows of the right one, so a value comes back within a page
    of a written file; row by row against a whole cell it does not, and the result takes several times the disk.  All other
    keys are joined as they are.  The list of hot keys has at most output rows / ``hot_rows`` entries; Spark broadcasts it only if
    it is small."""
    counts = key_counts(left, right, ka, kb).filter((F.col("na") * F.col("nb") > hot_rows) & (F.col("__k").isNotNull() | F.lit(null_safe)))
    na, nb = F.col("na"), F.col("nb")
    cuts_large, cuts_small = grid(F.greatest(na, nb), F.least(na, nb), hot_rows)
    hot = written(counts.select(F.col("__k").alias("__hk"), F.monotonically_increasing_id().alias("__hot"), na.alias("__rows_na"), nb.alias("__rows_nb"),
                                F.when(na >= nb, cuts_large).otherwise(cuts_small).alias("__na"),
                                F.when(na >= nb, cuts_small).otherwise(cuts_large).alias("__nb")), "hot-keys")
    deals = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def is_hot(df: DataFrame, k: str) -> Column:
        return df[k].eqNullSafe(hot["__hk"]) if null_safe else df[k] == hot["__hk"]

    def blocks(df: DataFrame, k: str, own: str, other: str) -> DataFrame:
        at = df.join(hot, is_hot(df, k))
        lots = F.col(own) * F.ceil(F.col(f"__rows{own[1:]}") / (F.col(own) * LOT_BLOCKS * BLOCK_ROWS))
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id())
        at = at.select("__hot", own, other, F.pmod(row, lots).alias("__lot"),  # one a row, before it is repeated
                       F.struct(*[F.col(f"`{c}`").alias(f"{own}{i}") for i, c in enumerate(df.columns)]).alias("__row"))
        at = at.groupBy("__hot", own, other, "__lot").agg(F.collect_list("__row").alias("__lot_rows"))
        starts = F.sequence(F.lit(1), F.size("__lot_rows"), F.lit(BLOCK_ROWS))
        at = at.select("__hot", F.pmod("__lot", own).cast("int").alias(f"__cut_{own}"), other,
                       F.explode(F.transform(starts, lambda i: F.slice("__lot_rows", i, BLOCK_ROWS))).alias(f"__block_{own}"))
        at = at.withColumn(f"__cut_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(other)
        return at.repartition(deals, "__hot", *_CUTS)  # by number: few bytes make many rows, so these are not to be put together

    met = blocks(left, ka, "__na", "__nb").join(blocks(right, kb, "__nb", "__na"), ["__hot", *_CUTS])
    # the lambda keeps this step out of generated code, which would hold all rows that a block of the left side makes at once
    met = met.select(F.inline(F.transform("__block___na", lambda row: row)), "__block___nb")
    met = met.select(*met.columns[:-1], F.inline("__block___nb"))
    met = met.toDF(*left.columns, *right.columns)
    l, r = left.join(hot, is_hot(left, ka), "left_anti"), right.join(hot, is_hot(right, kb), "left_anti")
    return l.join(r, l[ka].eqNullSafe(r[kb]) if null_safe else l[ka] == r[kb]).union(met)


def with_row_index(df: DataFrame, order_cols: list[str], name: str = "_pos") -> DataFrame:
    """0-based position of each row in ``order_cols`` order, computed without a
    single-partition window: a distributed sort, then per-partition offsets
    (one row per partition) added to the in-partition id.

    The sorted rows are written once and both the rows and the partition
    sizes come from that table; evaluated twice, the sort could cut its
    partitions at different places.  Ties in ``order_cols`` get some order,
    the same for every reader.
    """
    s = written(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "positions")
    s = s.withColumn("_pid", F.shiftright(F.col("_mid"), _MID_BITS)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << _MID_BITS) - 1)))
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off")), "offsets")
    return (s.join(offsets, "_pid")
             .withColumn(name, F.col("_off") + F.col("_row"))
             .drop("_mid", "_pid", "_row", "_off"))


def merge_positional(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """D3: side-by-side merge by row position when no key is shared.

    Spark rows have no position, so the caller names the order on each side.
    Row counts must match (B4), like the reference."""
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError("No common ID column and row counts differ. Cannot safely merge.")
    ia = with_row_index(a, order_a)
    ib = with_row_index(b, order_b)
    return ia.join(ib, "_pos", "inner").drop("_pos")


def one_row_a_key(external: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """Attributes by key (``__k``), one row each: of rows that repeat a key the least by ``attrs`` in order, nulls
    first.  Rows without key are left out."""
    least = external.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*attrs)).alias("__a"))
    return least.select("__k", *[F.col("__a")[c].alias(c) for c in attrs])


def attach_attributes(pred: DataFrame, external: DataFrame, key_pred: str, key_ext: str,
                      attrs: list[str]) -> DataFrame:
    """Re-attach sensitive attributes by key.  Every prediction stays one row: repeated keys of ``external`` are
    one row (``one_row_a_key``) and a null key attaches nothing; there is no positional fallback."""
    present = [c for c in attrs if c in external.columns]
    if not present:
        return pred
    side = one_row_a_key(external, key_ext, present)
    return pred.join(side, pred[key_pred] == side["__k"], "left").drop("__k")
