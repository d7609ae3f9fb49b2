"""Exact top-k search by distributed histogram selection.

Vectors become whole numbers, floor(scale * x), so scores are exact inner products. Queries and candidates are packed
into blocks; each query block meets each cell of candidate blocks by an equi-join on (block, cell). Nothing is kept of
the scores but histograms: a round scores everything, counts the scores within each query's current range in 256 bins,
adds the counts up over all tasks, and narrows each range to the bin that holds the query's kth score. Once a range is
one value wide, a last pass keeps the scores above it and, of those equal to it, the smallest ids that are still needed.

Scale: a block of queries is scored against a cell of candidates in one task, so memory is bounded by block sizes. A
task reports a bin only until its own counts reach the number needed, so what is added up does not grow with a block.
Equal vectors of any number only make counts larger: ties are cut within each task before they are exchanged.

Defined results: a null vector, or one with a null or non-finite component, takes no part, nor does a row without id,
which no result could name. Vectors of another length than the query's are no candidates of it. A candidate with the
query's own id is left out; rows that repeat a query's id are answered each. Ties go to the smaller id, repeated
candidates rank one after the other. Fewer than k candidates are all returned; an empty table gives no row. An inner
product that may not fit 64 bits is an error, as Spark's own arithmetic would have it. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base

SCALE = 256
K = 5
EVERY = 50
BITS = 8                # of a score that a round finds: 256 bins
QUERIES, ROWS = 4096, 8192  # vectors in a block of queries, of candidates
CELL = 65_536           # candidates in a cell, at most about as many
TILE = 1 << 22          # scores held at once
PACK = "block long, dim int, n int, top long, reach long, ids binary, vectors binary"
COUNTS = "block long, place int, bin int, n long"
HITS = "block long, place int, query_id long, vec_id long, score long"


def _pack(rows: DataFrame, scale: float, most: int) -> DataFrame:
    """Blocks of at most ``most`` vectors of one length: their ids, whole components, greatest size of a component
    (top) and greatest sum of sizes of a vector's components (reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            whole = np.floor(values * scale)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            sizes = np.diff(offsets)
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) \
                & ids.is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[good]):
                rows_ = np.flatnonzero(good & (sizes == dim))
                for lo in range(0, len(rows_), most):
                    part = rows_[lo:lo + most]
                    v = whole[offsets[part][:, None] + np.arange(dim)]
                    if np.abs(v).max(initial=0) * max(1, int(dim)) >= 2.0 ** 62:
                        raise ArithmeticError("a vector's components are too large for 64-bit scores")
                    v = v.astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "block": [block], "dim": pa.array([int(dim)], pa.int32()), "n": pa.array([len(part)], pa.int32()),
                        "top": [int(np.abs(v).max(initial=0))], "reach": [int(np.abs(v).sum(axis=1).max(initial=0))],
                        "ids": [ids.take(pa.array(part)).to_numpy().astype("<i8").tobytes()],
                        "vectors": [v.astype("<i8").tobytes()]})
                    block += 1

    return rows.mapInArrow(run, PACK)


def _meet(candidates: DataFrame, queries: DataFrame, state: DataFrame, parts: int, cells: int) -> DataFrame:
    """Each candidate block beside each query block of its cell and vector length, with the queries' state."""
    q = queries.join(state, "block").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = candidates.select(F.col("dim"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), "top",
                          F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell"),
                          F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return c.join(q.drop("top").hint("merge"), ["part", "cell", "dim"]).select(
        "block", "dim", "top", "reach", "ids", "vectors", "los", "needs", "c_ids", "c_vectors")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, first place, query ids, lows, numbers needed, candidate ids, scores, whether a score counts) by tiles."""
    for batch in batches:
        for r in range(batch.num_rows):
            block, dim, top, reach, ids, vectors = (c[r].as_py() for c in batch.columns[:6])
            los, needs = (c[r].values.to_numpy() for c in batch.columns[6:8])
            c_ids, c_vectors = (c[r].as_py() for c in batch.columns[8:])
            bound = top * reach
            if bound >= 1 << 62:
                raise ArithmeticError("inner products may not fit 64 bits")
            kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
            ids, c_ids = np.frombuffer(ids, "<i8"), np.frombuffer(c_ids, "<i8")
            q = np.frombuffer(vectors, "<i8").reshape(len(ids), dim).astype(kind)
            c = np.ascontiguousarray(np.frombuffer(c_vectors, "<i8").reshape(len(c_ids), dim).astype(kind).T)
            step = max(1, TILE // ROWS)
            for lo in range(0, len(ids), step):
                own = np.flatnonzero(np.isin(c_ids, ids[lo:lo + step]))
                counts = None
                if len(own):
                    counts = np.ones((len(ids[lo:lo + step]), len(c_ids)), bool)
                    counts[:, own] = ids[lo:lo + step, None] != c_ids[None, own]
                yield (block, lo, ids[lo:lo + step], los[lo:lo + step], needs[lo:lo + step], c_ids,
                       (q[lo:lo + step] @ c).astype(np.int64), counts)


def _counts(shift: int):
    """Histogram rows of a round: scores from a query's low on, in bins of 2^shift; a higher bin counts as none."""
    bins = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        now = None
        for block, first, ids, los, needs, _, scores, counts in _scored(batches):
            if block != now:
                yield from flush(held)
                now = block
            at = (scores - los[:, None]) >> shift
            inside = (at >= 0) & (at < bins)
            if counts is not None:
                inside &= counts
            rows, cols = np.nonzero(inside)
            h = np.bincount(rows * bins + at[rows, cols], minlength=len(ids) * bins).reshape(len(ids), bins)
            if (block, first) in held:
                h += held[block, first][0]
            held[block, first] = (h, needs)
        yield from flush(held)

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (block, first), (h, needs) in held.items():
            above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h
            rows, cols = np.nonzero((h > 0) & (above < needs[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), block, np.int64)), pa.array((rows + first).astype(np.int32)),
                 pa.array(cols.astype(np.int32)), pa.array(h[rows, cols].astype(np.int64))],
                names=["block", "place", "bin", "n"])
        held.clear()

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores above a query's kth, and of those equal to it the smallest ids needed."""
    for block, first, ids, los, needs, c_ids, scores, counts in _scored(batches):
        order = np.argsort(c_ids, kind="stable")
        scores = scores[:, order]
        above, ties = scores > los[:, None], scores == los[:, None]
        if counts is not None:
            above, ties = above & counts[:, order], ties & counts[:, order]
        ties &= np.cumsum(ties, axis=1) <= needs[:, None]
        rows, cols = np.nonzero(above | ties)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), block, np.int64)), pa.array((rows + first).astype(np.int32)),
             pa.array(ids[rows]), pa.array(c_ids[order][cols]), pa.array(scores[rows, cols])],
            names=["block", "place", "query_id", "vec_id", "score"])


def search(rows: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all ``rows`` (vec_id, embedding) for each row that ``is_query``
    marks, by the inner product of floor(scale * embedding)."""
    spark = rows.sparkSession
    taken = F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    candidates = _base.stored(_pack(rows.select(*taken), scale, ROWS), "topk-candidates")
    total = candidates.agg(F.sum("n"), F.max("top")).first()
    asked = rows.filter(is_query).select(*taken)
    parts = max(1, math.ceil(asked.count() / QUERIES))
    queries = _pack(asked.repartition(parts), scale, QUERIES).withColumn("part", F.shiftright("block", 32).cast("int"))
    queries = _base.stored(queries, "topk-queries")
    reach = queries.agg(F.max("reach")).first()[0]
    if not total[0] or reach is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(math.ceil(total[0] / CELL), min(width, math.ceil(total[0] / 2048)))
    bound = int(reach) * int(total[1])  # no score is beyond it
    if bound >= 1 << 62:
        raise ArithmeticError("inner products may not fit 64 bits")
    rounds = math.ceil((2 * bound + 1).bit_length() / BITS)
    state = queries.select("block", F.array_repeat(F.lit(-bound), F.col("n")).alias("los"),
                           F.array_repeat(F.lit(k).cast("long"), F.col("n")).alias("needs"))
    for r in reversed(range(rounds)):
        counted = _meet(candidates, queries, state, parts, cells).mapInArrow(_counts(BITS * r), COUNTS) \
            .groupBy("block", "place", "bin").agg(F.sum("n").alias("n"))
        state = _base.stored(_narrowed(state, counted, BITS * r), "topk-state")
    hits = _meet(candidates, queries, state, parts, cells).mapInArrow(_hits, HITS)
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _narrowed(state: DataFrame, counted: DataFrame, shift: int) -> DataFrame:
    """The state after a round: each low moves to the bin in which the count from above reaches the number needed, and
    that number falls by what lies above. Where all counts together do not reach it, both stay."""
    from_above = Window.partitionBy("block", "place").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    now = state.select("block", F.posexplode(F.arrays_zip("los", "needs")).alias("place", "s")) \
        .select("block", "place", F.col("s.los").alias("lo"), F.col("s.needs").alias("need"))
    found = counted.withColumn("above", F.coalesce(F.sum("n").over(from_above), F.lit(0))) \
        .join(now, ["block", "place"], "right") \
        .filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))) \
        .select("block", "place", F.col("bin").alias("at"), "above")
    moved = now.join(found, ["block", "place"], "left").select(
        "block", "place", (F.col("lo") + F.coalesce(F.shiftleft(F.col("at").cast("long"), shift), F.lit(0))).alias("lo"),
        (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"))
    listed = F.sort_array(F.collect_list(F.struct("place", "lo", "need")))  # at most QUERIES of a block
    return moved.groupBy("block").agg(listed.alias("s")).select(
        "block", F.col("s.lo").alias("los"), F.col("s.need").alias("needs"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def oracle() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
