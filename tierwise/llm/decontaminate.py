"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits. A mask such as ``110110101`` reads some positions of a window and
ignores the others, so a substituted word at an ignored place leaves the hash as it was; several masks cover
substitutions at different places. The seeds of all test items are joined to the seeds of all document positions by
hash (equal 64-bit values); around each hit, document and item are aligned without gaps along the hit's diagonal, and
the longest stretch there is found that has at least ``IDENTITY`` of its words equal and ``MIN_WORDS`` words (or the
whole item's, if that is shorter, down to ``LEAST_WORDS``). No stretch hides another: a passage counts whatever else of
the item stands around it.

The benchmark is the stated query set. It is taken in blocks of at most ``BLOCK_WORDS`` words, whose sorted seeds every
task holds (some 100 bytes a word, a fixed bound); each block meets all documents in one scan without a shuffle. A
larger benchmark means more scans, not larger tasks.

Defined results: null and empty texts and items match nothing; items with a null id are kept under a null id; repeated
items or documents give a row each; items shorter than ``LEAST_WORDS`` words are too short to tell and match nothing;
empty tables give no row; other columns are not read. Of stretches of equal length the one with more equal words, then
the first in the document counts. Texts of any length are read whole, a slice of ``SLICE_BYTES`` or one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

MASKS = ("11111", "1101011", "1010110011", "11001001011")
MIN_WORDS = 12
LEAST_WORDS = 8
IDENTITY = 0.8
BLOCK_WORDS = 1 << 20
SLICE_BYTES = 4 << 20
SCHEMA = ("doc_id long, item_id long, doc_start long, item_start long, length long, matches long, identity double, "
          "coverage double")


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    words, rows = _base.words_of(texts, _base.NOT_ALNUM, "utf8")
    index, distinct = _base.encoded(words)
    return _base.word_hashes(distinct)[index], rows


def seeds(h: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of one mask and the positions at which they start, windows inside one text only."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, len(mask), np.uint64)
    for i, read in enumerate(mask):
        if read == "1":
            out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
    at = np.flatnonzero(rows[:n] == rows[len(mask) - 1:])
    return out[at], at


class Block:
    """Words and sorted seeds of some test items."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.h, self.rows = hashed(pa.array(texts, pa.large_string()))
        self.sizes = np.bincount(self.rows, minlength=len(ids))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seeds = []
        for mask in MASKS:
            s, at = seeds(self.h, self.rows, mask)
            order = np.argsort(s, kind="stable")
            self.seeds.append((s[order], at[order]))

    def hits(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (document position of the item's first word, item) of all joined seeds; positions may lie outside."""
        found = []
        for mask, (known, places) in zip(MASKS, self.seeds):
            s, at = seeds(h, rows, mask)
            lo = np.searchsorted(known, s, "left")
            some = np.flatnonzero((lo < len(known)) & (known[np.minimum(lo, max(0, len(known) - 1))] == s)) if len(known) else []
            if not len(some):
                continue
            lo, hi = lo[some], np.searchsorted(known, s[some], "right")
            n = hi - lo
            place = places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            item = self.rows[place]
            first = np.repeat(at[some], n) - (place - self.starts[item])
            found.append(np.stack([first, item, rows[np.repeat(at[some], n)]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def longest_stretch(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """Start and end of the longest stretch of at least ``least`` words that begins and ends with an equal word and has
    ``IDENTITY`` of its words equal; of equals the one with more equal words, then the first. A stretch has the share
    if its words add up to 0 or more, an equal one counting 1 - IDENTITY and another -IDENTITY."""
    share = round(1000 * IDENTITY)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - share, -share))])
    ends = np.where(np.concatenate([[False], equal]), total, -(1 << 60))
    later = np.maximum.accumulate(ends[::-1])[::-1]  # best total at an end from here on; falls
    starts = np.flatnonzero(equal)
    stops = np.searchsorted(-later, -total[starts], side="right") - 1  # the last end with at least the start's total
    length = stops - starts
    if not len(starts) or length.max() < least:
        return None
    longest = np.flatnonzero(length == length.max())
    i = longest[np.argmax((total[stops] - total[starts])[longest])]
    return int(starts[i]), int(stops[i])


def overlaps(block: Block, texts: pa.Array) -> Iterator[tuple]:
    """Verified overlaps: text number, item number, starts, length and matches; per text and item the longest one."""
    h, rows = hashed(texts)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    best: dict[tuple[int, int], tuple] = {}
    for first, item, row in block.hits(h, rows).tolist():
        size = int(block.sizes[item])
        lo, hi = max(first, int(bounds[row])), min(first + size, int(bounds[row + 1]))
        skip, base = lo - first, int(block.starts[item])
        equal = h[lo:hi] == block.h[base + skip:base + skip + hi - lo]
        stretch = longest_stretch(equal, max(LEAST_WORDS, min(MIN_WORDS, size)))
        if stretch is None:
            continue
        a, b = stretch
        matches = int(equal[a:b].sum())
        found = (b - a, matches, -(lo - int(bounds[row]) + a), skip + a)
        best[row, item] = max(best.get((row, item), found), found)
    for (row, item), (length, matches, minus, start) in best.items():
        yield row, item, -minus, start, length, matches


def blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """The items in blocks of at most BLOCK_WORDS characters' worth of words, streamed to the driver block by block."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        size = len(r[1]) // 2 + 1
        if ids and held + size > BLOCK_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += size
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item with a verified overlap: the longest, and its share of the item's words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], SCHEMA)
    for ids, items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Block(ids, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for lo, hi in _base.slices(batch.column(1), SLICE_BYTES):
                    found = list(overlaps(block, batch.column(1).slice(lo, hi - lo)))
                    if not found:
                        continue
                    rows, items, doc_start, item_start, length, matches = (np.array(x, np.int64) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(lo, hi - lo).take(pa.array(rows)),
                        pa.array([block.ids[i] for i in items], pa.int64()), pa.array(doc_start), pa.array(item_start),
                        pa.array(length), pa.array(matches), pa.array(matches / length),
                        pa.array(length / block.sizes[items])],
                        names=["doc_id", "item_id", "doc_start", "item_start", "length", "matches", "identity", "coverage"])

        out = out.unionByName(texts.mapInArrow(run, SCHEMA))
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a verified overlap. Rows are told apart by a hash of doc_id and text, so that
    a null or repeated id takes no other document with it; the few contaminated ones are written and joined out."""
    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("string"), text)
    found = contaminated(docs.select(key.alias("doc_id"), text.alias("text")), _base.table(spark, sf_dir, "benchmark"))
    gone = _base.stored(found.select(F.col("doc_id").alias("_key")).distinct(), "decontaminate-gone")
    return docs.join(gone, key == gone["_key"], "left_anti")
