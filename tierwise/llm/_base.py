"""Shared helpers: the shared scratch folder, written intermediate tables, word splitting."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.config import ensure_checkpoint_dir

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between tasks; workers live on idle

SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python by ``BATCH_BYTES`` at most, for this session (by default 64 MB, held twice or more on each side
    of the pipe, in every task at once: long texts fill that)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again. This cuts the lineage, survives lost
    executors, and gives Catalyst the real size, so that a join broadcasts it only below Spark's own threshold."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stored``, as a table in the shared folder that is bucketed by ``key``: joins on the key move only their
    other side."""
    spark = df.sparkSession
    path = scratch(spark, name)
    own = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(own)
    return spark.table(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freed(batches: Iterator) -> Iterator:
    """The same batches; when they end, the worker gives the memory it no longer uses back to the machine (glibc keeps it
    otherwise, and workers live on idle beside the next stage's)."""
    try:
        yield from batches
    finally:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``most`` bytes together; a longer single text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, held = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and held + s > most:
            yield lo, i
            lo, held = i, 0
        held += int(s)
    if lo < len(sizes):
        yield lo, len(sizes)


def words_of(texts: pa.Array, separators: str, lower: str = "") -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each word its row. lower: '' none, 'ascii' A-Z, 'utf8' all."""
    texts = pc.fill_null(texts, "")
    if lower:  # before the cast: pyarrow 23 lower-cases a cast slice of strings wrongly
        texts = pc.ascii_lower(texts) if lower == "ascii" else pc.utf8_lower(texts)
    texts = texts.cast(pa.large_string())
    parts = pc.split_pattern(pc.replace_substring_regex(texts, separators, " "), " ")
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the list of distinct words, and that list."""
    if not len(words):
        return np.zeros(0, np.int64), pa.array([], words.type)
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned numbers; wraps by design."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes, then mixed. The same in every process."""
    a = distinct.cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1) \
        if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
    starts = offsets[:-1] - offsets[0]
    sizes = np.diff(offsets)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
    powers = np.cumprod(np.concatenate([[1], np.full(max(0, int(sizes.max(initial=0)) - 1), 0x9E3779B97F4A7C15)])
                        .astype(np.uint64))
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(mixed(data * powers[place] + place.astype(np.uint64)), starts[some])
    return mixed(out + sizes.astype(np.uint64))
