"""Best-fit packing of tokenized documents into sequences of a fixed length.

Online and in bounded space: a partition's pieces arrive in order; a fixed number of bins is open; a bitset has bit f
set if an open bin has f places free. A piece goes to the bin with the least sufficient free space (lowest set bit at
or above its length); if there is none, a new bin opens, and beyond ``OPEN_BINS`` open ones the fullest closes first.
The pieces of a slice of ``SLICE_BYTES`` of text are placed longest first, so that short ones fill what is left.
Each input partition packs on its own, so nothing is shuffled and a lost task is simply run again.

Tokenizing is exact, word by word: the pattern of ``word_bpe_49k.json`` never crosses ASCII white space, so each
distinct word is encoded once and its ids reused (a bounded cache per worker process).

Defined results: a null or empty text is its end id alone; every row is packed, repeated ones too; a text of any length
is cut into whole sequences and a rest; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

LENGTH = 2048
OPEN_BINS = 1024
END_ID = 0
KNOWN_WORDS = 400_000
SLICE_BYTES = 8 << 20
TOKEN_BYTES = 2 << 20
NEW_WORDS = 10_000
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class Vocabulary:
    """Ids of words, encoded once each; forgets all but the current words beyond ``KNOWN_WORDS``."""

    loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = pa.array([], pa.large_string())
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: start and size of each one's ids, and the id list that holds them."""
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        unknown = at < 0
        if unknown.any():
            new = words.filter(pa.array(unknown))
            codes = []
            for lo in range(0, len(new), NEW_WORDS):
                some = self.tokenizer.encode_batch_fast(new.slice(lo, NEW_WORDS).to_pylist(), add_special_tokens=False)
                codes += [e.ids for e in some]
            if len(self.words) + len(new) > KNOWN_WORDS:
                held = np.zeros(len(self.words), bool)
                held[at[~unknown]] = True
                self.ids = self.ids[np.repeat(held, self.sizes)]
                self.words, self.sizes = self.words.filter(pa.array(held)), self.sizes[held]
                at[~unknown] = (np.cumsum(held) - 1)[at[~unknown]]
            at[unknown] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, codes), np.int64, len(codes))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(codes), np.uint32)])
        return (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at], self.ids


def plain(texts: pa.Array) -> pa.Array:
    """Texts with the same ids but fewer distinct words: A-Z in lower case, as the tokenizer has them (but for texts
    with a possible special token, which is told by case), and a blank between a letter and a comma, full stop or
    exclamation mark, where its pattern always cuts."""
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    return pc.replace_substring_regex(texts.cast(pa.large_string()), "([A-Za-z])([,.!])", r"\1 \2")


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, each text's followed by the end id; and how many each text has. Texts of about
    ``TOKEN_BYTES`` are held as words at a time."""
    parts = [_token_ids(texts.slice(lo, hi - lo), path) for lo, hi in _base.slices(texts, TOKEN_BYTES)]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    words, rows = _base.words_of(plain(texts), _base.SPACE)
    index, distinct = _base.encoded(words)
    starts, sizes, ids = Vocabulary.of(path).lookup(distinct)
    each = sizes[index]
    before = np.cumsum(each) - each
    flat = ids[np.repeat(starts[index] - before, each) + np.arange(int(each.sum()))]
    counts = np.bincount(rows, weights=each, minlength=len(texts)).astype(np.int64)
    out = np.full(len(flat) + len(texts), END_ID, np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), counts)] = flat
    return out, counts + 1


class BestFit:
    """Open bins of one stream."""

    def __init__(self, length: int, open_bins: int, first_id: int):
        self.length, self.most, self.next = length, open_bins, first_id
        self.bits, self.open, self.bins = 0, 0, [[] for _ in range(length)]

    def place(self, size: int) -> tuple[int, int]:
        """The bin for a piece, and its place there."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.next
            self.next += 1
        if free > size:
            self.bins[free - size].append(number)
            self.bits |= 1 << (free - size)
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.length - free

    def _take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return number


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their ids (little-endian unsigned 32-bit), sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(length, open_bins, TaskContext.get().partitionId() << 32)
        for batch in _base.freed(batches):
            for lo, hi in _base.slices(batch.column(1), SLICE_BYTES):
                ids, counts = token_ids(batch.column(1).slice(lo, hi - lo), tokenizer)
                pieces = -(-counts // length)
                doc = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * length
                size = np.minimum(length, counts[doc] - start)
                at = (np.cumsum(counts) - counts)[doc] + start
                placed = np.empty((len(size), 2), np.int64)
                for i in np.argsort(-size, kind="stable").tolist():
                    placed[i] = fit.place(int(size[i]))
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(number.astype(np.int32)),
                    pa.array(start), pa.array(size),
                    pa.array([raw[4 * a:4 * (a + n)] for a, n in zip(at.tolist(), size.tolist())], pa.binary()),
                    pa.array(placed[:, 0]), pa.array(placed[:, 1])],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    _base.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def pieces(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    import public_tokenizers
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_base.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces of all documents that are left."""
    return pieces(docs)
