"""Language identification with spans.

Learning: hashed 1- to 4-byte grams of the padded, lower-cased words are counted per language, together with the scripts
(Unicode ranges) of the words. Tasks add up their own counts, Spark sums them, and the model is a table of (languages x
``BUCKETS``) numbers whatever the size of the corpus.

Labelling: a word's script narrows the candidate languages to those in which the script made up at least
``SCRIPT_SHARE`` of the words; a candidate's score is the sum of its grams' log probabilities over the four orders.
Viterbi over the words of a text, all texts of a slice side by side, finds the best sequence of languages when each
switch costs ``SWITCH``; its runs are the spans. A text's language has the most letters; its score is that share of the
letters times the language's posterior over its own words.

Defined results: ``und`` with score 0 and no span if a text is null, has no letter, or nothing was learnt; words without
letters or with a script no language has are neutral; ties take the language first in sort order; rows are never
merged; null languages are not learnt from; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

BUCKETS = 1 << 16
SWITCH = 8.0
SCRIPT_SHARE = 0.01
KEEP_SCORE = 0.4
SLICE_BYTES = 3 << 20
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: First code points of ranges and the script from there on (fixed values).
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
           (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
           (0x0B00, "Other Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Other Asian"), (0x10A0, "Georgian"),
           (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
           (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
           (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
           (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han")]
_FIRST = [a for a, _ in SCRIPTS]
NAMES = sorted({s for _, s in SCRIPTS})
_NUMBER = [NAMES.index(s) for _, s in SCRIPTS]


def script(word: str) -> int:
    """The script of a word's first letter, -1 without one."""
    return next((_NUMBER[bisect_right(_FIRST, ord(c)) - 1] for c in word if c.isalpha()), -1)


def scripts(distinct: pa.Array) -> np.ndarray:
    latin = pc.match_substring_regex(distinct, "^[a-z]").to_numpy(zero_copy_only=False)
    out = np.full(len(distinct), NAMES.index("Latin"), np.int64)
    rest = np.flatnonzero(~latin)
    out[rest] = [script(w) for w in distinct.take(pa.array(rest)).to_pylist()]
    return out


def grams(distinct: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to 4: the bucket of every gram and the number of its word."""
    padded = pc.binary_join_element_wise(pa.scalar(" ", distinct.type), distinct, pa.scalar(" ", distinct.type),
                                         pa.scalar("", distinct.type))
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset:padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    word = np.repeat(np.arange(len(padded)), np.diff(offsets))
    out, code = [], np.zeros(len(data), np.uint64)
    for n in range(1, 5):
        size = len(data) - n + 1
        code = code[:size] * np.uint64(257) + data[n - 1:] + np.uint64(1)
        inside = word[:size] == word[n - 1:]
        bucket = (_base.mixed(code[inside] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        out.append((bucket, word[:size][inside]))
    return out


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words, rows = _base.words_of(texts, NOT_LETTERS, "utf8")
    index, distinct = _base.encoded(words)
    return index, rows, distinct.cast(pa.large_string())


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over documents (lang, text); scripts follow the grams' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in _base.slices(batch.column(1), SLICE_BYTES):
                index, rows, distinct = split(batch.column(1).slice(lo, hi - lo))
                langs = batch.column(0).slice(lo, hi - lo).dictionary_encode()
                lang = langs.indices.to_numpy()[rows]
                kinds, parts = scripts(distinct), grams(distinct)
                for number, name in enumerate(langs.dictionary.to_pylist()):
                    often = np.bincount(index[lang == number], minlength=len(distinct))
                    held = total.setdefault(name, np.zeros(BUCKETS + len(NAMES), np.int64))
                    for bucket, word in parts:
                        held[:BUCKETS] += np.bincount(bucket, weights=often[word], minlength=BUCKETS).astype(np.int64)
                    held[BUCKETS:] += np.bincount(kinds[kinds >= 0], weights=often[kinds >= 0],
                                                  minlength=len(NAMES)).astype(np.int64)
        for name, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(held[at])],
                                             names=["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(lambda batches: _base.freed(run(batches)), "lang string, bucket long, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities (language, bucket) and the scripts that each language uses."""

    def __init__(self, rows: pa.Table):
        self.langs = sorted(set(rows["lang"].to_pylist()))
        n = np.zeros((len(self.langs), BUCKETS + len(NAMES)))
        number = {x: i for i, x in enumerate(self.langs)}
        n[[number[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        seen, words = n[:, :BUCKETS] + 0.5, n[:, BUCKETS:]
        self.log = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
        self.uses = words >= SCRIPT_SHARE * np.maximum(1, words.sum(axis=1, keepdims=True))

    def scores(self, distinct: pa.Array) -> np.ndarray:
        """Per distinct word and language the score; neutral words have 0 for all."""
        kinds, out = scripts(distinct), np.zeros((len(distinct), len(self.langs)), np.float32)
        for bucket, word in grams(distinct):
            for i in range(len(self.langs)):
                out[:, i] += np.bincount(word, weights=self.log[i][bucket], minlength=len(distinct))
        fits = self.uses[:, np.maximum(kinds, 0)].T & (kinds >= 0)[:, None]
        out[~fits.any(axis=1)] = 0
        out[fits.any(axis=1)[:, None] & ~fits] = -1e6
        return out


def viterbi(score: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best language for each word; score: (words, languages), texts being runs of words. All texts advance
    together, the longest first, so that those still running are a prefix."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    running = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
    came = np.empty(score.shape, np.int16)
    own = np.arange(score.shape[1], dtype=np.int16)
    now = np.zeros((len(sizes), score.shape[1]))
    for t, k in enumerate(running):
        v = now[:k]
        best = v.argmax(axis=1)
        switched = np.take_along_axis(v, best[:, None], 1) - SWITCH
        at = starts[:k] + t
        came[at] = np.where(v >= switched, own, best[:, None].astype(np.int16))
        now[:k] = np.maximum(v, switched) + score[at]
    out = np.empty(len(score), np.int64)
    last = now.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        out[at] = last[:k]
        last[:k] = came[at, last[:k]]
    return out


def labelled(model: Model, texts: pa.Array) -> tuple[list, list, list]:
    """Language, score and spans (lang, first word, words) of every text."""
    langs, n = model.langs, len(texts)
    index, rows, distinct = split(texts)
    kinds = scripts(distinct)
    if not langs or not len(index):
        return ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    table = model.scores(distinct)
    sizes = np.bincount(rows, minlength=n)
    starts = np.cumsum(sizes) - sizes
    path = viterbi(table[index], starts, sizes)
    letters = np.where(kinds >= 0, pc.utf8_length(distinct).to_numpy(), 0)[index]
    held = np.bincount(rows * len(langs) + path, weights=letters, minlength=n * len(langs)).reshape(n, -1)
    top, total = held.argmax(axis=1), held.sum(axis=1)
    own = path == top[rows]
    sums = np.stack([np.bincount(rows[own], weights=table[index[own], i], minlength=n) for i in range(len(langs))], 1)
    sums -= sums.max(axis=1, keepdims=True)
    posterior = np.exp(sums[np.arange(n), top]) / np.exp(sums).sum(axis=1)
    score = np.where(total > 0, held[np.arange(n), top] / np.maximum(total, 1) * posterior, 0.0)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(path) != 0) | (np.diff(rows) != 0)])) if len(path) else []
    spans: list[list] = [[] for _ in range(n)]
    for a, size in zip(cut, np.diff(np.append(cut, len(path)))):
        if total[r := rows[a]] > 0:
            spans[r].append((langs[path[a]], int(a - starts[r]), int(size)))
    return [langs[i] if t > 0 else "und" for i, t in zip(top, total)], score.tolist(), spans


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """docs (doc_id, text, lang) with lang_pred, score and spans; learnt from the rows where ``learn`` holds. Labels,
    ids and sources are no inputs of a prediction. Rows keep doc_id and a hash key of (doc_id, text)."""
    _base.bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    taught = docs.filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    shared = spark.sparkContext.broadcast(Model(counts(taught).toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            for lo, hi in _base.slices(batch.column(2), SLICE_BYTES):
                langs, scores, spans = labelled(shared.value, batch.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([[dict(zip(("lang", "first_word", "words"), s)) for s in x] for x in spans], kind)],
                    names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select("doc_id", (~learn).alias("held_out"), "text").mapInArrow(
        lambda batches: _base.freed(run(batches)), "doc_id long, held_out boolean, lang_pred string, score double, "
             "spans array<struct<lang: string, first_word: long, words: long>>")


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _typed(_base.table(spark, sf_dir, "documents"))
    return identify(docs, _base.crc_mod("doc_id", 5) != 0).select("doc_id", "held_out", "lang_pred", "score",
                                                                   F.size("spans").alias("n_spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a known language that takes up at least ``KEEP_SCORE`` of them. The few others
    are written by hash of (doc_id, text) and joined out."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    keyed = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"), _base.crc_mod("doc_id", 5).alias("part"))
    found = identify(keyed, F.col("part") != 0)
    gone = found.filter((F.col("lang_pred") == "und") | (F.col("score") < KEEP_SCORE)) \
        .select(F.col("doc_id").alias("_key")).distinct()
    gone = _base.stored(gone, "language-gone")
    return docs.join(gone, key == gone["_key"], "left_anti")
