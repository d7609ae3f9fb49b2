"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers' tokens become frames of (document, start, end, id). pandas ``merge_asof``, per batch and keyed by
document, finds for each token start the other side's token that covers it; the union of both directions is the set of
all overlapping pairs. Those that end together are links; they also end a group, the least stretch at whose ends both
tokenizers have a token border.

Tokenizing is exact, unit by unit: a unit runs from one blank or line feed that follows a non-blank to the next. The
byte-level pattern never crosses such a place, and no piece of the other vocabulary joins a blank to what stands before
it (checked when it is loaded), so each distinct unit is encoded once and its tokens reused (a bounded cache per worker).

Counts of linked id pairs are added up over the corpus from one row per slice of texts and distinct pair, and returned
to the slices by a join on the pair, so no pair, however frequent, has more rows than there are slices. A document's
links are kept as numbers in its slice's list of pairs.

Defined results: a null or empty text, or one whose joined tokens do not give the blank and text byte for byte (or that
can't be encoded), has no tokens and zeros. Repeated rows are aligned each, and counted each; an empty table gives no
row; other columns are not read. A text of any length is one slice, about 200 bytes of memory for each of its tokens.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

KNOWN_UNITS = 200_000
SLICE_BYTES = 4 << 20   # of texts that share a list of pairs
BATCH_BYTES = 512 << 10  # of texts whose tokens are held at once
ROWS = "slice long, doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, " \
       "links binary, pairs array<long>, counts array<long>"
#: White space beyond ASCII, and control characters that some patterns take for white space: texts with any stay whole.
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK = "\u2581"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies are written in: printable Latin-1 characters are
    themselves, the other bytes follow from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The first tokenizer: byte-level BPE in a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class Pieces:
    """The second tokenizer: a sentencepiece model that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode()
                      for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id(BLANK)
        #: Whether a text may be cut before a blank or line feed: no piece holds one after something else.
        self.cuttable = not any("\n" in p or any(a != BLANK and b == BLANK for a, b in zip(p, p[1:])) for p in pieces)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units that begin with the blank the model adds itself, or with a line feed, before which it is taken
        off again. A blank alone is the model's blank."""
        bare = [u[1:] if u[0] == " " else u for u in units]
        codes = self.model.encode(bare, num_threads=1)
        return [[self.blank] if u == " " else c[1:] if u[0] == "\n" and c[0] == self.blank else c
                for u, c in zip(units, codes)]


class Side:
    """Tokens of known units on one side: their ids and the ends of their bytes, one list after the other."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.widths = np.array([len(b) for b in tokenizer.bytes], np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, units: list[str]) -> np.ndarray:
        """Learn units; whether each one's tokens give its bytes."""
        codes = self.tokenizer.encode(units)
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, codes), np.int64, len(codes))])
        self.ids = np.concatenate([self.ids, np.fromiter((i for c in codes for i in c), np.int64)])
        spelled = self.tokenizer.bytes
        return np.array([b"".join([spelled[i] for i in c]) == u.encode() for u, c in zip(units, codes)], bool)

    def keep(self, held: np.ndarray) -> None:
        self.ids, self.sizes = self.ids[np.repeat(held, self.sizes)], self.sizes[held]

    def tokens(self, units: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For units in order with their first bytes: each token's place among the units, its id and its start."""
        each = self.sizes[units]
        before = np.cumsum(each) - each
        first = (np.cumsum(self.sizes) - self.sizes)[units]
        ids = self.ids[np.repeat(first - before, each) + np.arange(int(each.sum()))]
        widths = self.widths[ids]
        run = np.cumsum(widths) - widths
        owner = np.repeat(np.arange(len(units)), each)
        lead = run[np.minimum(before, max(0, len(run) - 1))] if len(run) else np.zeros(len(units), np.int64)
        return owner, ids, run + (begins - lead)[owner]


class Units:
    """Both sides' tokens of distinct units; forgets all but the current units beyond ``KNOWN_UNITS``."""

    loaded: dict[tuple[str, str], "Units"] = {}

    def __init__(self, a: str, b: str):
        self.a, self.b = Side(ByteLevel(a)), Side(Pieces(b))
        self.cuttable = self.b.tokenizer.cuttable
        self.known = pa.array([], pa.large_string())
        self.exact = np.zeros(0, bool)

    @classmethod
    def of(cls, a: str, b: str) -> "Units":
        if (a, b) not in cls.loaded:
            cls.loaded[a, b] = cls(a, b)
        return cls.loaded[a, b]

    def lookup(self, distinct: pa.Array) -> np.ndarray:
        """The number of each unit among the known ones."""
        at = pc.index_in(distinct, self.known)
        if at.null_count:
            new = distinct.filter(at.is_null())
            if len(self.known) + len(new) > KNOWN_UNITS:
                held = np.zeros(len(self.known), bool)
                held[at.drop_null().to_numpy()] = True
                self.a.keep(held)
                self.b.keep(held)
                self.known, self.exact = self.known.filter(pa.array(held)), self.exact[held]
            units = new.to_pylist()
            self.exact = np.concatenate([self.exact, self.a.add(units) & self.b.add(units)])
            self.known = pa.concat_arrays([self.known, new])
            at = pc.index_in(distinct, self.known)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)


def units_of(texts: pa.Array, cuttable: bool) -> tuple[pa.Array, np.ndarray]:
    """The units of each text with a blank before it, and each unit's text. A null or empty text has none."""
    some = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    full = pc.binary_join_element_wise(blank, texts.take(pa.array(some)).cast(pa.large_string()), none)
    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset:full.offset + len(full) + 1] if len(full) else np.zeros(1, np.int64)
    data = np.frombuffer(full.buffers()[2], np.uint8)[:offsets[-1]] if len(full) else np.zeros(0, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = (data == 32) | (data == 10)
    begins[1:] &= ~space[:-1]
    if not cuttable:
        begins[:] = False
    else:
        whole = pc.match_substring_regex(full, ODD_SPACE).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole):
            begins[offsets[i]:offsets[i + 1]] = False
    begins[offsets[:-1]] = True
    at = np.flatnonzero(begins)
    units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)),
                                             pa.py_buffer(data))
    return units, some[np.searchsorted(offsets, at, side="right") - 1]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of a, row of b) of tokens of one document (doc, start, end) that share a byte: each token with
    the other side's token that covers its start, both ways, each pair once. Starts rise over the whole batch."""
    key = ["start", "doc"]
    forth = pd.merge_asof(a[key], b[key].assign(other=np.arange(len(b))), on="start", by="doc")["other"].to_numpy()
    back = pd.merge_asof(b[key], a[key].assign(other=np.arange(len(a))), on="start", by="doc")["other"].to_numpy()
    i, j = np.arange(len(a)), np.arange(len(b))
    fits, fits_back = ~np.isnan(forth), ~np.isnan(back)
    i, j_of = i[fits], forth[fits].astype(np.int64)
    j, i_of = j[fits_back], back[fits_back].astype(np.int64)
    over = b["end"].to_numpy()[j_of] > a["start"].to_numpy()[i]
    over_back = a["end"].to_numpy()[i_of] > b["start"].to_numpy()[j]
    later = over_back & (a["start"].to_numpy()[i_of] < b["start"].to_numpy()[j])  # equal starts are in the first part
    return np.concatenate([i[over], i_of[later]]), np.concatenate([j_of[over], j[later]])


def spelled(a: pd.DataFrame, b: pd.DataFrame, link_a: np.ndarray, link_b: np.ndarray, n: int) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``. A group ends with the tokens of a link."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[link_a], last_b[link_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    through_a, before_b = np.cumsum(np.bincount(group_a, minlength=1)), np.cumsum(np.bincount(group_b, minlength=1))
    place_a = np.arange(len(a)) + np.concatenate([[0], before_b])[group_a]
    place_b = np.arange(len(b)) + through_a[group_b]
    doc_a, doc_b = a["doc"].to_numpy(), b["doc"].to_numpy()
    final = np.append(doc_b[1:] != doc_b[:-1], True) if len(b) else np.zeros(0, bool)
    text = np.empty(len(a) + len(b), np.int64)  # the id and, in its last two bits, what follows: , | ; or nothing
    text[place_a] = a["id"].to_numpy() * 4 + last_a
    text[place_b] = b["id"].to_numpy() * 4 + np.where(last_b, np.where(final, 3, 2), 0)
    kinds, at = np.unique(text, return_inverse=True)
    words = pa.array([f"{k >> 2}{',|;'[k & 3:(k & 3) + 1]}" for k in kinds.tolist()], pa.large_binary())
    flat = words.take(pa.array(at))
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    raw = memoryview(flat.buffers()[2]) if len(flat) else memoryview(b"")
    stops = ends[np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n))]
    return [bytes(raw[lo:hi]) for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist())]


def _aligned(texts: pa.Array, known: Units) -> tuple:
    """Frames of both sides' tokens of the texts (those with exact tokens), and the links as rows of them."""
    units, docs = units_of(texts, known.cuttable)
    index, distinct = _base.encoded(units)
    numbers = known.lookup(distinct)[index] if len(units) else np.zeros(0, np.int64)
    wrong = np.unique(docs[~known.exact[numbers]])
    fine = ~np.isin(docs, wrong)
    sizes = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = (np.cumsum(sizes) - sizes)[fine]
    docs, numbers = docs[fine], numbers[fine]
    frames = []
    for side in (known.a, known.b):
        owner, ids, starts = side.tokens(numbers, begins)
        frames.append(pd.DataFrame({"doc": docs[owner], "start": starts, "end": starts + side.widths[ids], "id": ids}))
    a, b = frames
    i, j = overlaps(a, b)
    ends = a["end"].to_numpy()[i] == b["end"].to_numpy()[j]
    i, j = i[ends], j[ends]
    order = np.argsort(i, kind="stable")
    return a, b, i[order], j[order]


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = True) -> DataFrame:
    """A row per document (slice, doc_id, counts of tokens and groups, the groups as text and their digest, its links as
    little-endian unsigned 32-bit places in the slice's pairs), and a row per slice without doc_id, with its distinct
    linked pairs (id of b times 2^32 plus id of a) and how often each is linked there. ``pairs`` tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units.of(a, b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in _base.slices(batch.column(1), SLICE_BYTES):
                ids, n = batch.column(0).slice(lo, hi - lo), hi - lo
                n_a, n_b, links, groups, linked = [], [], [], [], []
                texts = batch.column(1).slice(lo, n)
                for p, q in _base.slices(texts, BATCH_BYTES):
                    left, right, i, j = _aligned(texts.slice(p, q - p), known)
                    doc = left["doc"].to_numpy()
                    n_a.append(np.bincount(doc, minlength=q - p))
                    n_b.append(np.bincount(right["doc"].to_numpy(), minlength=q - p))
                    links.append(np.bincount(doc[i], minlength=q - p))
                    linked.append((right["id"].to_numpy()[j] << 32) | left["id"].to_numpy()[i])
                    groups += [(g.decode() if keep_groups else None, hashlib.sha256(g).hexdigest() if g else "")
                               for g in spelled(left, right, i, j, q - p)]
                n_a, n_b, links = map(np.concatenate, (n_a, n_b, links))
                place, pairs = pd.factorize(np.concatenate(linked))
                counts = np.bincount(place, minlength=len(pairs))
                raw, stops = place.astype("<u4").tobytes(), 4 * np.cumsum(links)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1, number)), pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(1, pa.int64())]),
                    *(pa.array([*c.tolist(), None], pa.int64()) for c in (n_a, n_b, links)),
                    *(pa.array([*(g[k] for g in groups), None], pa.string()) for k in (0, 1)),
                    pa.array([*(raw[p:q] for p, q in zip([0, *stops[:-1].tolist()], stops.tolist())), None], pa.binary()),
                    pa.array([None] * n + [pairs.tolist()], pa.list_(pa.int64())),
                    pa.array([None] * n + [counts.tolist()], pa.list_(pa.int64()))],
                    names=["slice", "doc_id", "n_a", "n_b", "n_groups", "groups", "groups_sha256", "links", "pairs", "counts"])
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Corpus-wide count of each linked id pair, and whether it is its b id's highest."""
    rows = aligned.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    total = _base.stored(rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")), "align-pairs")
    b = F.shiftright("pair", 32)
    most = total.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return total.join(most, b == most["b"]).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """The documents' rows with n_links, n_best and count_sum from the corpus-wide counts."""
    each = aligned.filter("pairs is not null").select(F.col("slice").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    named = each.join(pair_counts(aligned), "pair").select("of", "at", "total", "best")
    docs = aligned.filter("pairs is null").select("slice", "doc_id", "n_a", "n_b", "n_groups", "groups", "groups_sha256", "links")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups", "groups_sha256"]

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        at = counts.column("at").to_numpy()
        total[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
        out = []
        for raw in rows.column("links").to_pylist():
            place = np.frombuffer(raw, "<u4")
            out.append((len(place), int(best[place].sum()), int(total[place].sum())))
        return pa.table({**{c: rows.column(c) for c in kept},
                         **{name: pa.array([o[k] for o in out], pa.int64()) for k, name in enumerate(("n_links", "n_best", "count_sum"))}})

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, " \
             "n_links long, n_best long, count_sum long"
    return docs.groupBy("slice").cogroup(named.groupBy("of")).applyInArrow(run, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files
    aligned = align(_base.table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"),
                    keep_groups=False)
    return scored(_base.stored(aligned, "align-slices")).drop("groups")
