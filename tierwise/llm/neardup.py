"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Texts are lower-cased and cut into words (runs of letters and digits). Texts of equal words are one node. Of each node's
2-word k-mers, labelled by how often they occurred before, every sketch takes one with the smallest hash from each of
``PARTS``, halves of the text that overlap, and keeps them in the order of their places in the text; equal sketches put nodes into one bucket.
Equality thus needs common k-mers in the same order all along the text, which follows edit similarity; sampling the whole
text at once would also bring together all texts that share one long passage. Two words are short enough that texts with
every fifth word changed still share a good part of their k-mers, and the overlap leaves texts with words added on one
side common k-mers in each part. Texts of up to ``SHORT`` words also go into a bucket for every text that is left of them
when as many words as their links may differ by are deleted, so that none of their links is missed. Buckets of the same
members are compared once.

Two nodes are linked if their word edit distance is at most 0.2 of the longer one, found by a bit-parallel alignment
inside a band of that width, after a bag-of-words lower bound. A bucket is never expanded into its pairs: each node is
compared with the bucket's hub. Nodes that the hub refuses are compared among themselves in one task if they are at
most ``SMALL``; larger remainders stay one bucket and meet another hub, up to ``ROUNDS`` of them. What is left then is
compared in blocks of about ``SMALL`` nodes, each of which meets every other, so that no two members of a bucket go
uncompared, however many they are. A refused node that lies so near to the hub that, by the triangle inequality, it can still be
linked to an accepted one, is compared with those, if the two are not of one class by then.

Classes are the connected parts of the links; a class's id is its smallest doc_id. Every document gets a row. Links are
found by equal sketches, so a pair of longer texts may be missed if none of ``SKETCHES`` sketches agree; the README states the recall
measured on planted pairs at and above the threshold.

Defined results: null texts count as empty; all texts without words are one class; a text of fewer than five words is a
single k-mer; repeated rows are one class; a class with no doc_id at all has a null id; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base

K = 2
PARTS = ((0, 2), (1, 3), (2, 4))  # quarters of the text
SKETCHES = 64
SHORT = 14
SIMILARITY = 0.8
SMALL = 512
COLUMNS = 4096
WORDS = 500_000
ROUNDS = 4
BITMAP_BITS = 25
SLICE_BYTES = 2 << 20


def _odd(n: int, seed: int) -> np.ndarray:
    return _base.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and how many words each text has."""
    words, rows = _base.words_of(texts, _base.NOT_ALNUM, "utf8")
    index, distinct = _base.encoded(words)
    return _base.word_hashes(distinct)[index], np.bincount(rows, minlength=len(texts)).astype(np.int64)


def fingerprints(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits per text over its words in order, as rows of two unsigned numbers."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(h)) - np.repeat(starts, counts)).astype(np.uint64)
    out = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    for i, odd in enumerate(_odd(2, 77)):
        if some.any():
            out[some, i] = np.add.reduceat(_base.mixed((h + odd) ^ _base.mixed(place * odd)), starts[some])
        out[:, i] = _base.mixed(out[:, i] + counts.astype(np.uint64))
    return out


def sketches(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash sketches: one row per text with words, and which texts these are."""
    texts = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[texts]
    row = np.repeat(np.arange(len(texts)), counts[texts])
    gram = np.zeros(len(h), np.uint64)
    for i, odd in enumerate(_odd(K, 5)):
        inside = row[i:] == row[:len(row) - i]
        gram[:len(row) - i][inside] += _base.mixed(h[i:][inside]) * odd
    last = np.repeat(starts + np.maximum(counts[texts] - K, 0), counts[texts])
    keep = np.arange(len(h)) <= last
    gram, row = _base.mixed(gram[keep]), row[keep]
    order = np.lexsort((gram, row))
    new = np.ones(len(order), bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = np.flatnonzero(new)
    occurrence = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    label = np.empty(len(order), np.uint64)
    label[order] = occurrence.astype(np.uint64)
    gram = _base.mixed(gram + label * np.uint64(0xD6E8FEB86659FD93))
    sizes = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(sizes)
    gram = np.append(gram, np.uint64(0))  # so that a part may end with the last text
    out = np.zeros((len(texts), SKETCHES), np.uint64)
    # a k-mer's hash in the upper 44 bits, its place in the text, in 2^20ths, in the others
    place = np.append(((np.arange(len(row)) - (ends - sizes)[row]) << 20) // sizes[row], 0).astype(np.uint64)
    within, upper = np.uint64((1 << 20) - 1), ~np.uint64((1 << 20) - 1)
    spans = []
    for lo, hi in PARTS:
        first = ends - sizes + np.minimum(sizes * lo // 4, sizes - 1)
        spans.append(np.stack([first, np.maximum(ends - sizes + -(-sizes * hi // 4), first + 1)], 1).ravel())
    odds = [_odd(SKETCHES, 11 + p) for p in range(len(PARTS))]
    for j in range(SKETCHES if len(texts) else 0):
        picks = np.stack([np.minimum.reduceat((gram * odds[p][j]) & upper | place, at)[::2] for p, at in enumerate(spans)])
        picks = np.take_along_axis(picks, np.argsort(picks & within, axis=0, kind="stable"), 0)  # in text order
        for pick in picks:
            out[:, j] = _base.mixed(out[:, j] + (pick >> np.uint64(20)))
    for j, odd in enumerate(_odd(SKETCHES, 11)):
        out[:, j] = _base.mixed(out[:, j] + odd)
    return out.view(np.int64), texts


def deletions(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of what is left of each text of 1 to ``SHORT`` words without up to ``allowed`` of its words, and each key's
    text. Linked texts have such a rest in common: the words that an alignment of least cost keeps."""
    starts, keys, owners = np.cumsum(counts) - counts, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    odd = _odd(1, 99)[0]
    for n in range(1, SHORT + 1):
        texts = np.flatnonzero(counts == n)
        if not len(texts):
            continue
        words = _base.mixed(h[starts[texts][:, None] + np.arange(n)])
        for k in range(allowed(n, n) + 1):
            place = _base.mixed(np.arange(n - k, dtype=np.uint64) * odd) | np.uint64(1)
            for gone in combinations(range(n), k):
                keys.append(_base.mixed((np.delete(words, gone, axis=1) * place).sum(1) + odd))
                owners.append(texts)
    both = np.unique(np.stack([np.concatenate(owners).astype(np.uint64), np.concatenate(keys)], 1), axis=0)
    return both[:, 1].copy().view(np.int64), both[:, 0].astype(np.int64)


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Word edit distance, or limit + 1 if it is larger: a bit-parallel alignment inside the band of diagonals that
    ``limit`` allows, common ends being cut off first."""
    if len(a) < len(b):
        a, b = b, a
    least = len(b)
    differ = np.flatnonzero(a[:least] != b)
    head = int(differ[0]) if len(differ) else least
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[len(a) - len(b):] != b)
    tail = len(b) - 1 - int(differ[-1]) if len(differ) else len(b)
    a, b = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    m, n = len(a), len(b)
    if m - n > limit or not n:
        return min(m, limit + 1)
    common = sum((Counter(a) & Counter(b)).values())
    if m - common > limit:
        return limit + 1
    t = min(limit, m)
    full = (1 << (2 * t + 1)) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    up, down, got = full ^ ((1 << t) - 1), 0, t
    for j in range(1, n + 1):
        shift = j - t - 1
        eq = where.get(b[j - 1], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        zero = (((eq & up) + up) ^ up | eq | down) & full
        right, left = down | (full & ~(zero | up)), zero & up
        if j + t <= m:
            got += not zero >> (2 * t) & 1
        else:
            bit = m - j + t
            got += (right >> bit & 1) - (left >> bit & 1)
        zero >>= 1
        up, down = left | (full & ~(zero | right)), zero & right
    return got if got <= limit else limit + 1


def common_words(texts: list[np.ndarray]) -> np.ndarray:
    """For every two texts the size of their common bag of words. Words are dealt by their numbers into lots of about
    ``WORDS`` places, so that long texts take no more memory than their words; a lot's counts add to the others'."""
    out = np.zeros((len(texts), len(texts)), np.int64)
    lots = 1 + sum(map(len, texts)) // WORDS
    for lot in range(lots):
        _add_common(out, texts if lots == 1 else [t[t % lots == lot] for t in texts])
    return out


def _add_common(out: np.ndarray, texts: list[np.ndarray]) -> None:
    """Adds the sizes of common bags, some columns (words numbered by occurrence) at a time."""
    word, text = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order = np.lexsort((word, text))
    word, text = word[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])])) if len(word) else word
    occurrence = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    _, column, held = np.unique(np.stack([word, occurrence], 1), axis=0, return_inverse=True, return_counts=True)
    column = column.ravel()
    keep = held[column] > 1
    _, column = np.unique(column[keep], return_inverse=True)
    text = text[keep]
    order = np.argsort(column, kind="stable")
    column, text = column[order], text[order]
    for a in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        dense = np.zeros((len(texts), COLUMNS), np.float32)
        dense[text[lo:hi], column[lo:hi] - a] = 1
        out += (dense @ dense.T).astype(np.int64)


def allowed(m: int, n: int) -> int:
    """The largest edit distance of linked texts of m and n words."""
    return int((1 - SIMILARITY) * max(m, n) + 1e-9)


def _words(raw: pa.Buffer | bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32)


def _compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (a, b) with their edit distance, null if no text of b's class can be linked to a through b. ``words`` are
    bucketed by fp and stay where they are; only those of the hubs are dealt out, as a hub may have many pairs."""
    hub_words = _base.stored(words.join(pairs.select(F.col("b").alias("fp")).distinct(), "fp", "left_semi"), "neardup-hubs")
    both = (pairs.join(words.withColumnsRenamed({"fp": "a", "words": "a_words"}), "a")
            .join(hub_words.withColumnsRenamed({"fp": "b", "words": "b_words"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, linked, sizes = [], [], []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = _words(left.as_buffer()), _words(right.as_buffer())
                most = allowed(len(a), len(b))
                reach = int((1 - SIMILARITY) * (1 / SIMILARITY ** 2 + 1 / SIMILARITY) * len(b)) + 1
                d = distance(a, b, max(most, reach))
                far.append(d if d <= max(most, reach) else None)
                linked.append(d <= most)
                sizes.append(len(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int32()),
                                              pa.array(linked, pa.bool_()), pa.array(sizes, pa.int32())],
                                             names=["a", "b", "d", "linked", "n"])

    return both.select("a", "b", "a_words", "b_words").mapInArrow(lambda batches: _base.freed(run(batches)), "a binary, b binary, d int, linked boolean, n int")


def _among(members: DataFrame, words: DataFrame) -> DataFrame:
    """Links inside buckets (key, fp, members), compared in blocks of at most about ``SMALL`` nodes, every two blocks in
    a task: every two members are, unless links found before in that task already connect them, so the links that come
    out hold a spanning forest of all."""
    blocks = F.ceil(F.col("members") / SMALL)
    dealt = members.select("key", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"),
                           F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.select("key", "fp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        fps, texts = table["fp"].to_pylist(), [_words(w.as_buffer()) for w in table["words"].combine_chunks()]
        sizes, own = np.array([len(t) for t in texts]), table["own"].to_numpy()
        longest = np.maximum.outer(sizes, sizes)
        most = ((1 - SIMILARITY) * longest + 1e-9).astype(np.int64)
        near = np.triu(longest - common_words(texts) <= most, 1)
        if table["x"][0] != table["y"][0]:
            near &= own[:, None] != own[None, :]
        part, out = np.arange(len(fps)), []
        for i in range(len(fps)):
            for j in np.flatnonzero(near[i]).tolist():
                if part[i] != part[j] and distance(texts[i], texts[j], int(most[i, j])) <= most[i, j]:
                    part[part == part[j]] = part[i]
                    out.append((fps[i], fps[j]))
        return pa.table([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return dealt.join(words, "fp").groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary")


def sketched(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the key of its text, fingerprint and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _base.slices(batch.column(2), SLICE_BYTES):
                h, counts = hashed_words(batch.column(2).slice(lo, hi - lo))
                fp = fingerprints(h, counts)
                sig, texts = sketches(h, counts)
                rests, short = deletions(h, counts)
                owner = np.concatenate([np.repeat(texts, SKETCHES), short])
                sig = np.concatenate([sig.ravel(), rests])[np.argsort(owner, kind="stable")]
                lists = np.zeros(len(counts) + 1, np.int32)
                lists[1:] = np.cumsum(np.bincount(owner, minlength=len(counts)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    pa.array([r.tobytes() for r in fp], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(sig))], names=["doc_id", "text_key", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
                       F.col("text").cast("string")) \
        .mapInArrow(lambda batches: _base.freed(run(batches)), "doc_id long, text_key string, fp binary, sig array<long>")


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << BITMAP_BITS)) for i in range(2)]


def bitmap(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of (text_key) with ``2 ** BITMAP_BITS`` bits, whatever the number of keys."""

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 15, bool)
        bits[table["place"].to_numpy() & 0x7FFF] = True
        return pa.table([pa.array([key[0].as_py()], pa.int64()),
                         pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    places = keys.select(F.explode(F.array(*_places(F.col("text_key")))).alias("place")).distinct()
    blocks = places.withColumn("block", F.shiftright("place", 15)).groupBy("block").applyInArrow(fill, "block long, bits binary")
    out = np.zeros((1 << BITMAP_BITS - 15, 1 << 12), np.uint8)
    for block, bits in zip(*blocks.toArrow().to_pydict().values()):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _told(docs: DataFrame, keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a row's key may be among ``keys`` (text_key); false only if it is not."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys))

    @F.arrow_udf("boolean")
    def may_be(one: pa.Array, two: pa.Array) -> pa.Array:
        at = [(shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in (one.to_numpy(), two.to_numpy())]
        return pa.array((at[0] & at[1]).astype(bool))

    return lambda key: may_be(*_places(key))


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, words) of the nodes named by wanted (text_key), and of a few others: a Bloom filter of fixed size lets texts
    through, so that no text is shuffled, and the joins on fp that follow are exact."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            places = (batch.column(i).to_numpy() for i in (1, 2))
            through = np.logical_and(*((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in places)).astype(bool)
            texts = batch.column(0).filter(pa.array(through))
            for lo, hi in _base.slices(texts, SLICE_BYTES):
                h, counts = hashed_words(texts.slice(lo, hi - lo))
                ends, short = np.cumsum(counts), h.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r.tobytes() for r in fingerprints(h, counts)], pa.binary()),
                    pa.array([short[e - c:e].tobytes() for e, c in zip(ends, counts)], pa.binary())], names=["fp", "words"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), *[p.alias(f"place{i}") for i, p in enumerate(_places(F.md5(text)))])
    return texts.mapInArrow(lambda batches: _base.freed(run(batches)), "fp binary, words binary").dropDuplicates(["fp"])


def met(keys: DataFrame) -> DataFrame:
    """The rows (key, fp) whose key another node has too. Keys are dealt once; those of one node alone end there."""
    members = F.count("*").over(Window.partitionBy("key"))
    return keys.select("key", "fp", members.alias("members")).filter("members > 1").select("key", "fp")


def _alike(buckets: DataFrame) -> DataFrame:
    """One ``key`` of all buckets (key, fp) with the same two or more members, how many members, and for how many buckets
    it stands. Buckets are alike if counts, smallest nodes and 64-bit sums of the members agree."""
    sets = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min("fp").alias("least"),
                                      F.bit_xor(F.xxhash64("fp")).alias("sum")).filter("members > 1")
    return sets.groupBy("members", "least", "sum").agg(F.min("key").alias("key"), F.count("*").alias("times"))


def hubs(buckets: DataFrame) -> DataFrame:
    """For every bucket (key, fp, times) its hub ``b``: the node that is in most buckets, of equals the smallest. It is in
    the middle of its like, where most others are near."""
    often = buckets.groupBy("fp").agg(F.sum("times").alias("often"))
    return buckets.join(often, "fp").groupBy("key").agg(F.min(F.struct(-F.col("often"), F.col("fp")))["fp"].alias("b"))


def links(buckets: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) of nodes that share a bucket (key, fp, times), and all comparisons with hubs."""
    found, tries, open_buckets, rounds = [], [], buckets, 0
    while True:
        members = _base.stored(open_buckets.join(hubs(open_buckets), "key").filter("fp <> b").withColumnRenamed("fp", "a"),
                               "neardup-members")
        tried = _base.stored(_compared(members.select("a", "b").distinct(), words), "neardup-tried")
        tries.append(tried)
        found.append(tried.filter("linked").select("a", "b"))
        refused = _base.stored(members.join(tried.filter("not linked"), ["a", "b"]).select("key", F.col("a").alias("fp")),
                               "neardup-refused")
        rounds += 1
        sizes = _base.stored(_alike(refused), "neardup-sizes")
        many = (F.col("members") > SMALL) & F.lit(rounds < ROUNDS)
        found.append(_among(refused.join(sizes.filter(~many).select("key", "members"), "key"), words))
        if sizes.filter(many).isEmpty():
            break
        open_buckets = _base.stored(refused.join(sizes.filter(many).select("key", "times"), "key"), "neardup-open")
    return _base.stored(_union(found).distinct(), "neardup-links"), _union(tries)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def border_links(tried: DataFrame, part: DataFrame, words: DataFrame) -> DataFrame:
    """Links between a node that its hub refused and one that the hub accepted, where the two are not yet of one class
    and the triangle inequality allows a link: |d(a, hub) - d(c, hub)| is at most the distance that linked texts may have.
    A hub's refused and accepted nodes meet in blocks of at most about ``SMALL`` each, so a row goes to as many tasks as
    the other side has blocks; one link connects a node to the class of the hub, so a block gives one a node at most."""
    def root(side: str) -> DataFrame:
        return part.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    slack = lambda x, y: F.floor((1 - SIMILARITY) * F.greatest(x, y) + 1e-9)
    taken = tried.filter("linked").select("b", F.col("a").alias("fp"), "d", "n")
    far = taken.groupBy("b").agg(F.max("d").alias("e"), F.max("n").alias("o"), F.count("*").alias("accepted"))
    border = (tried.filter("not linked and d is not null").join(root("a"), "a", "left").join(root("b"), "b", "left")
              .filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).join(far, "b")
              .filter(F.col("d") - F.col("e") <= slack("n", "o"))
              .select("b", F.col("a").alias("fp"), "d", "n", "accepted", (F.col("d") - slack("n", "o")).alias("least")))
    border = _base.stored(border, "neardup-borders")
    sizes = border.groupBy("b").agg(F.count("*").alias("refused"), F.min("least").alias("least"))
    blocks = lambda count: F.ceil(F.col(count) / SMALL)
    own = lambda count: F.pmod(F.xxhash64("fp"), blocks(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), blocks(count) - 1))
    left = border.join(sizes.select("b", "refused"), "b").select(
        "b", "fp", "d", "n", F.lit(True).alias("refused_one"), own("refused").alias("x"), every("accepted").alias("y"))
    right = taken.join(sizes, "b").filter(F.col("d") >= F.col("least")).join(far.select("b", "accepted"), "b").select(
        "b", "fp", "d", "n", F.lit(False).alias("refused_one"), every("refused").alias("x"), own("accepted").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        refused = table["refused_one"].to_numpy()
        fps, texts = table["fp"].to_pylist(), [_words(w.as_buffer()) for w in table["words"].combine_chunks()]
        d, size = table["d"].to_numpy(), table["n"].to_numpy()
        out = []
        if refused.any() and not refused.all():
            longest = np.maximum.outer(size, size)
            most = ((1 - SIMILARITY) * longest + 1e-9).astype(np.int64)
            near = (longest - common_words(texts) <= most) & (np.abs(np.subtract.outer(d, d)) <= most) & ~refused[None, :]
            for i in np.flatnonzero(refused).tolist():
                for j in np.flatnonzero(near[i]).tolist():
                    if distance(texts[i], texts[j], int(most[i, j])) <= most[i, j]:
                        out.append((fps[i], fps[j]))
                        break
        return pa.table([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return left.unionByName(right).join(words, "fp").groupBy("b", "x", "y").applyInArrow(run, "a binary, b binary")


def _to_least(edges: DataFrame) -> DataFrame:
    """Small star: every node's neighbours, and the node, are linked to the least of them."""
    joined = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    return joined.select("a", F.col("m").alias("b")).unionByName(
        joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected parts of edges (a, b): rows (node, root), the root being the smallest node. As the edges lead from many
    nodes to few hubs, a first small star leaves hardly more edges than nodes. Then large stars and small stars
    alternate, each a grouped minimum, until no node has two edges and no root has one."""
    now = _base.stored(_to_least(edges.filter("a <> b")), "neardup-star")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        now = _base.stored(_to_least(_base.stored(large.filter("a <> b"), "neardup-star")), "neardup-star")
        more = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a") \
            .unionByName(now.join(now.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
        if more.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, class_id, copies (rows of its class), root (the class's own key) and text_key."""
    _base.bounded_batches(docs.sparkSession)
    rows = _base.stored(sketched(docs), "neardup-rows")
    nodes = _base.stored(rows.groupBy("fp").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("least"),
                                                F.count("*").alias("n"), F.min("sig").alias("sig"))
                         .withColumn("number", F.monotonically_increasing_id()), "neardup-nodes")
    # while keys are dealt, a node's stored number, which packs well, stands for its fingerprint
    keys = _base.stored(met(nodes.select(F.col("number").alias("fp"), F.explode("sig").alias("key"))), "neardup-keys")
    shared = keys.join(_alike(keys).select("key", "times"), "key").withColumnRenamed("fp", "number")
    buckets = _base.stored(shared.join(nodes.select("number", "fp"), "number").select("key", "fp", "times"), "neardup-buckets")
    wanted = nodes.join(buckets.select("fp").distinct(), "fp", "left_semi").select("text_key")
    words = _base.bucketed(_words_of(docs, wanted), "neardup-words", "fp")
    found, tried = links(buckets, words)
    part = components(found)
    more = _base.stored(border_links(tried, part, words), "neardup-border")
    if not more.isEmpty():
        part = components(part.toDF("a", "b").unionByName(more))
    rooted = nodes.join(part, nodes["fp"] == part["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    heads = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("copies"))
    named = _base.stored(rooted.join(heads, "root").select("fp", "root", "class_id", "copies"), "neardup-classes")
    return rows.join(named, "fp").select("doc_id", "class_id", "copies", "root", "text_key")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(_base.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays, the one with the smallest doc_id (of equal ids the smallest
    text hash; of wholly repeated rows any one). Rows are told by id and text hash: those that a Bloom filter of fixed size
    tells apart from all rows to drop pass straight through. Which others stay is found without their texts, and a second
    filter lets hardly any but these through to an exact join; so the texts of rows to drop don't move."""
    found = _base.stored(classes(docs), "neardup-verdicts")
    many = found.filter("copies > 1")
    heads = F.col("doc_id").eqNullSafe(F.col("class_id"))
    stays = many.filter(heads).groupBy("root").agg(F.min("text_key").alias("stay"))
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    name, own = (F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), key) for key in (F.col("text_key"), text))
    gone = many.join(stays, "root").filter(~heads | (F.col("text_key") != F.col("stay"))).select(name.alias("text_key")).distinct()
    gone = _base.stored(gone, "neardup-gone")
    may_go = _told(docs, gone)
    spared = _base.stored(found.select(name.alias("text_key")).filter(may_go(F.col("text_key"))).join(gone, "text_key", "left_anti").distinct(),
                          "neardup-spared")
    may_stay = _told(docs, spared)
    left = docs.filter(~may_go(own)).unionByName(
        docs.filter(may_go(own)).filter(may_stay(own)).join(spared, own == spared["text_key"], "left_semi"))
    again = _base.stored(found.groupBy(name.alias("text_key")).count().filter("count > 1").select("text_key"), "neardup-again")
    if again.isEmpty():
        return left
    repeated = _told(docs, again)
    return left.filter(~repeated(own)).unionByName(
        left.filter(repeated(own)).withColumn("_key", own).dropDuplicates(["_key"]).select(*docs.columns))
