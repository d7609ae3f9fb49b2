"""The operators against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF, SF01
from oracle_check import compare, duck
from tierwise.llm import (_base, chat, copying, decontaminate, language, licences, mixing, neardup, packing, quality, registry,
                          rollups, warc)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    issues, *_ = compare(spark, duck(SF), name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert not issues, issues


def test_registered():
    assert set(registry.QUERIES) | {"pipeline"} <= set(E.queries())
    assert {re.match(r"op(\d+)_", q)[1] for q in registry.QUERIES} == set(map(str, range(1, 14)))


# ------------------------------------------------------------------------------------------------ helpers
def test_words_do_not_depend_on_slices(texts):
    column = pa.array(list(texts.values()))
    whole = [_base.words_of(column, _base.NOT_ALNUM, kind)[0].to_pylist() for kind in ("", "ascii", "utf8")]
    for words, kind in zip(whole, ("", "ascii", "utf8")):
        cut = [w for lo, hi in _base.slices(column, 5000) for w in _base.words_of(column.slice(lo, hi - lo), _base.NOT_ALNUM, kind)[0].to_pylist()]
        assert cut == words
    assert whole[1] == [w for t in texts.values() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))]


# ------------------------------------------------------------------------------------------------ decontamination
def test_whole_passages_are_found(spark, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op2_decontaminate(spark, SF).collect()}
    assert got >= {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t}


def test_substituted_words_are_tolerated(spark, texts):
    random.seed(5)
    vocabulary = [w for t in list(texts.values())[:50] for w in t.split()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = []
    for r in bench.collect():
        passage = [random.choice(vocabulary) if i % 7 == 6 else w for i, w in enumerate(r.text.split())]
        rows.append((r.item_id, " ".join(random.sample(vocabulary, 60) + passage + random.sample(vocabulary, 40))))
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert found.filter("doc_id = item_id").count() == len(rows)
    assert found.count() == len(rows)


def stretches(doc, item, least):
    """Longest (length, matches, doc start, item start) over all diagonals and all stretches with enough equal words."""
    best = None
    for d in range(-len(item) + 1, len(doc)):
        lo, hi = max(d, 0), min(d + len(item), len(doc))
        equal = [doc[i] == item[i - d] for i in range(lo, hi)]
        total = [0]
        for e in equal:
            total.append(total[-1] + e)
        for a in range(len(equal)):
            for b in range(a + least, len(equal) + 1):
                if equal[a] and equal[b - 1] and total[b] - total[a] >= decontaminate.IDENTITY * (b - a) - 1e-9:
                    found = (b - a, total[b] - total[a], -(lo + a), lo + a - d)
                    best = max(best or found, found)
    return best


def test_passages_between_substitutions_are_found(spark):
    """Overlaps against all diagonals and stretches, with items of which only pieces are left."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (46, 46, 30, 12, 9, 7, 120)]
    docs = []
    for n in range(60):
        doc = rng.choices(vocabulary, k=rng.randint(0, 40))
        for item in rng.sample(items, 2):
            kept = [w if (p := rng.random()) > 0.12 else rng.choice(vocabulary) for w in item]
            if n % 3 == 0:  # pieces of which each is long enough, but not all together
                for lo in range(12, len(kept), 17):
                    kept[lo:lo + 5] = rng.choices(vocabulary, k=len(kept[lo:lo + 5]))
            doc += kept + rng.choices(vocabulary, k=rng.randint(0, 9))
        docs.append(doc)
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.length, r.matches, r.doc_start, r.item_start) for r in decontaminate.contaminated(frame, bench).collect()}
    least = [max(decontaminate.LEAST_WORDS, min(decontaminate.MIN_WORDS, len(t))) for t in items]
    want = {(i, k): (s[0], s[1], -s[2], s[3]) for i, d in enumerate(docs) for k, t in enumerate(items) if (s := stretches(d, t, least[k]))}
    assert not any(k == 5 for _, k in got)
    assert all(want[pair] == found for pair, found in got.items())
    # a stretch is missed only where no mask fits between its substitutions
    assert len(want) - len(got) <= 0.03 * len(want) and len(want) > 60


# ------------------------------------------------------------------------------------------------ quality
def test_cutoffs_follow_the_group(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(("x" * rng.randint(*((4, 6) if i % 2 else (9, 11)))) + str(rng.randint(0, 9)) for _ in range(80)), "en", "short" if i % 2 else "long")
            for i in range(800)]
    rows += [(9001, rows[0][1], "en", "short"), (9002, rows[1][1], "en", "long")]
    got = {r.row.doc_id: r for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id").collect()}
    assert all(got[i].kept for i in range(800))
    assert not got[9001].kept and not got[9002].kept  # normal in one source, odd in the other
    assert not got[9001].base_failed and not got[9002].base_failed


def test_cutoffs_of_the_documents_differ(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    limits = quality.thresholds(quality.sketch(quality.measure(docs))).toPandas()
    assert limits["cut_mean_word_milli"].nunique() > 1 and limits["cut_mean_word_milli_low"].nunique() > 1


# ------------------------------------------------------------------------------------------------ WARC
def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    want = {}
    for p in pages:
        raw, head = (p.html or "").encode(), first[p.html or ""]
        want[p.page_id] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                           *(("response", None) if head == p.page_id else ("revisit", head)), p.url)
    assert {r.page_id: tuple(r)[1:] for r in warc.op3_warc(spark, SF).collect()} == want


def test_warc_pushes_filters_and_skips_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "one"), (2, "http://b/y", "two"), (3, "http://a/z", "one")],
                                  "page_id long, url string, html string")
    warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    some = read.filter("target_uri like 'http://a/%' and record_type in ('response', 'revisit')")
    assert "StartsWith" not in some._jdf.queryExecution().executedPlan().toString()
    assert {(r.record_id, bytes(r.payload) if r.payload is not None else None) for r in some.collect()} == {("1", b"one"), ("3", None)}
    assert [r.payload for r in warc.read_warc(spark, str(tmp_path / "w"), payload=False).filter("record_type = 'response'").collect()] == [None, None]


def test_members_are_plain_gzip():
    import gzip
    row = {"record_id": "7", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "X",
           "payload_bytes": 3, "payload": b"abc"}
    raw = gzip.decompress(warc.member(row) * 2)
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"Content-Length: 3\r\n\r\nabc\r\n\r\n")


# ------------------------------------------------------------------------------------------------ rollups
def test_rollup_commits_once_and_compacts(spark, tmp_path):
    book = rollups.Rollup(spark, str(tmp_path / "r"))
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, extra int"
    one = spark.createDataFrame([("insert", "a", "en", "t", 5, None, 1), ("insert", "a", "en", "t", None, None, 1),
                                 (None, "a", "en", "t", 9, None, 1), ("insert", None, None, None, 2, None, 1)], kind)
    two = spark.createDataFrame([("revise", "a", "en", "t", 8, 5, 1), ("delete", None, None, None, 2, None, 1)], kind)
    assert book.commit("1", one) and not book.commit("1", one) and book.commit("2", two)
    want = {("a", "en", "t", 2, 8, 1), (None, None, None, 0, 0, 0)}
    assert set(map(tuple, book.totals().collect())) == want
    book.compact()
    assert set(map(tuple, book.totals().collect())) == want
    assert not book.commit("2", two) and book.commit("3", one.limit(0))
    # an attempt that was not entered into the log counts for nothing
    one.limit(1).selectExpr("source", "lang", "tokenizer", "1L n_docs", "1L n_tokens", "0L n_ignored", "'lost' delta") \
        .write.mode("append").partitionBy("delta").parquet(book.deltas)
    assert set(map(tuple, rollups.Rollup(spark, str(tmp_path / "r")).totals().collect())) == want


# ------------------------------------------------------------------------------------------------ language model
def test_mixing_against_brute_force(spark, texts):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = collections.Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for r in mixing.op5_mixing(spark, SF).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0 and 0 < r.bits_per_byte < 8


def test_copy_predictions_against_brute_force():
    """For every anchor: the run seen most often behind its context in other training texts."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 60
        context, held = rng.integers(0, 6, n).astype(np.uint64), rng.random(n) < 0.3
        runs = [tuple(rng.integers(0, 2, rng.integers(1, 4)).tolist()) for _ in range(n)]
        same, other, size, agreed = copying.predicted(context, held, np.array([len(r) for r in runs]), np.array(sum(runs, ()), np.uint32))
        for i in range(n):
            seen = collections.Counter(runs[j] for j in range(n) if context[j] == context[i] and not held[j])
            most = max(seen.values(), default=0)
            own = 0 if held[i] else 1
            candidates = [r for r, k in seen.items() if k == most] or [None]
            options = set()
            for r in candidates:
                mine = own if runs[i] == r else 0
                if r is None:
                    options.add((0, 0))
                    continue
                agree = next((k for k, (x, y) in enumerate(zip(r, runs[i])) if x != y), min(len(r), len(runs[i])))
                options.add((most - mine, sum(seen.values()) - most - (own - mine), len(r), agree))
            got = (int(same[i]), int(other[i]), int(size[i]), int(agreed[i]))
            assert got in options or (got[0] == 0 and (0, 0) in options), (got, options)


def test_copied_passages_cost_less(spark, texts):
    """A held-out copy of a training text is far cheaper than its words one by one."""
    long = max(texts.items(), key=lambda kv: len(kv[1]))
    rows = [(d, t) for d, t in texts.items()] + [(10_000, long[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = mixing.score(df, F.col("doc_id") != 10_000).filter("doc_id = 10000").first()
    assert r.score > 0.8 * r.base_score


def test_spelling_is_a_distribution():
    """The probabilities of all two-byte codes add up to one: each byte's code is complete."""
    code = mixing.Code(np.bincount(np.frombuffer(b"some bytes to count", np.uint8), minlength=256))
    assert sum(2.0 ** -code.sizes) == 1.0
    words = pa.array(["ab", "", "é"], pa.large_string())
    spelling = mixing.Spelling(code, words)
    assert np.bincount(spelling.word).tolist() == [sum(code.sizes[b] for b in w.encode() + b" ") for w in ("ab", "", "é")]


# ------------------------------------------------------------------------------------------------ language id
def test_language_held_out_accuracy(spark):
    got = language.op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 6, 4)
        score = rng.normal(0, 6, (sizes.sum(), 3))
        starts = np.cumsum(sizes) - sizes
        path = language.viterbi(score, starts, sizes)
        for a, n in zip(starts, sizes):
            def value(p):
                return sum(score[a + i, l] for i, l in enumerate(p)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
            best = max(map(value, np.array(np.meshgrid(*[range(3)] * n)).T.reshape(-1, n)))
            assert math.isclose(value(path[a:a + n].tolist()), best)


def test_mixed_text_has_spans(spark):
    docs = language._typed(spark.read.parquet(f"{SF}/documents.parquet"))
    parts = {}
    for r in docs.filter("length(text) > 800").collect():
        parts.setdefault(r.lang, " ".join(r.text.split()[:40]))
    mixed = spark.createDataFrame([(-1, " ".join(parts.values()), None)], docs.schema)
    r = language.identify(docs.unionByName(mixed), F.col("doc_id") >= 0).filter("doc_id = -1").first()
    assert {s.lang for s in r.spans if s.words >= 20} == set(parts)


# ------------------------------------------------------------------------------------------------ chat
def test_reply_tree(spark):
    rows = [("t", "a", None, "user", "hi", 1.0), ("t", "b", "a", "assistant", "yes", 0.2), ("t", "c", "a", "assistant", "no", 0.9),
            ("t", "d", "b", "user", "ok", 5.0), ("t", "e", "c", "user", "why", None), ("x", "q", "gone", "assistant", "orphan", 0.0),
            ("y", "m", "n", "user", "cycle", 0.0), ("y", "n", "m", "user", "cycle", 0.0), ("y", "o", "n", "user", "cycle", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, id string, parent string, role string, text string, score double")
    every = {r.leaf: (r.root, r.rank, [t.text for t in r.turns], r.loss_text) for r in chat.parsed(chat.formatted(messages, None)).collect()}
    assert every == {"d": ("a", 1, ["hi", "yes", "ok"], "yes"), "e": ("a", 2, ["hi", "no", "why"], "no"), "q": ("q", 1, ["orphan"], "orphan")}
    assert {r.leaf for r in chat.formatted(messages).collect()} == {"d", "q"}


def test_deep_chain(spark):
    rows = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                   F.col("id").cast("string").alias("text"))
    r = chat.parsed(chat.formatted(chat.linear(rows))).first()
    assert [t.text for t in r.turns] == list(map(str, range(300)))


def test_escaping(spark):
    random.seed(4)
    texts = ["".join(random.choice("\\<|a>") for _ in range(random.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    assert df.filter(F.col("e").contains("<|")).count() == 0
    assert df.filter(chat.unescape(F.col("e")) != F.col("t")).count() == 0


# ------------------------------------------------------------------------------------------------ packing
def test_packing_is_exact(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for d, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            want[d, p // 2048] = (p, len(ids[p:p + 2048]), zlib.crc32(np.array(ids[p:p + 2048], "<u4").tobytes()))
    got = packing.op8_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    odd = ["<|ENDOFTEXT|> A.B,c! <|endoftext|>. D", "İ. É, é! don'T, I'LL. x!!", "\x1cfoo\x85bar", "", None]
    column = pa.array(["filler"] + odd)
    ids, counts = packing.token_ids(column.slice(1), path)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == tokenizer.encode(odd[0], add_special_tokens=False).ids + [0]
    assert ids.tolist() == [i for t in odd for i in tokenizer.encode(t or "", add_special_tokens=False).ids + [0]]


def test_best_fit_against_brute_force():
    random.seed(1)
    fit, bins, new = packing.BestFit(10, 3, 0), {}, 0
    for _ in range(2000):
        size = random.randrange(1, 11)
        fitting = [(free, b) for b, free in bins.items() if free >= size]
        number, offset = fit.place(size)
        if fitting:
            assert bins[number] == min(fitting)[0] and offset == 10 - bins[number]
        else:
            assert number == new and offset == 0
            new += 1
        bins[number] = 10 - offset - size
        if not bins[number]:
            del bins[number]
        if len(bins) > 3:
            fullest = min(bins.values())
            gone = set(bins) - {b for held in fit.bins for b in held}
            assert len(gone) == 1 and bins[gone.copy().pop()] == fullest
            del bins[gone.pop()]


# ------------------------------------------------------------------------------------------------ near duplicates
def test_banded_distance():
    random.seed(3)
    for _ in range(3000):
        kinds = random.choice([2, 4, 20])
        a, b = ([random.randrange(kinds) for _ in range(random.randrange(14))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        limit = random.randrange(16)
        assert neardup.distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == min(row[-1], limit + 1)


def brute_classes(texts):
    words = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for d, t in texts.items()}
    number, codes = {}, {}
    for d, w in words.items():
        codes[d] = np.array([number.setdefault(x, len(number)) for x in w], np.uint32)
    parent = {d: d for d in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in words:
        for b in words:
            if a < b and neardup.distance(codes[a], codes[b], most := neardup.allowed(len(codes[a]), len(codes[b]))) <= most:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in words}


def test_classes_against_all_pairs(spark, texts):
    assert {r.doc_id: r.class_id for r in neardup.op9_neardup(spark, SF).collect()} == brute_classes(texts)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Many texts of one long passage: buckets with members that the hub refuses, in several levels."""
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = random.choices(vocabulary, k=60)
    rows = []
    for i in range(60):
        text = random.choices(vocabulary, k=14) + passage + random.choices(vocabulary, k=14)
        rows.append((2 * i, " ".join(text)))
        text[random.randrange(len(text))] = "other"
        rows.append((2 * i + 1, " ".join(text)))
    monkeypatch.setattr(neardup, "SMALL", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == brute_classes(dict(rows))


def test_borders_are_linked_through_accepted_nodes(spark, monkeypatch):
    """Nodes that the hub refused, each near one that it accepted; a far one stays alone. Several blocks a side."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    hub = np.arange(100, dtype=np.uint32)
    texts, rows = {b"hub": hub}, []
    for i in range(8):
        accepted, refused = hub.copy(), hub.copy()
        accepted[:15] = 1000 + 100 * i + np.arange(15)
        refused[:15] = accepted[:15]
        refused[40:52] = 5000 + 100 * i + np.arange(12)
        texts[b"c%d" % i], texts[b"a%d" % i] = accepted, refused
    texts[b"z"] = np.concatenate([hub[:70], np.arange(9000, 9030, dtype=np.uint32)])
    for name, text in texts.items():
        if name != b"hub":
            d = neardup.distance(text, hub, 1000)
            rows.append((name, b"hub", d, d <= 20, len(text)))
    tried = spark.createDataFrame(rows, "a binary, b binary, d int, linked boolean, n int")
    part = spark.createDataFrame([(b"c%d" % i, b"a hub") for i in range(8)] + [(b"hub", b"a hub")], "node binary, root binary")
    words = spark.createDataFrame([(k, v.tobytes()) for k, v in texts.items()], "fp binary, words binary")
    got = {(bytes(r.a), bytes(r.b)) for r in neardup.border_links(tried, part, words).collect()}
    assert got == {(b"a%d" % i, b"c%d" % i) for i in range(8)}


def planted(kind, n, share, rng):
    """A text of n random words and its copy at a word edit distance of at most share of the longer one."""
    a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
    b, edits = a.copy(), int(share * n + 1e-9)
    if kind == "random":
        b[rng.choice(n, edits, False)] = rng.integers(0, 2 ** 63, edits).astype(np.uint64)
    elif kind == "regular":
        b[np.arange(edits) * n // edits] = rng.integers(0, 2 ** 63, edits).astype(np.uint64)
    else:
        more = rng.integers(0, 2 ** 63, int(n * share / (1 - share) + 1e-9)).astype(np.uint64)
        b = np.concatenate([more, a] if kind == "before" else [a, more])
    return a, b


@pytest.mark.parametrize("kind", ["random", "regular", "before", "after"])
@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_candidates_at_the_threshold(kind, share):
    """Planted pairs at edit similarity 0.9, 0.85 and 0.8 share a sketch."""
    rng = np.random.default_rng(5)
    for n in (40, 100, 300, 1000):
        pairs = [planted(kind, n, share, rng) for _ in range(100)]
        a, b = (neardup.sketches(np.concatenate(x), np.array([len(t) for t in x]))[0] for x in zip(*pairs))
        assert (a == b).any(1).sum() >= 97


def test_linked_at_the_threshold(spark):
    """Words substituted all over the text, and words added on one side, are linked as all pairs say."""
    rng, rows = np.random.default_rng(6), []
    for kind in ("random", "regular", "before", "after"):
        for n in (60, 200):
            for share in (0.1, 0.15, 0.2):
                rows += [(len(rows) + i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(planted(kind, n, share, rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(dict(rows))
    assert sum(d != c for d, c in want.items()) == len(rows) // 2
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want


def test_large_refused_buckets_are_compared_whole(spark, monkeypatch):
    """Pairs at edit similarity 0.85 to 0.9 that share one bucket only, with many others that every hub refuses."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng, texts = np.random.default_rng(7), []
    for i in range(15):
        texts += planted("random", 40, (0.1, 0.15)[i % 2], rng)
    words = {b"%03d" % i: (t % 2 ** 32).astype(np.uint32) for i, t in enumerate(texts)}
    buckets = spark.createDataFrame([(1, k, 1) for k in words], "key long, fp binary, times long")
    table = spark.createDataFrame([(k, w.tobytes()) for k, w in words.items()], "fp binary, words binary")
    found, tried = neardup.links(buckets, table)
    part = neardup.components(found)
    both = found.unionByName(neardup.border_links(tried, part, table)).collect()
    assert {tuple(sorted((int(r.a), int(r.b)))) for r in both} == {(2 * i, 2 * i + 1) for i in range(15)}


def short_pairs():
    for n in range(1, neardup.SHORT + 1):
        a, other = np.arange(1, n + 1, dtype=np.uint64), np.arange(100, 103, dtype=np.uint64)
        for k in range(1, 3):
            yield from ((a, np.concatenate(x)) for x in ((a, other[:k]), (other[:k], a)))
            for at in range(n - k + 1):
                b = a.copy()
                b[at:at + k] = other[:k]
                yield a, b
                yield a, np.concatenate([b[1:], other[2:]])


def test_short_texts_are_candidates():
    """Every linked pair of short texts with words appended, prepended, substituted or shifted has a bucket in common."""
    checked = 0
    for a, b in short_pairs():
        most = neardup.allowed(len(a), len(b))
        if len(b) <= neardup.SHORT and neardup.distance(a.astype(np.uint32), b.astype(np.uint32), most) <= most:
            keys, owner = neardup.deletions(_base.mixed(np.concatenate([a, b])), np.array([len(a), len(b)]))
            assert set(keys[owner == 0]) & set(keys[owner == 1])
            checked += 1
    assert checked > 150


def test_short_texts_against_all_pairs(spark):
    rows = [" ".join(f"t{number // 4}w{x}" for x in t) for number, pair in enumerate(short_pairs()) if number % 4 == 0 for t in pair]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == brute_classes(dict(enumerate(rows)))


def test_components(spark):
    random.seed(8)
    edges = [(f"{a:04d}", f"{a + 1:04d}") for a in range(0, 60) if a % 20] + [(f"{random.randrange(100, 160):04d}", f"{random.randrange(100, 160):04d}") for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# ------------------------------------------------------------------------------------------------ licences
def test_base_phrases(spark, texts):
    for r in licences.op10_licences(spark, SF).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(texts[r.doc_id]))
        places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_matching_statistics():
    random.seed(1)
    for _ in range(200):
        templates = [random.choices("abc", k=random.randrange(1, 12)) for _ in range(3)]
        automaton = licences.Automaton({}, [(str(i), " ".join(t)) for i, t in enumerate(templates)])
        query = random.choices("abc", k=20)
        for i, (length, state) in enumerate(automaton.statistics([automaton.vocabulary.get(c, -1) for c in query])):
            ends = {n: sorted((k, p) for k, t in enumerate(templates) for p in range(n - 1, len(t)) if t[p + 1 - n:p + 1] == query[i + 1 - n:i + 1])
                    for n in range(1, i + 2)}
            assert length == max((n for n in ends if ends[n]), default=0)
            assert not length or sorted(automaton.ends[state]) == ends[length]


def test_edited_templates_are_covered(spark):
    rows = [(i, " ".join(["foo bar of the"] * 20 + [re.sub("Software|License", "Thing", t, count=1) if len(t) > 200 else t] + ["the end of"] * 5))
            for i, (_, t) in enumerate(licences.TEMPLATES)]
    for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(s.label, s.first_word) for s in r.spans if s.first_word == 80] == [(licences.TEMPLATES[r.doc_id][0], 80)]


# ------------------------------------------------------------------------------------------------ pipeline
def test_pipeline(spark, texts):
    """Each stage against its own brute force on the rows it gets, then the packed rows of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in registry.QUERIES["op1_quality"](spark, SF).filter("kept").collect()}
    docs = _base.stored(docs.filter(F.col("doc_id").isin(*kept)), "test")
    spoken = {r.doc_id for r in language.identify(language._typed(docs), _base.crc_mod("doc_id", 5) != 0).collect()
              if r.lang_pred != "und" and r.score >= language.KEEP_SCORE}
    heads = set(brute_classes({d: texts[d] for d in spoken}).values())
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in heads if not any(b in texts[d] for b in bench)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean
    want = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.op8_packing(spark, SF).collect() if r.doc_id in clean}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
