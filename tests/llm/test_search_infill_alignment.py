"""Exact top-k search, fill-in-middle and tokenizer alignment: edge rows and brute force over whole results."""

import bisect
import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tierwise.llm import _base, alignment, infill, topk


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# ------------------------------------------------------------------------------------------------ exact top-k
VECTORS = "vec_id long, embedding array<double>"


def best(rows, k, scale):
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in whole if c != q and len(a) == len(b))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,scale", [(5, 256), (3, 1e6), (1, 4e8)])
def test_topk_is_exact(spark, monkeypatch, k, scale):
    rng = random.Random(k)
    rows = [(i, [rng.choice([rng.uniform(-3, 3), 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.5, -1.0, 2.0, 0.25]) for i in range(120)]  # equal vectors, some of them queries
    rows += [(50, [0.1, 0.2, 0.3, 0.4]), (7, [3.0, 3.0, 3.0, 3.0]), (7, [3.0, 3.0, 3.0, 3.0])]  # repeated ids
    rows += [(None, [9.0] * 4), (2000, None), (2050, [1.0, None, 1.0, 1.0]), (2100, [float("nan"), 1.0, 1.0, 1.0]),
             (2150, [float("inf"), 1.0, 1.0, 1.0]), (2200, []), (2201, []), (2250, [1.0, 2.0]), (2300, [1.0, 1.0, 1.0, 1.0, 1.0])]
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "ROWS", 16)
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(3), "block", "dim", "part", "cell", "score", "rank")
    got = topk.search(df, F.col("vec_id") % 50 == 0, k, scale)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(rows, k, scale)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], VECTORS)
    assert topk.search(df, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.filter("1 = 0"), F.lit(True)).count() == 0
    assert topk.search(spark.createDataFrame([(50, [1.0])], VECTORS), F.lit(True)).count() == 0


def test_topk_refuses_scores_beyond_long(spark):
    df = spark.createDataFrame([(50, [1e17, 1.0]), (51, [1e17, 1.0])], VECTORS)
    with pytest.raises(Exception, match="64"):
        topk.search(df, F.col("vec_id") % 50 == 0).collect()


# ------------------------------------------------------------------------------------------------ fill-in-middle
def filled(doc_id, text):
    text = text or ""
    units = text.split("\n")
    units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_of_edge_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice(["word ", "é\n", "中文 ", "\n", "<", "P>", "<S", "<M "]) for _ in range(60_000))
    texts = [None, "", "\n", "\n\n", "one", "one\n", "a\nb", "x<P>y", "<S>", "a <M", "S>\nM>", "<P", "é中😀\n中\n😀", "<\nP>",
             long, long, "shared\n" * 9000, "prefix " + "shared\n" * 9000, "\x00\n\r\n", "z" * 50_000, "z" * 50_000 + "<M>"]
    texts += ["".join(rng.choice("<PSM>\n é") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id\nhere"), (4, "one"), (4, "one")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n", "form", "output", "h1")
    out = infill.transform(df)
    back = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *filled(i, t), t or "") for i, t in rows]
    assert sorted((tuple(r) for r in back), key=str) == sorted(want, key=str)
    assert infill.transform(df.filter("1 = 0")).count() == 0


def test_marks_across_chunks_are_seen():
    text = b"".join(bytes([97 + i % 23]) * 3 for i in range(500))
    for at in range(0, 1400, 7):
        raw = text[:at] + b"<M>" + text[at:]
        for cut in (at + 1, at + 2):
            memo = infill.Memo([b"<P>", b"<S>", b"<M>"])
            assert infill.Counted(raw, 0, [cut, len(raw)], memo).marked
            assert infill.Counted(raw, 0, [max(1, at), cut, cut + 1, len(raw)] if at else [cut, cut + 1, len(raw)], memo).marked
    assert not infill.Counted(text, 0, [10, 11, len(text)], infill.Memo([b"<P>", b"<S>", b"<M>"])).marked


def test_shared_passages_share_chunks():
    rng = random.Random(9)
    passage = bytes(rng.randrange(32, 127) for _ in range(200_000))
    memo = infill.Memo([b"<P>"])
    raws = [bytes(rng.randrange(32, 127) for _ in range(5000 + i)) + passage for i in range(3)]
    for raw in raws:
        data = np.frombuffer(raw, np.uint8)
        ends = infill.cuts(data, np.array([0, len(data)]))[0]
        assert ends[-1] == len(raw) and max(np.diff([0, *ends])) <= infill.LARGEST
        c = infill.Counted(raw, 0, ends, memo)
        assert c.points[-1] == len(raw) and c.lines[-1] == 0
    assert memo.hits > 2 * 200_000 / infill.MEAN * 0.8
    small = infill.Memo([b"<P>"], most=4096)
    for raw in raws:
        c = infill.Counted(raw, 0, [*range(512, len(raw), 512), len(raw)], small)
        assert c.points[-1] == len(raw)
    assert len(small.known) < 20


# ------------------------------------------------------------------------------------------------ alignment
@pytest.fixture(scope="module")
def files():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(files, text, cache={}):
    """Both sides' (end, id) of the whole blank and text, or none where bytes differ."""
    if not cache:
        import sentencepiece
        from tokenizers import Tokenizer
        cache["a"] = Tokenizer.from_file(files[0])
        cache["a"].encode_special_tokens = True
        cache["b"] = sentencepiece.SentencePieceProcessor(model_file=files[1])
        cache["alphabet"] = alignment.byte_alphabet()
    if not text:
        return [], []
    a, b = cache["a"], cache["b"]
    left = [(i, bytes(cache["alphabet"][c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
             for i in b.encode(text)]
    out = []
    for side in (left, right):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        out.append([(int(e), i) for e, (i, _) in zip(np.cumsum([len(x) for _, x in side]), side)])
    return out


def aligned(files, rows):
    per, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = tokens(files, text)
        at_a, at_b = dict(a), dict(b)
        ends = sorted(at_a.keys() & at_b.keys())
        links = [(at_a[e], at_b[e]) for e in ends]
        counts.update(links)
        sides = []
        for side in (a, b):
            parts = [[] for _ in ends]
            for e, i in side:
                parts[bisect.bisect_left(ends, e)].append(str(i))
            sides.append([",".join(p) for p in parts])
        groups = ";".join(map("|".join, zip(*sides)))
        per.append((doc_id, len(a), len(b), len(ends), groups, links))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, n, g, hashlib.sha256(g.encode()).hexdigest() if g else "", len(links),
             sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)) for d, na, nb, n, g, links in per]


def test_alignment_against_brute_force(spark, files):
    rng = random.Random(1)
    odd = [(-1, "a  b \n c "), (-2, None), (-3, ""), (-4, " "), (-5, "  "), (-6, "\n\nx\n y  z 　 q"), (None, "no id"),
           (-7, "<|endoftext|> it's <s>x</s> <unk> ▁foo <0x41>"), (-8, "\x00a \x1c b\x85 c"), (-9, "one"), (-9, "one"),
           (-10, "don't 'tis we'll \t tab\tx  \n\n  end  "), (-11, "слово 中文 文字 é 😀 👍🏽 \r\n z"), (-12, "long " * 8_000 + "\n" * 999)]
    odd += [(-100 - i, "".join(rng.choice(" \n\t\r.,'ab éЖ中😀\xa0\x85<>s▁0") for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + odd
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "slice", "pair", "at", "total")
    got = alignment.scored(_base.stored(alignment.align(df, *files), "aligned"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(aligned(files, rows), key=str)


def test_alignment_query(spark, files):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((*w[:4], *w[5:]) for w in aligned(files, rows))
    assert sorted(map(tuple, alignment.op13_alignment(spark, SF).collect())) == want


def test_alignment_of_nothing(spark, files):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    got = alignment.scored(_base.stored(alignment.align(df, *files), "aligned")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, "", "", 0, 0, 0), (2, 0, 0, 0, "", "", 0, 0, 0)]
    assert alignment.scored(_base.stored(alignment.align(df.filter("1 = 0"), *files), "aligned")).count() == 0


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = random.Random(2)
    sides = []
    for _ in range(2):
        rows, at = [], 0
        for doc in range(40):
            stop = at + 30
            while at < stop:
                end = min(stop, at + rng.randint(1, 6))
                rows.append((doc, at, end))
                at = end
        sides.append(pd.DataFrame(rows, columns=["doc", "start", "end"]))
    a, b = sides
    i, j = alignment.overlaps(a, b)
    want = {(x, y) for x, (_, s, e) in enumerate(a.values.tolist()) for y, (_, t, f) in enumerate(b.values.tolist()) if s < f and t < e}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_units_forgotten_are_encoded_again(files, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 50)
    known = alignment.Units(*files)
    for lo in range(0, 400, 20):
        texts = pa.array([f"word{i} other{i % 7}, and\nmore{i}" for i in range(lo, lo + 20)])
        a, b, i, j = alignment._aligned(texts, known)
        want = [tokens(files, t) for t in texts.to_pylist()]
        assert a["id"].tolist() == [x for w in want for _, x in w[0]] and b["id"].tolist() == [x for w in want for _, x in w[1]]
    assert len(known.known) < 200
