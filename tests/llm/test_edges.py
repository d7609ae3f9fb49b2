"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from tierwise.llm import (chat, decontaminate, language, licences, mixing, neardup, packing, quality, rollups, warc,
                          _base)

LONG = " ".join(f"word{i % 997} of{i % 13} the{i % 7}" for i in range(40_000))
ROWS = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, "a"), (4, LONG, "en", "a"), (5, "une phrase de la", "fr", None),
        (6, "the same text twice over", "en", "a"), (6, "the same text twice over", "en", "a"), (None, "no id here at all", None, None),
        (None, None, None, None), (8, "éè 中文 рус", "fr", "b"), (9, "12 34 ---", "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """The edge rows with columns that clash with names the operators use."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("row", "kept", "n_words", "score", "lang_pred", "_key", "_id", "fp", "class_id", "token", "slice", "piece", "key"):
        df = df.withColumn(name, F.lit("x"))
    return _base.stored(df, "edges")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("1 = 0")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=lambda x: x if isinstance(x, str) else "")
def test_stage_keeps_columns(spark, docs, none, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r.doc_id for r in got} <= {r[0] for r in ROWS}
    assert stage(spark, none, SF).count() == 0


def test_quality(docs, none):
    rows = [(r.row.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.rules(docs, "doc_id").collect()]
    assert len(rows) == len(ROWS)
    assert (1, 0, True, False) in rows and (2, 0, True, False) in rows and (3, 0, True, False) in rows
    assert rows.count((6, 5, True, False)) == 2
    assert [r[1] for r in rows if r[0] == 4] == [120_000]
    assert quality.rules(none, "doc_id").count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, LONG[2000:2300]), (2, None), (3, ""), (None, LONG[500:700]), (4, "too short")],
                                  "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(4, 1), (4, None)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.filter("1 = 0")).count() == 0


def test_decontamination_stage_spares_other_rows_without_id(spark):
    text = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    df = spark.createDataFrame([(None, f"some words {text} and more", "en", "a"), (None, "clean", "en", "a")], SCHEMA)
    assert [r.text for r in decontaminate.stage(spark, df, SF).collect()] == ["clean"]


def test_warc(spark, none, tmp_path):
    pages = spark.createDataFrame([(1, "u\r\n v% ", "<p>é</p>"), (2, None, None), (3, "u", ""), (None, "u", "<p>é</p>"),
                                   (5, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (7, "u", LONG)],
                                  "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "a")
    warc.write_warc(warc.page_records(pages), path)
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.target_uri) for r in warc.read_warc(spark, path).collect()}
    n = len("<p>é</p>".encode())
    assert got == {("1", "response", None, n, "u\r\n v% "), ("2", "response", None, 0, None), ("3", "revisit", "2", 0, "u"),
                   (None, "revisit", "1", n, "u"), ("5", "revisit", "1", n, "u"), ("1", "response", None, n, "u"),
                   ("7", "response", None, len(LONG), "u")}
    empty = str(tmp_path / "b")
    warc.write_warc(warc.page_records(pages.filter("1 = 0")), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_language(docs, none):
    got = language.identify(language._typed(docs), F.col("lang").isNotNull()).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {1, 2, 3, 9}
    assert all(0 <= r.score <= 1 for r in got)
    untaught = language.identify(language._typed(docs), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    assert language.identify(language._typed(none), F.lit(True)).count() == 0


def test_packing(docs, none):
    import public_tokenizers
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert [r.length for r in got if r.doc_id == 1] == [1]
    assert packing.pieces(none).count() == 0


def test_neardup(spark, docs, none):
    got = [(r.doc_id, r.class_id, r.copies) for r in neardup.classes(docs).collect()]
    assert len(got) == len(ROWS)
    assert got.count((6, 6, 2)) == 2
    empty = [r for r in got if r[1] == 1]  # 1, 2, 3 and the row without id and text have no word
    assert sorted(empty, key=str) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (None, 1, 4)]
    assert (None, None, 1) in got
    assert neardup.classes(none).count() == 0
    assert neardup.stage(spark, docs, SF).count() == len({r[1] for r in got})


def test_licences(docs, none):
    got = licences.licences(docs).collect()
    assert len(got) == len(ROWS) and not any(r.places or r.spans for r in got)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert licences.licences(none).count() == 0


def test_mixing(docs, none):
    typed = docs.select("doc_id", "text")
    got = mixing.score(typed, F.coalesce(F.col("doc_id"), F.lit(0)) != 6).collect()
    assert len(got) == len(ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.score < 0 for r in got)
    neutral = mixing.score(typed, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in neutral} == {(0, 0, 0.0)}
    assert mixing.score(none.select("doc_id", "text"), F.lit(True)).count() == 0


def test_chat(spark):
    rows = spark.createDataFrame([(1, 1, "user", None), (1, 1, "user", None), (1, 2, None, "<|end|>"), (None, 1, "assistant", "\\<|"),
                                  (2, None, "assistant", LONG)], "conv_id long, turn long, role string, text string") \
        .withColumn("id", F.lit("x")).withColumn("leaf", F.lit("x"))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat.parsed(chat.formatted(chat.linear(rows))).collect()}
    assert got == {1: [("user", ""), ("user", ""), ("", "<|end|>")], None: [("assistant", "\\<|")], 2: [("assistant", LONG)]}
    assert chat.formatted(chat.linear(rows.filter("1 = 0"))).count() == 0


def test_rollup_counts(docs, none):
    got = {(r.doc_id, r.blank, r.lettered, r.alnum) for r in rollups.counted(docs).collect()}
    assert (1, 0, 0, 0) in got and (9, 3, 2, 2) in got and (4, 120_000, 120_000, 120_000) in got
    assert rollups.counted(none).count() == 0
