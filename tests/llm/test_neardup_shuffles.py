"""Near dedup deals its keys once and leaves the words where they are."""
import collections
import random

import numpy as np

from tierwise.llm import _base, neardup


def test_keys_are_dealt_once(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(40), bytes([rng.randrange(90)])) for _ in range(60)})
    found = neardup.met(spark.createDataFrame(rows, "key long, fp binary"))
    often = collections.Counter(k for k, _ in rows)
    assert sorted((r.key, bytes(r.fp)) for r in found.collect()) == [r for r in rows if often[r[0]] > 1]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple").split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_words_stay(spark):
    """Comparisons move the pairs, and the words of hubs, but not all words."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = {bytes([i]): np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10 + i % 3], np.uint32) for i in range(20)}
        words = _base.bucketed(spark.createDataFrame([(k, v.tobytes()) for k, v in texts.items()], "fp binary, words binary"), "words", "fp")
        pairs = spark.createDataFrame([(bytes([i]), bytes([j])) for i in range(20) for j in (0, 7) if i != j], "a binary, b binary")
        found = neardup._compared(pairs, words)
        got = {(bytes(r.a), bytes(r.b)): (r.d, r.linked) for r in found.collect()}
        assert got == {(bytes([i]), bytes([j])): (int(i % 3 != j % 3), True) for i in range(20) for j in (0, 7) if i != j}
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple").split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _exchanged(node):
    """Bytes that the exchanges of an executed plan moved."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _exchanged(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return _exchanged(node.plan())
    own = node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0
    return own + sum(_exchanged(node.children().apply(i)) for i in range(node.children().size()))


def test_dropped_texts_stay(spark):
    """The stage finds out without their texts which documents to drop; also copies under one text, ids repeated or null."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(6)
        texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(3)]
        rows = [(10 * i + j, f"{t} end{j % 2}") for i, t in enumerate(texts) for j in range(8)]
        rows += [(None, "null id one"), (None, "null id one"), (7, "short text here"), (7, "quite another short text of one id"), (90, None)]
        left = neardup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").select("doc_id", "text")
        got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
        assert got == sorted([(10 * i, f"{t} end0") for i, t in enumerate(texts)] + [(7, "short text here"), (90, None),
                             (7, "quite another short text of one id"), (None, "null id one")], key=str)
        moved = _exchanged(left._jdf.queryExecution().executedPlan())
        assert 0 < moved < sum(len(t) for t in texts)  # seven of eight copies are dropped
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
