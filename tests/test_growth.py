"""Steps whose work once grew faster than it needs: bins by binary search, one kept entry a row, questions routed once."""

import math

from pyspark.sql import functions as F

from conftest import SF
from tierwise.operators import ask, boosting, explain
from tierwise.plans import catalog
from tierwise.plans.workbench import Workbench
from tierwise.constants import KEY_COL


def test_bins_are_the_number_of_edges_at_or_below(spark):
    values = [None, float("nan"), float("-inf"), float("inf"), -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 7.0]
    df = spark.createDataFrame([(v, None if v is None or not math.isfinite(v) else int(v), 0) for v in values], "`a.b` double, c int, label int")
    edges = {"a.b": [0.0, 1.0, 2.0], "c": [1.0], "label": []}
    rows = boosting.binned(df, edges, "label")
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()

    def number(v, at):
        return 0 if v is None else len(at) if math.isnan(v) else sum(v >= e for e in at)
    want = [[number(v, edges["a.b"]), number(None if v is None or not math.isfinite(v) else int(v), edges["c"]), 0] for v in values]
    assert sorted(r.bins for r in rows.collect()) == sorted(want)


def test_kept_explanations_are_one_entry_a_row(spark, tmp_path):
    wb = Workbench(spark, SF)
    store = explain.RowPhiStore(spark, str(tmp_path))
    long = store.of(wb.train, wb.fixed_a, KEY_COL)
    plain = explain.phi_long(wb.train, wb.fixed_a, KEY_COL)
    assert long.columns == plain.columns and sorted(map(tuple, long.collect())) == sorted(map(tuple, plain.collect()))
    kept = spark.read.parquet(*map(str, tmp_path.glob("*/*")))
    assert kept.count() == kept.select("row_id").distinct().count() == wb.train.count()


def test_questions_go_through_the_patterns_once(spark, monkeypatch):
    calls, route = [], ask.route
    monkeypatch.setattr(ask, "route", lambda q: calls.append(1) or route(q))
    for name in ("answer_compare", "prompt_text"):
        calls.clear()
        plan = catalog.REGISTRY[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert len(calls) == 1 and "conversations.parquet" not in plan and "RLIKE" not in plan, name
