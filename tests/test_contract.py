"""Typed contracts: what is missing, of another type, unreadable or extra."""

from tierwise.operators.schema import contract_differences


def test_differences(spark):
    df = spark.createDataFrame([(1, "7", 1.5, "x", "a", 1.0), (2, "z", None, None, "b", 2.0), (None, "", 2.0, "y", "c", 3.0)],
                               "id int, num string, part double, note string, `odd name` string, whole double")
    contract = [("ID", "int"), ("num", "number"), ("part", "int"), ("whole", "int"), ("note", "text"), ("gone", "text"),
                ("Odd Name", "number")]
    got = {r["column_name"]: tuple(r)[1:] for r in contract_differences(df, contract).collect()}
    assert got == {"ID": ("int", "int", None, 1, 0), "num": ("number", "string", "values", 0, 2),
                   "part": ("int", "double", "values", 1, 1), "whole": ("int", "double", None, 0, 0),
                   "note": ("text", "string", None, 1, 0), "gone": ("text", None, "missing", None, None),
                   "Odd Name": ("number", "string", "values", 0, 3)}


def test_type_extra_and_empty(spark):
    df = spark.createDataFrame([], "a string, b long, c long")
    got = {r["column_name"]: (r["problem"], r["n_null"], r["n_bad"]) for r in contract_differences(df, [("a", "int"), ("b", "text")]).collect()}
    assert got == {"a": ("type", 0, 0), "b": ("type", 0, 0), "c": ("extra", 0, 0)}
