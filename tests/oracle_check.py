"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_check.py [sf_dir] [name,name,...]
Compares row count, column names, column types (Spark vs DuckDB families)
and the order-insensitive multiset of row values.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(records):
    return sorted((tuple(norm(x) for x in r) for r in records), key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_FAMILY = {"LongType": "int", "IntegerType": "int", "ShortType": "int", "ByteType": "int",
                "DoubleType": "float", "FloatType": "float", "StringType": "str", "BooleanType": "bool",
                "TimestampNTZType": "ts", "TimestampType": "ts", "DateType": "date", "DecimalType": "dec"}
DUCK_FAMILY = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int!", "SMALLINT": "int", "TINYINT": "int",
               "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts",
               "DATE": "date"}
EXACT = {("LongType", "BIGINT"), ("IntegerType", "INTEGER"), ("DoubleType", "DOUBLE"), ("StringType", "VARCHAR"),
         ("BooleanType", "BOOLEAN"), ("TimestampNTZType", "TIMESTAMP"), ("DateType", "DATE")}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    t1 = time.time()
    res = con.sql(sql)
    dcols = res.columns
    dtypes = [str(t) for t in res.types]
    drows = res.fetchall()
    t2 = time.time()
    issues = []
    scols = sdf.columns
    if sorted(scols) != sorted(dcols):
        issues.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
        return issues, t1 - t0, t2 - t1, len(srows), len(drows)
    stypes = {f.name: type(f.dataType).__name__ for f in sdf.schema.fields}
    dt = dict(zip(dcols, dtypes))
    for c in sorted(scols):
        if (stypes[c], dt[c]) not in EXACT:
            issues.append(f"type {c}: {stypes[c]} vs {dt[c]}")
    if len(srows) != len(drows):
        issues.append(f"rows spark={len(srows)} duck={len(drows)}")
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = rows_of([[r[i] for i in si] for r in srows])
    b = rows_of([[r[i] for i in di] for r in drows])
    if a != b:
        diff = [x for x in a if x not in b][:3]
        diff2 = [x for x in b if x not in a][:3]
        issues.append(f"values differ: spark-only={diff} duck-only={diff2}")
    return issues, t1 - t0, t2 - t1, len(srows), len(drows)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from tierwise.config import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(qs)
    ok, bad = [], []
    for n in names:
        if n not in ors:
            print(f"SKIP {n} (rows-only)", flush=True)
            continue
        try:
            issues, ts, td, ns, nd = compare(spark, con, n, qs[n], ors[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            issues, ts, td, ns, nd = [f"ERROR {type(e).__name__}: {str(e)[:800]}"], 0, 0, -1, -1
        tag = "PASS" if not issues else "FAIL"
        (ok if not issues else bad).append(n)
        print(f"{tag} {n:22s} rows={ns}/{nd} spark={ts:.2f}s duck={td:.2f}s", flush=True)
        for i in issues:
            print("     " + i, flush=True)
    print(f"PASSED {len(ok)} FAILED {len(bad)}: {bad}", flush=True)


if __name__ == "__main__":
    main()
