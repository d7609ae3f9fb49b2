"""Readers for input tables (A1, A2, A4) and the expected-schema contracts."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .xlsx import read_xlsx

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; parquet keeps column pruning and filter pushdown."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A1: load a table by file extension (xlsx, csv with header, parquet, json).

    Returns ``None`` on an unreadable or unsupported file, like the reference.
    An explicit ``schema`` avoids the extra inference pass over large CSV.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    try:
        if ext == ".csv":
            r = spark.read.option("header", True)
            r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
            return r.csv(path)
        if ext == ".xlsx":
            return read_xlsx(spark, path, schema)
        if ext == ".parquet":
            return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
        if ext in (".json", ".jsonl"):
            return spark.read.json(path, schema=schema)
        if not ext:
            return spark.read.parquet(path)
    except AnalysisException:  # missing or unreadable -> None; faults of the cluster still show
        return None
    return None


def load_inputs(spark: SparkSession, internal_path: str, external_path: str,
                unseen_path: str | None = None) -> dict[str, DataFrame | None]:
    """A2: internal + external are required, unseen optional."""
    out = {"internal": load_table(spark, internal_path), "external": load_table(spark, external_path),
           "unseen": load_table(spark, unseen_path) if unseen_path else None}
    missing = [k for k in ("internal", "external") if out[k] is None]
    if missing:
        raise ValueError(f"required input(s) could not be read: {missing}")
    return out


# --- B8: expected contracts of the credit tables ----------------------------
def contract_diff(df: DataFrame, required: list[str]) -> list[str]:
    """Names in ``required`` that ``df`` lacks (case-insensitive), in order."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]
