"""Sinks and persistence: scored CSV (A6), model / parameter tables.

Outputs go under the shared folder named by ``spark.checkpoint.dir`` (set by
the cluster; tests fall back to a temporary folder), never a machine-local
path on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import scratch_path
from ..operators import prepare
from ..operators.models import AdditiveModel, LinearModel, additive_from_table, linear_from_table


def write_scored_csv(df: DataFrame, path: str) -> None:
    """Header, no index column; one file per partition (no coalesce(1))."""
    df.write.mode("overwrite").option("header", True).csv(path)


def roundtrip_csv(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    write_scored_csv(df, path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


def save_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    """The coefficient table as parquet (a failure is reported, not fatal)."""
    model.to_table(spark, background=True).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str, name: str) -> LinearModel:
    """Rebuild the model from its coefficient table."""
    return linear_from_table(spark.read.parquet(path), name)


def save_load_linear(spark: SparkSession, model: LinearModel, name: str) -> LinearModel:
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    save_linear(spark, model, path)
    return load_linear(spark, path, model.name)


def save_load_additive(spark: SparkSession, model: AdditiveModel, name: str) -> AdditiveModel:
    """A7 + A8 for the additive model: shapes, intercept and feature order."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    model.to_table(spark).write.mode("overwrite").parquet(path)
    return additive_from_table(spark.read.parquet(path), model.name)


def save_load_params(spark: SparkSession, params: prepare.PrepParams, name: str) -> prepare.PrepParams:
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    params.to_table(spark).write.mode("overwrite").parquet(path)
    return prepare.PrepParams.from_table(spark.read.parquet(path))
