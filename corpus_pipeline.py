"""A corpus pipeline of the operators in ``tierwise.llm``: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierwise.llm import _base, decontaminate, language, neardup, packing, quality

#: Each stage takes (spark, docs, sf_dir); all but the last return rows with the columns of documents.
STAGES = [
    ("quality rules", quality.stage),
    ("language id", language.stage),
    ("near dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("best-fit packing", packing.stage),
]
#: SQL can't express language identification, alignment and packing; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each stage's rows being written and read again for the next."""
    docs = _base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _base.stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
