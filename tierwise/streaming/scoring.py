"""Scoring new applicants as a stream.

Transform (E7) and scoring (G3-G6) are stateless projections compiled from
parameter tables, so the same expressions run on a streaming DataFrame:
files arriving in a folder are prepared and scored micro-batch by
micro-batch, with exactly-once output through the checkpointed sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import KEY_COL, TARGET_COL
from ..operators import models, prepare


def score_stream(stream: DataFrame, params: prepare.PrepParams, model, key: str = KEY_COL) -> DataFrame:
    """Streaming DataFrame in -> scored streaming DataFrame out (no state)."""
    prepared = prepare.transform(stream, params, key, TARGET_COL, missing_numeric="zero")
    return models.scored_table(prepared, model, key, keep_features=False)


def run_once(spark: SparkSession, source_dir: str, schema, params, model, sink_dir: str,
             checkpoint_dir: str, key: str = KEY_COL) -> None:
    """Process every file currently in ``source_dir`` (availableNow trigger)
    into parquet at ``sink_dir``; restartable from ``checkpoint_dir``."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    q = (score_stream(src, params, model, key).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
