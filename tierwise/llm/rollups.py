"""Token-count rollups that are maintained by deltas.

A batch of changes (op, source, lang, tokenizer, n_tokens, old_tokens) is reduced to one signed row per group: an insert
adds a document and its tokens, a delete takes both away, a revision adds the difference to the old count. The rows are
appended as one delta, and only then the batch is entered into the commit log. Totals are the sum over the deltas of the
log, so an attempt that failed half way counts for nothing; a batch id that the log holds is not applied again, and if
two writers commit it at once, only the smaller delta id counts. ``compact`` sums the deltas so far into one (one
maintainer at a time). Everything is plain tables, so it works on any storage Spark writes to, also as a
``foreachBatch`` sink.

Defined results: null counts are 0; rows of a null or unknown op change nothing and are counted in ``n_ignored``; null
sources, languages and tokenizers are groups; repeated rows count each; a group whose documents are all gone stays with
zeros; an empty batch is committed and changes nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_ignored long, delta string"
_LOG = "batch string, delta string, replaces array<string>"


class Rollup:
    """Totals by source, language and tokenizer version, kept under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.deltas, self.log = spark, f"{path}/deltas", f"{path}/log"
        spark.createDataFrame([], _DELTA).write.mode("ignore").partitionBy("delta").parquet(self.deltas)
        spark.createDataFrame([], _LOG).write.mode("ignore").parquet(self.log)

    def _committed(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(self.log)

    def _valid(self) -> DataFrame:
        log = self._committed()
        once = log.groupBy("batch").agg(F.min("delta").alias("delta"))
        replaced = log.select(F.explode("replaces").alias("delta"))
        deltas = self.spark.read.schema(_DELTA).parquet(self.deltas)
        return deltas.join(once.join(replaced, "delta", "left_anti").select("delta"), "delta", "left_semi")

    def _write(self, batch: str, rows: DataFrame, replaces: list[str]) -> None:
        delta = uuid.uuid4().hex
        rows.withColumn("delta", F.lit(delta)).write.mode("append").partitionBy("delta").parquet(self.deltas)
        self.spark.createDataFrame([(batch, delta, replaces)], _LOG).coalesce(1).write.mode("append").parquet(self.log)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch unless it has been; tells whether it was applied now."""
        if not self._committed().filter(F.col("batch") == batch).isEmpty():
            return False
        n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("n_tokens", "old_tokens"))
        by = lambda insert, delete, revise: (F.when(F.col("op") == "insert", insert).when(F.col("op") == "delete", delete)
                                             .when(F.col("op") == "revise", revise).otherwise(F.lit(0)).cast("long"))
        known = F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False))
        signed = changes.select(*(F.col(k).cast("string").alias(k) for k in KEYS),
                                by(F.lit(1), F.lit(-1), F.lit(0)).alias("n_docs"), by(n, -n, n - old).alias("n_tokens"),
                                (~known).cast("long").alias("n_ignored"))
        self._write(batch, signed.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_ignored")]), [])
        return True

    def totals(self) -> DataFrame:
        return self._valid().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_ignored")])

    def compact(self) -> None:
        valid = self._valid()
        old = [r["delta"] for r in valid.select("delta").distinct().collect()]
        name = "compact-" + uuid.uuid4().hex
        self._write(name, self.totals(), old)


def _count(text: Column, separators: str, keep: str = "") -> Column:
    words = F.array_remove(F.split(text, separators), "")
    return F.size(F.filter(words, lambda w: w.rlike(keep)) if keep else words).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """Per document its groups, the key of its text, and its counts by three rules: blank-separated words, those of them
    with a letter or digit, and runs of letters and digits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", "lang", F.md5(text).alias("text_key"), _count(text, _base.SPACE).alias("blank"),
                       _count(text, _base.SPACE, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").alias("lettered"),
                       _count(F.lower(text), _base.NOT_ALNUM).alias("alnum"))


def op4_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under tokenizer ``blank-1``, are recounted by a later rule, come in under ``alnum-2``, and
    lose their exact copies (all but the smallest doc_id of a text). Two of the batches are sent twice."""
    docs = _base.stored(counted(_base.table(spark, sf_dir, "documents")), "rollup-counts")
    first = docs.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = docs.join(first, "text_key").filter(~F.col("doc_id").eqNullSafe(F.col("first")))

    def changes(rows: DataFrame, op: str, tokenizer: str, n: str, old: str | None = None) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
                           F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    batches = {
        "load": changes(docs, "insert", "blank-1", "blank"),
        "recount": changes(docs.filter("lettered <> blank"), "revise", "blank-1", "lettered", "blank"),
        "alnum": changes(docs, "insert", "alnum-2", "alnum"),
        "copies": changes(copies, "delete", "blank-1", "lettered").unionByName(changes(copies, "delete", "alnum-2", "alnum")),
    }
    rollup = Rollup(spark, _base.scratch(spark, "rollup"))
    for batch in ("load", "recount", "load", "alnum", "copies", "recount"):
        rollup.commit(batch, batches[batch])
    return rollup.totals().select("source", "lang", "tokenizer", "n_docs", "n_tokens")


def oracle() -> str:
    """The same totals counted anew in DuckDB SQL."""
    return r"""WITH d AS (
  SELECT source, lang, doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS b,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS a
  FROM documents),
n AS (SELECT source, lang, kept, len(list_filter(b, lambda x: regexp_matches(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]'))) AS b,
  len(a) AS a FROM d)
SELECT source, lang, tokenizer, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS n_docs,
  CAST(coalesce(sum(n) FILTER (WHERE kept), 0) AS BIGINT) AS n_tokens
FROM (SELECT source, lang, kept, 'blank-1' AS tokenizer, b AS n FROM n UNION ALL SELECT source, lang, kept, 'alnum-2', a FROM n)
GROUP BY source, lang, tokenizer"""
