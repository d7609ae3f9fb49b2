"""Quality rules with adaptive thresholds, native DataFrame operations only.

Each document gets integer metrics. Per (language, source) and metric, a mergeable quantile sketch holds counts by
log-linear bucket: values below 64 have a bucket each, larger ones 32 buckets per power of two (at most 1/32 relative
error). Sketches are rows (lang, source, metric, bucket, n); merging is a sum, so partial aggregation does it and a
source with a third of all rows is no special case. From the sketch follow quartiles, and from these the cutoffs
(Tukey fences; the quartile distance counts as a metric's least spread at least, so that a group whose documents are
all alike doesn't reject the next one that differs a little). A group with fewer than
``MIN_GROUP`` documents uses its language's merged sketch, and if that is small too, the whole corpus's.

The thresholds are written as a table and joined to the documents null-safely on (language, source); Spark broadcasts
them only if their real size is under its threshold.

Nulls: a null text has no words and fails; null languages and sources are groups of their own. Repeated rows each get
their verdict. A value equal to its cutoff is inside it. Texts of any length are measured whole, in memory with their
words. An empty table gives an empty result. Other columns pass through unread; results carry fixed names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _base

#: metric: (side that is bad, fence in units of the quartile distance, least quartile distance that is reckoned with)
RULES = {
    "symbol_ppm": ("high", 6, 3_000),
    "upper_ppm": ("high", 6, 4_000),
    "repeat_ppm": ("high", 10, 30_000),
    "dup_line_ppm": ("high", 6, 60_000),
    "mean_word_milli": ("high", 6, 200),
    "mean_word_milli_low": ("low", 6, 200),
}
MIN_WORDS = 50
MIN_GROUP = 200
PPM = 1_000_000


def _let(value: Column, body) -> Column:
    """Bind a value once for use in several places of an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _base.SPACE), "")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text. Windows are compared by 64-bit hash; sorted
    (hash, place) pairs put equal windows side by side."""
    def marked(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(
            F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
        return _let(F.sort_array(grams), lambda s: F.size(F.array_distinct(F.flatten(F.filter(F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(*[x["i"] + k for x in (a, b) for k in range(3)]))),
            lambda x: x.isNotNull())))))
    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(marked(w))).cast("long")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * PPM / F.col(whole))).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """docs with the base columns, base_failed and the rule metrics added (one projection, no shuffle)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("*", _let(_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (
            F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"))
    flat = counted.select(*[c for c in counted.columns if c not in ("_w", "_l")], "_w.n_words", "_w.n_repeat_words",
                          "_l.n_lines", "_l.n_dup_lines")
    mean = F.when(F.col("n_words") > 0, F.floor(F.col("word_chars") * 1000 / F.col("n_words"))).otherwise(F.lit(0)) \
        .cast("long")
    return flat.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_ppm": _ratio("n_symbols", "word_chars"), "upper_ppm": _ratio("n_upper", "word_chars"),
        "repeat_ppm": _ratio("n_repeat_words", "n_words"), "dup_line_ppm": _ratio("n_dup_lines", "n_lines"),
        "mean_word_milli": mean, "mean_word_milli_low": mean})


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number >= 0, by whole-number arithmetic only."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(32 * e + F.call_function("shiftright", v, e)).cast("long")


def bucket_low(b: Column) -> Column:
    """The smallest value of a bucket."""
    e = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - 32 * e) * F.pow(F.lit(2), e)).cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """One sketch row per (lang, source, metric, bucket) over documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket"))
                                for m in RULES])).alias("p")
    return (measured.filter(~F.col("base_failed")).select("lang", "source", pairs)
            .groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n")))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches to coarser groups."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def cutoffs(sketches: DataFrame, *keys: str) -> DataFrame:
    """Per group and metric: how many documents, and the cutoff from the quartiles of the sketch."""
    w = Window.partitionBy(*keys, "metric")
    run = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})

    def quantile(num: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("total") * num, bucket_low(F.col("bucket"))))

    q = run.groupBy(*keys, "metric").agg(F.max("total").alias("docs"), quantile(1).alias("q1"), quantile(3).alias("q3"))
    cut = F.lit(None).cast("long")
    for m, (side, fence, least) in RULES.items():
        reach = fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        at = F.col("q3") + reach if side == "high" else F.col("q1") - reach
        cut = F.when(F.col("metric") == m, at.cast("long")).otherwise(cut)
    return q.select(*keys, "metric", "docs", cut.alias("cut"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source) with a cutoff column ``cut_<metric>`` per rule."""
    sketches = _base.stored(sketches, "quality-sketch")
    fine = cutoffs(sketches, "lang", "source")
    lang = cutoffs(merged(sketches, "lang"), "lang").select("lang", "metric", F.col("docs").alias("lang_docs"),
                                                            F.col("cut").alias("lang_cut"))
    whole = cutoffs(merged(sketches)).select("metric", F.col("cut").alias("all_cut"))
    picked = (fine.alias("f")
              .join(lang.alias("l"), F.col("f.lang").eqNullSafe(F.col("l.lang")) & (F.col("f.metric") == F.col("l.metric")))
              .join(whole.alias("w"), F.col("f.metric") == F.col("w.metric"))
              .select("f.lang", "f.source", "f.metric", F.when(F.col("f.docs") >= MIN_GROUP, F.col("f.cut"))
                      .when(F.col("l.lang_docs") >= MIN_GROUP, F.col("l.lang_cut")).otherwise(F.col("w.all_cut")).alias("cut")))
    return picked.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("cut"))).alias(f"cut_{m}")
                                                  for m in RULES])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with ``kept``: not base_failed and inside every cutoff of its group."""
    inside = F.lit(True)
    for m, (side, _, _) in RULES.items():
        cut = F.col(f"cut_{m}")
        inside = inside & F.coalesce(F.col(m) <= cut if side == "high" else F.col(m) >= cut, F.lit(True))
    lim = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return (measured.join(lim, measured["lang"].eqNullSafe(lim["_lang"]) & measured["source"].eqNullSafe(lim["_source"]), "left")
            .withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source"))


def rules(docs: DataFrame, *carry: str) -> DataFrame:
    """Every document's metrics and verdict; the columns named in ``carry`` come back inside the struct ``row``, so
    that their names can't clash with the operator's. Texts are measured once: the metrics are written, with the text
    only if that is carried, and read for the thresholds and again for the verdict."""
    rest = [c for c in carry if c not in ("text", "lang", "source")]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(0).alias("_"))
    measured = measure(docs.select("text", "lang", "source", row.alias("row")))
    measured = _base.stored(measured if "text" in carry else measured.drop("text"), "quality-metrics")
    limits = _base.stored(thresholds(sketch(measured)), "quality-limits")
    return judge(measured, limits)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules(_base.table(spark, sf_dir, "documents"), "doc_id")
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "lang", "source", *[m for m in RULES if m != "mean_word_milli_low"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that pass the rules, with their own columns."""
    own = {c: F.col(c if c in ("text", "lang", "source") else f"row.`{c}`").alias(c) for c in docs.columns}
    return rules(docs, *docs.columns).filter("kept").select(*own.values())


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    names = [m for m in RULES]
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE NOT base_failed" for m in names)
    side = " ".join(f"WHEN '{m}' THEN " + ("q3 + " if s == "high" else "q1 - ") + f"{k} * greatest(q3 - q1, {least})"
                    for m, (s, k, least) in RULES.items())
    inside = " AND ".join(f"coalesce(m.{m} {'<=' if s == 'high' else '>='} t.cut_{m}, true)" for m, (s, _, _) in RULES.items())
    cuts = ", ".join(f"max(cut) FILTER (WHERE metric = '{m}') AS cut_{m}" for m in names)

    def level(name: str, *keys: str) -> str:
        k = "".join(f"{x}, " for x in keys)
        return f"""{name} AS (SELECT {k}metric, max(total) AS docs, CASE metric {side} END AS cut FROM (
  SELECT {k}metric, min(low) FILTER (WHERE upto * 4 >= total) AS q1, min(low) FILTER (WHERE upto * 4 >= total * 3) AS q3,
    max(total) AS total FROM (
    SELECT *, CASE WHEN b < 64 THEN b ELSE (b - 32 * (b // 32 - 1)) * CAST(pow(2, b // 32 - 1) AS BIGINT) END AS low,
      sum(n) OVER (PARTITION BY {k}metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {k}metric) AS total
    FROM (SELECT {k}metric, b, count(*) AS n FROM sk GROUP BY {k}metric, b)) GROUP BY {k}metric) GROUP BY {k}metric, q1, q3)"""

    return rf"""WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END AS symbol_ppm,
    CASE WHEN word_chars > 0 THEN n_upper * 1000000 // word_chars ELSE 0 END AS upper_ppm,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000000 // n_words ELSE 0 END AS repeat_ppm,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS dup_line_ppm,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS mean_word_milli,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS mean_word_milli_low FROM c),
sk AS (SELECT *, CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END AS b FROM ({pairs})),
{level('f', 'lang', 'source')},
{level('l', 'lang')},
{level('a')},
t AS (SELECT lang, source, {cuts} FROM (
  SELECT f.lang, f.source, f.metric, CASE WHEN f.docs >= {MIN_GROUP} THEN f.cut WHEN l.docs >= {MIN_GROUP} THEN l.cut
    ELSE a.cut END AS cut
  FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang AND f.metric = l.metric JOIN a ON f.metric = a.metric)
  GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {inside} AS kept, m.lang, m.source, symbol_ppm, upper_ppm, repeat_ppm, dup_line_ppm, mean_word_milli
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""
