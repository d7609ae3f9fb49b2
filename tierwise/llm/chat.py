"""Chat formatting of reply trees, native DataFrame operations only.

Messages (tree, id, parent, role, text, score) form reply trees; a missing or null parent makes a root. Pointer doubling
by self-joins gives each message's 2^k-th ancestor, in as many rounds as the depth has binary digits. Leaves then collect
their ancestors from the highest power down, which enumerates every root-to-leaf path in as many joins again; only ids
move, never texts. A path's score is the mean of its messages' scores; paths of one root are ranked by it (ties: the
smaller leaf id), first within salted parts of a tree, then among the parts' best, so that one huge tree is no single
task. The texts are joined to the chosen paths at the end.

A turn is ``<|start|>role<|sep|>text<|end|>``. In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string can occur there and parsing gives back the exact texts. The loss mask lists (start, length) in code points
of the escaped assistant texts.

Defined results: null roles, texts and scores count as '', '' and 0; messages on or below a cycle belong to no path;
repeated ids are an error of the caller's (``linear`` makes ids of rows, so repeated rows are turns of their own); null
trees are a tree of their own; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _base

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
SALTS = 64
MOST_ROUNDS = 62


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda x: F.replace(x, F.lit("<\\|"), F.lit("<|"))), "\\")


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """nodes (id, parent): tables (id, up) of the 2^k-th ancestors, for k = 0, 1, ... while there are any. Messages on or
    below a cycle keep an ancestor for ever; they are left over after as many doublings as the number of messages allows."""
    links = nodes.join(nodes.select(F.col("id").alias("up")), nodes["parent"] == F.col("up")).select("id", "up")
    out = [_base.stored(links, "chat-up")]
    total = out[0].count()
    while total and len(out) < MOST_ROUNDS and 2 ** (len(out) - 1) <= total:
        now = out[-1]
        further = _base.stored(now.join(now.select(F.col("id").alias("up"), F.col("up").alias("far")), "up")
                               .select("id", F.col("far").alias("up")), "chat-up")
        if further.isEmpty():
            break
        out.append(further)
    return out


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The chosen root-to-leaf paths: rows (root, leaf, rank, path_score, back, id), ``back`` counting from the leaf."""
    narrow = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = _base.stored(narrow, "chat-nodes")
    ups = ancestors(nodes)
    inner = ups[0].select(F.col("up").alias("id")).distinct()
    members = nodes.join(inner, "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("back"))
    for k in range(len(ups) - 1, -1, -1):
        step = members.join(ups[k], "id").select("leaf", F.col("up").alias("id"), (F.col("back") + 2 ** k).alias("back"))
        members = _base.stored(members.unionByName(step), "chat-paths")
    roots = nodes.join(ups[0].select("id"), "id", "left_anti").select("id", F.lit(True).alias("is_root"))
    whole = (members.join(nodes.select("id", "score"), "id").join(roots, "id", "left").groupBy("leaf")
             .agg(F.avg("score").alias("path_score"), F.max(F.when(F.col("is_root"), F.col("id"))).alias("root"))
             .filter("root is not null"))
    order = (F.col("path_score").desc(), F.col("leaf"))
    if best is not None:
        part = Window.partitionBy("root", F.pmod(F.xxhash64("leaf"), F.lit(SALTS))).orderBy(*order)
        whole = whole.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= best)
    whole = whole.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    if best is not None:
        whole = whole.filter(F.col("rank") <= best)
    return members.join(whole, "leaf").select("root", "leaf", "rank", "path_score", "back", "id")


def formatted(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, root, leaf, rank, path_score, n_turns, text and loss mask."""
    rows = paths(messages, best).join(messages.select("id", "tree", "role", "text"), "id")
    role, body = escape(F.col("role")), escape(F.col("text"))
    rows = rows.select("tree", "root", "leaf", "rank", "path_score", "back", F.coalesce("role", F.lit("")).alias("role"),
                       F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = F.sum(F.length("piece")).over(Window.partitionBy("leaf").orderBy(F.col("back").desc())
                                           .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", (F.coalesce(before, F.lit(0)) + F.length("head")).cast("long"))
    turn = F.struct((-F.col("back")).alias("at"), "piece", F.when(F.col("role") == "assistant", F.struct(
        F.col("start"), F.length("body").cast("long").alias("length"))).alias("loss"))
    grouped = rows.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("root").alias("root"), F.first("rank").alias("rank"),
        F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("tree", "root", "leaf", "rank", "path_score", F.size("turns").alias("n_turns"),
                          F.array_join("turns.piece", "").alias("text"),
                          F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss"))


def parsed(chats: DataFrame) -> DataFrame:
    """chats (text, loss) with ``turns`` (role, text), read back from the formatted text, and ``loss_text``."""
    pieces = F.filter(F.split("text", r"\Q" + END + r"\E"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.transform(F.array(F.split(F.substr(x, F.lit(len(START) + 1)), r"\Q" + SEP + r"\E")),
                                                      lambda p: F.struct(unescape(p[0]).alias("role"),
                                                                         unescape(p[1]).alias("text")))[0])
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})


def linear(rows: DataFrame) -> DataFrame:
    """Messages of conversations given as rows by turn: each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("n"))
    name = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), n.cast("string"))
    return numbered.select(F.col("conv_id").alias("tree"), name(F.col("n")).alias("id"),
                           F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), "role", "text",
                           F.lit(0.0).alias("score"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = _base.stored(linear(rows.unionByName(control)), "chat-messages")
    back = parsed(formatted(messages))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(text, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    def esc(c: str) -> str:
        return f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"

    marks = len(START) + len(SEP) + len(END)
    by = "ORDER BY turn NULLS FIRST, role NULLS FIRST, t"
    return f"""SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' {by})) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' {by}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length({esc("coalesce(role, '')")}) + length({esc('t')})) AS BIGINT) AS formatted_chars
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
GROUP BY conv_id"""
