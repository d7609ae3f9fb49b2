"""Physical-plan facts for a DataFrame: shuffles, broadcasts, codegen stages,
Python boundaries, nested-loop joins, cache reuse points, pruned scan schemas
and pushed filters.  Subtrees under an ``InMemoryRelation`` (a persisted
table built once by an earlier job) are not counted again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def _lines(tree: str, cached: str) -> list[str]:
    """``cached="skip"``: drop every persisted subtree; ``"once"``: keep each
    distinct persisted subtree the first time it appears."""
    out, skip_indent, seen = [], None, set()
    for line in tree.splitlines():
        body = line.lstrip(" :+-")
        indent = len(line) - len(body)
        if skip_indent is not None and indent > skip_indent:
            continue
        skip_indent = None
        out.append(line)
        if body.startswith("InMemoryRelation"):
            key = re.sub(r"#\d+", "", body)
            if cached == "skip" or key in seen:
                skip_indent = indent
            seen.add(key)
    return out


def _count(text: str, pat: str) -> int:
    return len(re.findall(pat, text))


def plan_facts(df: DataFrame) -> dict:
    tree = df._jdf.queryExecution().executedPlan().treeString()
    text = "\n".join(_lines(tree, "skip"))
    full = "\n".join(_lines(tree, "once"))
    shuffle = r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)"
    return {
        "shuffles": _count(text, shuffle),
        "shuffles_with_inputs": _count(full, shuffle),
        "single_partition": text.count("Exchange SinglePartition"),
        "broadcasts": text.count("BroadcastExchange"),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", text))),
        "python": _count(full, r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas"),
        "nested_loop": _count(full, r"BroadcastNestedLoopJoin|CartesianProduct"),
        "cache_reads": text.count("InMemoryTableScan"),
        "read_schemas": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", full))),
        "pushed_filters": sorted(set(f for f in re.findall(r"PushedFilters: \[([^\]]*)\]", full) if f)),
    }
