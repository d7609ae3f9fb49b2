"""Licence scan by a generalised suffix automaton of licence texts.

All templates, as lower-cased words, go into one suffix automaton (built on the driver; its size follows the templates,
not the corpus). A text's words are streamed through it, which gives the matching statistics: at every word the longest
match with any template that ends there. Matches that can't be extended and have ``MIN_MATCH`` words or more are chained:
same template, both places rising, gaps of at most ``MAX_GAP`` words. A chain that covers at least ``COVERED`` of its
template is a span and gives the template's label. Fixed phrases are templates too; the automaton tells each place where
one stands whole. Words that occur in no template end every match, so only runs of known words are walked through.

Defined results: null and empty texts have no word, no place, empty label lists and score 0; rows are never merged, so
repeated ones repeat; a tie between chains goes to the first in the text; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

MIN_MATCH = 4
MAX_GAP = 12
COVERED = 0.75
SLICE_BYTES = 8 << 20
#: Phrases whose every place counts (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Licence notices and their labels (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                 "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                 "CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
              "option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
              "option) any later version."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
              "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
            "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software"),
]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words, rows = _base.words_of(texts, _base.NOT_ALNUM, "ascii")
    index, distinct = _base.encoded(words)
    return index, rows, distinct.cast(pa.large_string())


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.labels = [label for label, _ in templates]
        self.vocabulary: dict[str, int] = {}
        texts = [text for _, text in templates] + list(phrases)
        index, rows, distinct = words_of(pa.array(texts, pa.large_string()))
        known = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in distinct.to_pylist()]
        tokens = [[known[i] for i in index[rows == r]] for r in range(len(texts))]
        self.sizes = [len(t) for t in tokens]
        for t in tokens:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        whole: list[list[tuple[str, int]]] = [[] for _ in self.next]
        for number, t in enumerate(tokens):
            state = 0
            for place, c in enumerate(t):
                state = self.next[state][c]
                if number < len(templates):
                    self.ends[state].append((number, place))
            if number >= len(templates):
                whole[state].append((phrases[texts[number]], len(t)))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            self.ends[self.link[s]] += self.ends[s]
        self.whole = whole
        for s in order:
            self.whole[s] = whole[s] + self.whole[self.link[s]]

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest string of q that ends at p + c: q itself or a copy of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For every token: the length of the longest match that ends there, and its state."""
        state, length = 0, 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield length, state


def chains(matches: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int, int]]:
    """Spans (first word, last word, words covered) of one text and one template of ``size`` words, best first, from
    matches (start, length, end in the template)."""
    matches = sorted(matches)
    best, came = [], []
    starts = [m[0] for m in matches]
    for i, (start, length, end) in enumerate(matches):
        got, by = length, -1
        for j in range(bisect_left(starts, start - MAX_GAP - size), i):
            s, n, e = matches[j]
            if s + n <= start <= s + n + MAX_GAP and e < end - length + 1 <= e + 1 + MAX_GAP and best[j] + length > got:
                got, by = best[j] + length, j
        best.append(got)
        came.append(by)
    used: set[int] = set()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], matches[i][0])):
        if best[i] < COVERED * size:
            return
        path, j = [], i
        while j >= 0 and j not in used:
            path.append(j)
            j = came[j]
        covered = sum(matches[k][1] for k in path)
        used.update(path)
        if covered >= COVERED * size:
            yield matches[path[-1]][0], matches[i][0] + matches[i][1] - 1, covered


def scan(automaton: Automaton, texts: pa.Array) -> Iterator[dict]:
    """Per text: n_words, places [(label, first word)], spans [(label, first word, last word, share)]."""
    index, rows, distinct = words_of(texts)
    size = np.bincount(rows, minlength=len(texts))
    begin = np.cumsum(size) - size
    number = np.array([automaton.vocabulary.get(w, -1) for w in distinct.to_pylist()], np.int64)
    tokens = number[index] if len(index) else np.zeros(0, np.int64)
    known = tokens >= 0
    edge = np.concatenate([[True], (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])]) if len(known) else known
    cut = np.append(np.flatnonzero(edge), len(known))
    runs = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b - a >= 3 and known[a]]
    places: dict[int, list] = defaultdict(list)
    found: dict[tuple[int, int], list] = defaultdict(list)
    for a, b in runs:
        row = int(rows[a])
        base = a - int(begin[row])
        got = list(automaton.statistics(tokens[a:b].tolist()))
        for i, (length, state) in enumerate(got):
            for label, n in automaton.whole[state]:
                if length >= n:
                    places[row].append((label, base + i - n + 1))
            if length >= MIN_MATCH and (i + 1 == len(got) or got[i + 1][0] <= length):
                for template, end in automaton.ends[state]:
                    found[row, template].append((base + i - length + 1, length, end))
    spans: dict[int, list] = defaultdict(list)
    for (row, template), matches in found.items():
        n = automaton.sizes[template]
        for first, last, covered in chains(matches, n):
            spans[row].append((automaton.labels[template], first, last, covered / n))
    for row in range(len(texts)):
        yield {"n_words": int(size[row]), "places": places.get(row, []), "spans": sorted(spans.get(row, []), key=lambda s: s[1:])}


def licences(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """docs (doc_id, text): per row n_words, the places of phrases and the covered spans of templates."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, templates))
    place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                               ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _base.slices(batch.column(1), SLICE_BYTES):
                got = list(scan(shared.value, batch.column(1).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([[dict(zip(("label", "first_word"), p)) for p in g["places"]] for g in got], place),
                    pa.array([[dict(zip(("label", "first_word", "last_word", "share"), s)) for s in g["spans"]] for g in got],
                             span)], names=["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<label: string, first_word: long>>, "
             "spans array<struct<label: string, first_word: long, last_word: long, share: double>>")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences(_base.table(spark, sf_dir, "documents"))
    base, own = F.col("places.label"), F.col("spans.label")
    starts = F.col("places.first_word")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"))
