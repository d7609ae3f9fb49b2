"""Fill-in-middle transformation with memoized content-defined chunks.

A text is cut into a prefix, a middle and a suffix at line ends, drawn from a hash of its id, and written with marks
around the parts. Line ends are found without scanning a text that was seen before: a rolling hash over the last 32
bytes cuts texts into chunks, so equal passages give equal chunks wherever they stand; a cache in each worker, keyed by
the chunk's whole content, holds each chunk's summary (lines, code points, whether a mark lies inside, its border
bytes); sums of the counts show in which chunk the wanted line ends, and only there line ends are listed, once a chunk.

The work is one map over the input splits: nothing is shuffled, and a lost task is simply run again. The cache holds at
most ``CACHE_BYTES`` and starts anew beyond that; what it forgets is only counted again.

Defined results: a null text counts as empty, an empty one stays plain (one output, no cut). A text that holds a mark
stays plain, so the output can always be undone. A null id draws as the text ''. Texts of any length are cut whole; one
is held in memory with its hash, about 30 bytes a byte. Repeated rows and ties in ids give equal outputs, an empty
table gives no row, and other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

SEED = 7
RATE, SPM = 100, 50     # per cent of texts transformed, and of those in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32             # bytes that decide on a cut
MEAN = 1024             # bytes of a chunk, on average
LARGEST = 16_384        # bytes of a chunk at most
CACHE_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: A 32-bit number for each byte value, the finaliser's of its place.
GEAR = (_base.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at each place: sum of GEAR[byte] * 2^distance, by doubling the span."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts(data: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """For each text (from one start to the next) the ends of its chunks. Only bytes of the text decide on them."""
    ends = np.flatnonzero(rolling(data) >= np.uint32(2 ** 32 - 2 ** 32 // MEAN)) + 1
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        inner = ends[np.searchsorted(ends, lo + WINDOW):np.searchsorted(ends, hi)].tolist()
        got, last = [], lo
        for e in [*inner, hi]:
            while e - last > LARGEST:
                last += LARGEST
                got.append(last)
            if e > last:
                got.append(e)
                last = e
        out.append(got)
    return out


class Summary:
    """What is known of a chunk: line ends, code points, a mark inside, its first and last two bytes."""

    __slots__ = ("lines", "points", "marked", "head", "tail", "ends")

    def __init__(self, chunk: bytes, marks: list[bytes]):
        self.lines = chunk.count(b"\n")
        self.points = points(chunk)
        self.marked = any(m in chunk for m in marks)
        self.head, self.tail = chunk[:2], chunk[-2:]
        self.ends = None

    def line_end(self, chunk: bytes, number: int) -> tuple[int, int]:
        """Bytes and code points up to the end of the chunk's line of that number, from 1."""
        if self.ends is None:
            at = np.frombuffer(chunk, np.uint8)
            stops = np.flatnonzero(at == 10)
            self.ends = stops + 1, np.cumsum((at & 0xC0) != 0x80)[stops]
        return int(self.ends[0][number - 1]), int(self.ends[1][number - 1])


def points(chunk: bytes) -> int:
    """Code points that begin in the chunk; they add up over chunks, wherever these are cut."""
    at = np.frombuffer(chunk, np.uint8)
    return int(np.count_nonzero((at & 0xC0) != 0x80))


class Memo:
    """Summaries by content, so that a shared chunk is verified by being looked up."""

    def __init__(self, marks: list[bytes], most: int = CACHE_BYTES):
        self.marks, self.most, self.held, self.known, self.hits = marks, most, 0, {}, 0

    def of(self, chunk: bytes) -> Summary:
        got = self.known.get(chunk)
        if got is None:
            if self.held > self.most:
                self.known.clear()
                self.held = 0
            got = self.known[chunk] = Summary(chunk, self.marks)
            self.held += len(chunk) + 64 + 16 * got.lines
        else:
            self.hits += 1
        return got


class Counted:
    """One text's chunks with their sums."""

    def __init__(self, raw: bytes, lo: int, ends: list[int], memo: Memo):
        self.chunks, self.parts, self.lines, self.points = [], [], [0], [0]
        self.at = [0, *(e - lo for e in ends)]
        self.marked, seam = False, b""
        for a, b in zip([lo, *ends[:-1]], ends):
            chunk = raw[a:b]
            s = memo.of(chunk)
            self.marked = self.marked or s.marked or any(m in seam + s.head for m in memo.marks)
            seam = (seam + chunk)[-2:] if len(chunk) < 2 else s.tail
            self.chunks.append(chunk)
            self.parts.append(s)
            self.lines.append(self.lines[-1] + s.lines)
            self.points.append(self.points[-1] + s.points)
        self.n = self.lines[-1] + bool(self.chunks and self.chunks[-1][-1:] != b"\n")

    def after(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the text's first units."""
        if units <= 0:
            return 0, 0
        if units > self.lines[-1]:
            return self.at[-1], self.points[-1]
        i = bisect_left(self.lines, units) - 1
        size, count = self.parts[i].line_end(self.chunks[i], units - self.lines[i])
        return self.at[i] + size, self.points[i] + count


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, lines, form (plain, psm or spm), code points of prefix and middle, and the output text."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(marks)
        for batch in batches:
            for lo, hi in _base.slices(batch.column(1), SLICE_BYTES):
                texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()
                draws = [c.slice(lo, hi - lo).to_pylist() for c in batch.columns[2:6]]
                encoded = [t.encode() for t in texts]
                starts = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
                raw = b"".join(encoded)
                rows = []
                for i, ends in enumerate(cuts(np.frombuffer(raw, np.uint8), starts)):
                    text, c = encoded[i], Counted(raw, int(starts[i]), ends, memo)
                    h1, h2, h3, h4 = (d[i] for d in draws)
                    if not text or c.marked or h3 % 100 >= rate:
                        rows.append((c.n, "plain", None, None, texts[i]))
                        continue
                    one, two = sorted((h1 % (c.n + 1), h2 % (c.n + 1)))
                    (a, a_points), (b, b_points) = c.after(one), c.after(two)
                    before, middle, rest = text[:a], text[a:b], text[b:]
                    form = "spm" if h4 % 100 < spm else "psm"
                    out = [s, rest, p, before, m, middle] if form == "spm" else [p, before, s, rest, m, middle]
                    rows.append((c.n, form, a_points, b_points - a_points, b"".join(out).decode()))
                n, form, a, b, out = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                                                  pa.array(form, pa.string()), pa.array(a, pa.int64()),
                                                  pa.array(b, pa.int64()), pa.array(out, pa.string())],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *draw) \
        .toDF("doc_id", "text", "h1", "h2", "h3", "h4").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. In psm and spm outputs each mark stands once: texts with one are plain."""
    def upto(mark: str) -> Column:
        return F.instr(output, mark)

    def between(start: Column, stop: Column | None) -> Column:
        return F.substr(output, start + 3, F.length(output) if stop is None else stop - start - 3)

    one = F.lit(1)
    psm = F.concat(between(one, upto(SUFFIX)), between(upto(MIDDLE), None), between(upto(SUFFIX), upto(MIDDLE)))
    spm = F.concat(between(upto(PREFIX), upto(MIDDLE)), between(upto(MIDDLE), None), between(one, upto(PREFIX)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(_base.table(spark, sf_dir, "documents"))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    """The same in SQL: lines by splitting at line feeds, parts by joining them again."""
    joined = "array_to_string(list_slice(u, {0}, {1}), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u,
    ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b
  FROM h),
p AS (
  SELECT *, {joined.format(1, 'a')} AS prefix, {joined.format('a + 1', 'b')} AS middle, {joined.format('b + 1', 'n')} AS suffix,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
      OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p"""
