"""A1: workbooks (.xlsx) as tables.

Spark lists and reads the files (``binaryFile``, so any store it can reach),
one task a file; the task streams the first sheet's XML out of the zip row by
row, so a file's memory is its zipped bytes, its shared strings and a batch of
rows. A workbook holds at most 1,048,576 rows; larger tables are folders of
workbooks.

The first row names the columns: an empty name becomes ``Unnamed: <place>``, a
repeated one gets ``.1``, ``.2``. Columns are matched by name over all files;
one that a file lacks is null there. Types come from the cells of all files
unless a schema is given: whole numbers are long, others double, dates
(numbers in a date format) timestamp, booleans boolean, and anything mixed or
textual string. Error cells and empty ones are null, as is what a given type
cannot hold; rows without any value
are left out. A file that is no workbook is an error.
"""

from __future__ import annotations

import datetime
import io
import os
import re
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 4096              # rows of a batch
MOST_ROWS = 1_048_576    # of a sheet, its header included
#: Numbers of the format's built-in date and time formats (fixed values of the file format).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
KINDS = {"long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType(), "boolean": T.BooleanType(),
         "string": T.StringType()}


class Workbook:
    """The first sheet of one file."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        names = {n.lstrip("/"): n for n in self.zip.namelist()}
        book = ElementTree.fromstring(self.zip.read(names["xl/workbook.xml"]))
        links = ElementTree.fromstring(self.zip.read(names["xl/_rels/workbook.xml.rels"]))
        sheet = next(book.iter(f"{MAIN}sheet")).get(RELATION)
        target = next(e.get("Target") for e in links if e.get("Id") == sheet)
        self.sheet = names[target.lstrip("/") if target.startswith("/") else f"xl/{target}"]
        setting = next(book.iter(f"{MAIN}workbookPr"), None)
        from_1904 = setting is not None and setting.get("date1904") in ("1", "true")
        self.epoch = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
        self.strings = [text_of(e) for e in self._items(names.get("xl/sharedStrings.xml"), "si")]
        self.dated = self._date_styles(names.get("xl/styles.xml"))

    def _items(self, name: str | None, tag: str) -> Iterator[ElementTree.Element]:
        """Elements of that tag one by one, each forgotten after use."""
        if name is None:
            return
        with self.zip.open(name) as f:
            events = ElementTree.iterparse(f, ("start", "end"))
            root = next(events)[1]
            above = root
            for event, e in events:
                if event == "start" and e.tag == f"{MAIN}sheetData":
                    above = e
                elif event == "end" and e.tag == MAIN + tag:
                    yield e
                    above.clear()

    def _date_styles(self, name: str | None) -> list[bool]:
        if name is None:
            return []
        styles = ElementTree.fromstring(self.zip.read(name))
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter(f"{MAIN}numFmt")}
        plain = {i: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code) for i, code in own.items()}
        dates = DATE_FORMATS | {i for i, code in plain.items() if re.search("[dmyhs]", code, re.I) and "general" not in code.lower()}
        formats = styles.find(f"{MAIN}cellXfs")
        return [int(e.get("numFmtId", 0)) in dates for e in (formats if formats is not None else [])]

    def rows(self) -> Iterator[dict[int, object]]:
        """Each row's values by column place."""
        for row in self._items(self.sheet, "row"):
            out, at = {}, -1
            for cell in row:
                if cell.tag != f"{MAIN}c":
                    continue
                ref = re.match(r"[A-Za-z]+", cell.get("r", ""))
                at = place(ref[0]) if ref else at + 1
                value = self._value(cell)
                if value is not None:
                    out[at] = value
            yield out

    def _value(self, cell: ElementTree.Element) -> object:
        kind, v = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            inner = cell.find(f"{MAIN}is")
            return None if inner is None else text_of(inner)
        if v is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return v.strip() == "1"
        if kind == "d":
            return datetime.datetime.fromisoformat(v.strip())
        if kind == "str":
            return v
        style = int(cell.get("s", 0))
        if style < len(self.dated) and self.dated[style]:
            return self.epoch + datetime.timedelta(microseconds=round(float(v) * 86_400_000) * 1000)
        return int(v) if re.fullmatch(r"\s*[+-]?\d+\s*", v) and abs(int(v)) < 2 ** 63 else float(v)


def text_of(e: ElementTree.Element) -> str:
    """A string's text: its runs joined, phonetic hints left out, escaped control characters as they were."""
    runs = [t.text or "" for child in e for t in (child.iter(f"{MAIN}t") if child.tag != f"{MAIN}rPh" else ())]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(runs))


def place(letters: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def letters(at: int) -> str:
    out, at = "", at + 1
    while at:
        at, r = divmod(at - 1, 26)
        out = chr(65 + r) + out
    return out


def header(row: dict[int, object]) -> dict[int, str]:
    """Column names by place; empty and repeated names are made distinct."""
    out, seen = {}, set()
    for i in range(max(row, default=-1) + 1):
        base = str(row[i]) if i in row else f"Unnamed: {i}"
        name, n = base, 0
        while name in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name)
        out[i] = name
    return out


def kind_of(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "long" if value.is_integer() and abs(value) < 2 ** 53 else "double"
    return "timestamp" if isinstance(value, datetime.datetime) else "string"


def wider(kinds: set[str]) -> str:
    """The type that holds all kinds of a column; a column without values is a string."""
    return next(iter(kinds)) if len(kinds) == 1 else "double" if kinds == {"long", "double"} else "string"


def as_kind(value: object, kind: str) -> object:
    """A cell as a value of a column's type; what the type can't hold is null."""
    if value is None:
        return None
    if kind == "string":
        if isinstance(value, bool):
            return str(value).lower()
        return str(int(value)) if isinstance(value, float) and kind_of(value) == "long" else str(value)
    if kind == "long":
        return int(value) if kind_of(value) == "long" else None
    if kind == "double":
        return float(value) if kind_of(value) in ("long", "double") else None
    return value if kind_of(value) == kind else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def inferred(spark: SparkSession, path: str) -> T.StructType:
    """Names in order of appearance (files by path) and types over all cells of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = Workbook(raw.as_py()).rows()
                names = header(next(rows, {}))
                kinds: dict[int, set[str]] = {i: set() for i in names}
                for row in rows:
                    for i, v in row.items():
                        if i in kinds:
                            kinds[i].add(kind_of(v))
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(names), pa.string()),
                                                  "at": pa.array(list(names), pa.int32()),
                                                  "name": pa.array(list(names.values()), pa.string()),
                                                  "kinds": pa.array([sorted(k) for k in kinds.values()], pa.list_(pa.string()))})

    found = _files(spark, path).mapInArrow(run, "path string, at int, name string, kinds array<string>")
    columns = found.groupBy("name").agg(F.min(F.struct("path", "at")).alias("first"),
                                        F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")).orderBy("first").collect()
    return T.StructType([T.StructField(r["name"], KINDS[wider(set(r["kinds"]))]) for r in columns])


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of one workbook or of a folder of them."""
    schema = inferred(spark, path) if schema is None else schema
    kinds = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double",
             "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "timestamp"}
    kind = {f.name: kinds.get(f.dataType.simpleString(), "string") for f in schema}
    # Spark allows a column name twice in a file's frame only under names of its own
    raw = T.StructType([T.StructField(f"c{i}", KINDS[kind[f.name]]) for i, f in enumerate(schema)])
    types = {"long": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us"), "boolean": pa.bool_(), "string": pa.string()}
    wanted = [(f.name, kind[f.name]) for f in schema]

    def batch_of(rows: list[dict[int, object]], at: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.array([as_kind(r.get(at.get(name, -1)), k) for r in rows], types[k]) for name, k in wanted]
        return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(wanted))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw_file in batch.column(0):
                rows, held = Workbook(raw_file.as_py()).rows(), []
                at = {name: i for i, name in header(next(rows, {})).items()}
                for row in rows:
                    if row:
                        held.append(row)
                    if len(held) == ROWS:
                        yield batch_of(held, at)
                        held = []
                if held:
                    yield batch_of(held, at)

    if not len(schema):
        return spark.createDataFrame([], schema)
    out = _files(spark, path).select("content").mapInArrow(run, raw)
    return out.select(*[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


# ------------------------------------------------------------------ writing
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def cell(value: object, ref: str) -> str:
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime.date):
        moment = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
        days = (moment - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = re.sub("[\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(df: DataFrame, path: str) -> None:
    """One workbook or more per partition into a new folder that all machines share; rows go to the sheet as they come."""
    names, folder = df.columns, re.sub("^file:/*", "/", path)
    os.makedirs(folder)

    def sheet(rows: Iterator[tuple], out) -> None:
        out.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        for line, row in enumerate(chain([tuple(names)], islice(rows, MOST_ROWS - 1)), 1):
            cells = "".join(cell(v, f"{letters(i)}{line}") for i, v in enumerate(row))
            out.write(f'<row r="{line}">{cells}</row>'.encode())
        out.write(b"</sheetData></worksheet>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        while first is not None or (part == 0 and number == 0):  # an empty table is a header alone
            final = f"{folder}/part-{part:05d}-{number:03d}.xlsx"
            draft = f"{folder}/.{part:05d}-{number:03d}-{TaskContext.get().taskAttemptId()}"
            with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in PARTS.items():
                    z.writestr(name, text)
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                    sheet(chain([] if first is None else [first], rows), out)
            os.replace(draft, final)  # a task run twice leaves the same file
            first, number = next(rows, None), number + 1
        yield from ()

    df.mapInArrow(run, "done long").count()
