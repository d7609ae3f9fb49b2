"""WARC archives as a Spark Python data source (format name ``warc``): a writer and a reader.

Files are ``.warc.gz``: every record is a gzip member of its own, and the member's header carries the skip-length
field ``sl`` (compressed and uncompressed size). Records are valid WARC 1.1: dates, ids as URIs in angle brackets, URIs
as they are. What a header can't state as the row has it (ids that are no URIs, null ids and types, line ends) is kept
beside it in one header of our own, ``X-Row``, as JSON. Each commit lists its finished files in a manifest of its own,
so attempts that were lost or run twice leave no rows, and appending keeps what was there.

Reader: the driver plans partitions of whole files (small files together, up to ``split`` bytes), from the manifests or,
where there are none, from a listing of ``.warc.gz`` and ``.warc`` files, so archives of other programs are read too. A
task decompresses only the start of a record until its headers are complete, tests the pushed filters on them, and
jumps over an unwanted record's remaining bytes without decoding them: by the skip length, by the content length in
plain files, and in gzip members without a skip length by inflating and dropping 256 KB at a time. Filters on
``record_type``, ``target_uri``, ``record_id``, ``refers_to``, ``record_date`` and ``payload_digest`` are pushed down
(=, IN, starts with, not null). Option ``payload`` = ``false`` leaves all payloads undecoded (column null).

Payloads: of ``application/http`` blocks what follows the HTTP headers, as stored (no transfer or content coding is
undone; without a blank line in the first 1 MB the whole block), of others the block; of revisits null, and their
``payload_bytes`` is the HTTP headers' content length, or null.

Defined results: a null payload is written as an empty one; null URIs and digests are left out of the headers and read
as null; a null type is written as ``resource`` and a null id as a fresh one, both read as null; a null date is the time
of writing; an empty table gives no file and reads as no row; rows that repeat, or tie in all but the id, are records of
their own; a very long payload is one record and one row of up to Spark's 2 GB; columns besides those of ``SCHEMA`` are
refused by Spark's writer, so select first. A file that ends inside a record, or holds something else, raises. Paths may
be of any store that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage)

from . import _base

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary, record_date string")
_COLUMNS = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload",
            "record_date"]
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
            "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "record_date": "WARC-Date"}
FILE_BYTES = 64 << 20
_HEAD = 512
_STEP = 1 << 18
_MOST = 1 << 20
BLANKS = " \t"
_DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?")
_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1_column(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits give four base32 digits."""
    def digits(i: int) -> Column:
        five = F.substring(F.sha1(payload), 5 * i + 1, 5)
        return F.lpad(F.conv(five, 16, 32), 4, "0")
    return F.translate(F.concat(*map(digits, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _shown(column: str, value: str | None) -> str | None:
    """The header value for a column's value; None leaves the header out."""
    if column == "record_type":
        return value if value and re.fullmatch(r"[A-Za-z-]+", value) else "resource"
    if column == "record_date":
        return value if value and _DATE.fullmatch(value) else f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    if column == "record_id" and value is None:
        return f"<{uuid.uuid4().urn}>"
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return f"<{value}>" if _URI.fullmatch(value) else f"<{uuid.uuid5(uuid.NAMESPACE_URL, value).urn}>"
    if column == "payload_digest" and ":" not in value:
        value = f"sha1:{value}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _meant(column: str, shown: str | None) -> str | None:
    """A column's value, of a header value."""
    if shown is None:
        return None
    if column in ("record_id", "refers_to", "target_uri") and shown[:1] == "<" and shown[-1:] == ">":
        return shown[1:-1]
    return shown[5:] if column == "payload_digest" and shown[:5].lower() == "sha1:" else shown


def member(row: dict) -> bytes:
    """One record as a gzip member with the skip-length field. A revisit keeps its HTTP headers, not its payload."""
    block = row["payload"] or b""
    kind = "application/octet-stream"
    if row["record_type"] in ("response", "revisit"):
        revisit = row["record_type"] == "revisit"
        size = row["payload_bytes"] if revisit and row["payload_bytes"] is not None else len(block)
        block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
                 + (b"" if revisit else block))
        kind = "application/http; msgtype=response"
    head, own = ["WARC/1.1"], {}
    for column, name in _HEADERS.items():
        value = row.get(column)
        if (shown := _shown(column, value)) is not None:
            head.append(f"{name}: {shown}")
        if _meant(column, shown) != value and not (column == "record_date" and value is None):
            own[column] = value
    if own:
        head.append(f"X-Row: {json.dumps(own)}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Type: {kind}\r\nContent-Length: {len(block)}")
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    data = deflate.compress(record) + deflate.flush()
    field = b"sl\x08\x00" + struct.pack("<II", len(data) + 32, len(record))
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(field)) + field + data
            + struct.pack("<II", zlib.crc32(record), len(record)))


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Headers by lower-case name, the first of a name; folded lines are joined."""
    out, name = {}, None
    for line in (x.decode("utf-8", "replace") for x in lines):
        if line[:1] in (" ", "\t") and name is not None:
            out[name] += f" {line.strip(BLANKS)}"
            continue
        key, colon, value = line.partition(":")
        name = key.strip(BLANKS).lower() if colon else None
        name = None if name in out else name
        if name is not None:
            out[name] = value.strip(BLANKS)
    return out


class Stream:
    """The records' bytes of one open file, in steps: gzip members with a skip length one by one, else members as one
    stream, else the file as it is."""

    def __init__(self, raw):
        self.raw, self.size, self.held = raw, raw.size(), b""
        self.packed = b""            # read, not yet inflated
        self.inflate = None
        self.left = None             # compressed bytes of the current member with a skip length
        self.gzip = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)

    def more(self, step: int) -> bool:
        """Hold more bytes; False at the end."""
        if not self.gzip:
            data = self.raw.read(step)
        elif self.left is not None:
            packed = self.raw.read(min(step, self.left))
            self.left -= len(packed)
            data = self.inflate.decompress(packed)
            if not data and packed:
                return self.more(step)
        else:
            data = b""
            while not data:
                if self.inflate is None:
                    self.packed = self.packed.lstrip(b"\0") or self.raw.read(_STEP).lstrip(b"\0")
                    if not self.packed:
                        return False
                    self.inflate = zlib.decompressobj(31)
                data = self.inflate.decompress(self.packed, _STEP)
                if self.inflate.eof:
                    self.packed, self.inflate = self.inflate.unused_data, None
                elif not (packed := self.inflate.unconsumed_tail) and not data:
                    if not (packed := self.raw.read(_STEP)):
                        raise ValueError("the file ends inside a gzip member")
                    self.packed = packed
                else:
                    self.packed = packed
        self.held += data
        return bool(data)

    def start(self) -> bool:
        """Go to the next record; False at the end of the file."""
        if self.left is not None:
            self.raw.seek(self.left + 8, 1)
            self.left, self.held, self.inflate = None, b"", None
        if self.gzip and not self.held and not self.packed and self.inflate is None:
            place = self.raw.tell()
            fixed = self.raw.read(24)
            if len(fixed) == 24 and fixed[:4] == b"\x1f\x8b\x08\x04" and fixed[12:16] == b"sl\x08\x00":
                self.left = struct.unpack("<I", fixed[16:20])[0] - 32
                self.inflate = zlib.decompressobj(-15)
                if self.left < 0 or place + self.left + 32 > self.size:
                    raise ValueError("the file ends inside a record")
            else:
                self.raw.seek(place)
        self.held = self.held.lstrip(b"\r\n")
        while not self.held and self.more(_HEAD):
            self.held = self.held.lstrip(b"\r\n")
        return bool(self.held)

    def until_blank_line(self, most: int) -> bytes | None:
        """The bytes up to a blank line, which is passed; None, and nothing passed, without one in so many bytes."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3), most)) < 0:
            seen = len(self.held)
            if seen >= most or not self.more(_HEAD):
                return None
        head, self.held = self.held[:at], self.held[at + 4:]
        return head

    def take(self, n: int, keep: bool = True) -> bytes:
        """Pass n bytes; they are returned, or dropped step by step."""
        parts = []
        while n > 0:
            if not self.held:
                if not keep and not self.gzip:
                    if self.raw.tell() + n > self.size:
                        raise ValueError("the file ends inside a record")
                    self.raw.seek(n, 1)
                    break
                if not self.more(_STEP):
                    raise ValueError("the file ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def drop(self, n: int) -> None:
        """Pass the n bytes that the record still has; start() jumps over a member with a skip length."""
        if self.left is None:
            self.take(n, keep=False)


def records(raw, wanted, with_payload: bool):
    """Rows of one open file. wanted(row) decides on the headers alone."""
    stream = Stream(raw)
    while stream.start():
        head = stream.until_blank_line(_MOST)
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        named = _headers(head.split(b"\r\n")[1:])
        row = {c: _meant(c, named.get(h.lower())) for c, h in _HEADERS.items()}
        if "x-row" in named:
            row |= json.loads(named["x-row"])
        if "content-length" not in named:
            raise ValueError("a record without content length")
        size = int(named["content-length"])
        if not wanted(row):
            stream.drop(size)
            continue
        revisit = row["record_type"] == "revisit"
        told = None
        if named.get("content-type", "").lower().startswith("application/http"):
            http = stream.until_blank_line(min(size, _MOST))
            if http is not None:
                size -= len(http) + 4
                told = _headers(http.split(b"\r\n")[1:]).get("content-length")
        row["payload_bytes"] = size if not revisit else int(told) if told and told.isdecimal() else None
        row["payload"] = None
        if with_payload and not revisit:
            row["payload"] = stream.take(size)
        else:
            stream.drop(size)
        yield row


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        done, out, held, name = [], None, 0, ""
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, held = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(posixpath.join(top, name), compression=None)
                    held += out.write(data := member(row)) or len(data)
                    if held >= FILE_BYTES:
                        out.close()
                        done.append([name, held])
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append([name, held])
        return Written(done)

    def commit(self, messages) -> None:
        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(posixpath.join(top, f"_manifest-{uuid.uuid4().hex}.json")) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        fs, top = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(posixpath.join(top, name))


@dataclass
class Files(InputPartition):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, split: int):
        self.path, self.with_payload, self.split, self.tests = path, with_payload, split, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADERS or not isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "set", None))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "start", f.value))
            else:
                self.tests.append((column, "in", list(f.value) if isinstance(f, In) else [f.value]))

    def _files(self) -> list:
        """Names and sizes, sorted: of the manifests, or of the archives found at the path (a folder or one file)."""
        fs, top = file_system(self.path)
        if fs.get_file_info(top).type == pafs.FileType.File:
            return [["", fs.get_file_info(top).size]]
        found = [i for i in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if i.type == pafs.FileType.File]
        listed = [i for i in found if posixpath.dirname(i.path) == top.rstrip("/") and i.base_name.startswith("_manifest-")]
        if not listed:
            return sorted([posixpath.relpath(i.path, top), i.size] for i in found
                          if i.base_name.lower().endswith((".warc.gz", ".warc")))
        files = []
        for manifest in listed:
            with fs.open_input_stream(manifest.path) as f:
                files += json.loads(f.read())
        return sorted(files)

    def partitions(self):
        parts, held = [], self.split
        files = self._files()
        for name, size in files:
            if held + size > self.split:
                parts.append(Files([]))
                held = 0
            parts[-1].names.append(name)
            held += size
        return parts or [Files([])]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            got = row[column]
            if got is None or kind == "in" and got not in value or kind == "start" and not got.startswith(value):
                return False
        return True

    def read(self, partition):
        fs, top = file_system(self.path)
        schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string())
                            for c in _COLUMNS])
        for name in partition.names:
            rows, held = [], 0
            with fs.open_input_file(posixpath.join(top, name) if name else top) as f:
                try:
                    for row in records(f, self._wanted, self.with_payload):
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                except (ValueError, zlib.error) as wrong:
                    raise ValueError(f"{posixpath.join(self.path, name)}: {wrong}") from wrong
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true",
                          int(self.options.get("split", 128 << 20)))

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.select(*_COLUMNS).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records of the rows (page_id, url, html). Of equal payloads of at least ``least`` bytes the smallest page_id is
    the response, other page_ids are revisits of it; rows with the very smallest page_id are all responses, and so are
    all rows of a group without any page_id. The join carries only groups of two rows or more, so Spark broadcasts
    it while that is small, and else splits its hot groups."""
    rows = pages.select("page_id", F.col("url").alias("target_uri"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1_column(F.col("payload")))
    groups = (rows.filter(F.length("payload") >= least).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1 and first is not null").select("payload_digest", "first"))
    groups = _base.stored(groups, "warc-groups").withColumnRenamed("payload_digest", "_digest")
    joined = rows.join(groups, rows["payload_digest"] == groups["_digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    size = F.length("payload").cast("long")
    return joined.select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"), "payload_digest",
        size.alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
        F.lit(None).cast("string").alias("record_date"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read both record types back through their pushed filters. A response's size and digest are
    taken from its payload as read, a revisit's from its headers, its payload being left out."""
    path = _base.scratch(spark, "warc")
    write_warc(page_records(_base.table(spark, sf_dir, "pages")), path)
    full = read_warc(spark, path).filter("record_type = 'response'").select(
        "record_id", F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1_column(F.col("payload")).alias("payload_digest"), "record_type", "refers_to", "target_uri")
    again = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(
        "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
    both = full.unionByName(again)
    return both.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", F.col("refers_to").cast("long").alias("refers_to"), F.col("target_uri").alias("url"))



