"""WARC records as other programs write and read them: validity of ours, plain and gzipped archives of theirs."""
import gzip
import re

import pyarrow as pa
import pytest

from tierwise.llm import warc


def record(kind, uri, block, content="application/http; msgtype=response", extra="", name="WARC-Type"):
    head = (f"WARC/1.0\r\n{name}: {kind}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nWARC-Record-ID: <urn:uuid:{kind}-{len(block)}>\r\n"
            + (f"WARC-Target-URI: {uri}\r\n" if uri else "") + extra
            + f"Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


BIG = bytes(range(256)) * 8000
HTTP = b"HTTP/1.1 200 OK\r\ncontent-length: %d\r\n\r\n"
RECORDS = [
    record("warcinfo", None, b"software: other\r\nformat: WARC\r\n", "application/warc-fields"),
    record("request", "http://a.b/x%20y", b"GET /x%20y HTTP/1.1\r\nHost: a.b\r\n\r\n", "application/http; msgtype=request"),
    record("response", "http://a.b/x%20y", HTTP % 7 + b"a\r\n\r\nbc", extra="WARC-Payload-Digest: sha1:ABC\r\n", name="warc-type"),
    record("response", "<http://a.b/big>", HTTP % len(BIG) + BIG, extra="X-Folded: one\r\n two\r\n"),
    record("revisit", "http://a.b/z", HTTP % 7, extra="WARC-Refers-To: <urn:uuid:response-50>\r\n"),
    record("revisit", "http://a.b/none", b""),
    record("resource", "file:/r", b"raw \r\n\r\n bytes", "text/plain"),
    record("response", "http://a.b/nohead", b"no blank line"),
]
WANT = [("warcinfo", None, 31, b"software: other\r\nformat: WARC\r\n"), ("request", "http://a.b/x%20y", 0, b""),
        ("response", "http://a.b/x%20y", 7, b"a\r\n\r\nbc"), ("response", "http://a.b/big", len(BIG), BIG),
        ("revisit", "http://a.b/z", 7, None), ("revisit", "http://a.b/none", None, None),
        ("resource", "file:/r", 14, b"raw \r\n\r\n bytes"), ("response", "http://a.b/nohead", 13, b"no blank line")]
FORMS = {"members.warc.gz": b"".join(map(gzip.compress, RECORDS)), "one.warc.gz": gzip.compress(b"".join(RECORDS)),
         "plain.warc": b"".join(RECORDS),
         "padded.warc.gz": b"".join(gzip.compress(r) for r in RECORDS) + b"\0" * 40}


def rows(data, wanted=lambda row: True, payload=True):
    return [(r["record_type"], r["target_uri"], r["payload_bytes"], r["payload"])
            for r in warc.records(pa.BufferReader(data), wanted, payload)]


@pytest.mark.parametrize("form", FORMS)
def test_foreign_archives(form):
    assert rows(FORMS[form]) == WANT
    assert rows(FORMS[form], payload=False) == [(*w[:3], None) for w in WANT]
    assert rows(FORMS[form], lambda r: r["record_type"] == "response") == [w for w in WANT if w[0] == "response"]


@pytest.mark.parametrize("form", FORMS)
def test_cut_archives_raise(form):
    data = FORMS[form]
    for cut in (300, len(data) // 2):
        with pytest.raises(ValueError):
            rows(data[:cut])
    with pytest.raises(ValueError):
        rows(b"something else\r\n\r\n")
    assert rows(b"") == []


def test_ours_and_theirs_in_one_file():
    row = {"record_id": "7", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "X",
           "payload_bytes": 3, "payload": b"abc"}
    mine = ("response", "u", 3, b"abc")
    assert rows(warc.member(row) + FORMS["members.warc.gz"]) == [mine, *WANT]
    assert rows(FORMS["members.warc.gz"] + warc.member(row) * 2) == [*WANT, mine, mine]
    with pytest.raises(ValueError):
        rows(warc.member(row)[:-20])


def test_unwanted_payloads_are_not_decoded(monkeypatch):
    row = {"record_id": "7", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": None,
           "payload_bytes": None, "payload": BIG}
    read = []
    more = warc.Stream.more

    def counted(self, step):
        before = len(self.held)
        found = more(self, step)
        read.append(len(self.held) - before)
        return found
    monkeypatch.setattr(warc.Stream, "more", counted)
    assert rows(warc.member(row) * 5, lambda r: False) == [] and sum(read) < len(BIG)
    read.clear()
    assert rows(FORMS["plain.warc"], lambda r: r["target_uri"] == "none") == [] and sum(read) < len(BIG) // 4


def test_our_records_are_valid():
    row = {"record_id": "7", "record_type": "revisit", "target_uri": "http://a.b/x%20y", "refers_to": "3", "payload_digest": "ABC",
           "payload_bytes": 3, "payload": None, "record_date": None}
    head, _, block = gzip.decompress(warc.member(row)).partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    uri = r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>"
    assert re.fullmatch(uri, named["WARC-Record-ID"]) and re.fullmatch(uri, named["WARC-Refers-To"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", named["WARC-Date"])
    assert named["WARC-Target-URI"] == "http://a.b/x%20y" and named["WARC-Payload-Digest"] == "sha1:ABC"
    assert int(named["Content-Length"]) == len(block) - 4
    first = gzip.decompress(warc.member(row | {"record_id": "3", "refers_to": None, "record_type": "response", "payload": b"abc"}))
    assert f"WARC-Record-ID: {named['WARC-Refers-To']}\r\n".encode() in first


@pytest.mark.parametrize("value", [None, "", " a ", "a\r\nb: c", "%20%", "<x>", "é\u2028", "urn:x:1", "sha256:00", "\0"])
def test_any_value_comes_back(value):
    row = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "record_date"), value)
    got, = warc.records(pa.BufferReader(warc.member(row | {"payload": b"p", "payload_bytes": 1})), lambda r: True, True)
    date = got.pop("record_date")
    row.pop("record_date")
    assert got == row | {"payload": b"p", "payload_bytes": 1} and (date == value if value is not None else date.endswith("Z"))


def test_folders_without_manifest_and_appending(spark, tmp_path):
    top = tmp_path / "theirs"
    (top / "deep").mkdir(parents=True)
    for i, (name, data) in enumerate(FORMS.items()):
        (top / ("deep" if i % 2 else ".") / name).write_bytes(data)
    (top / "notes.txt").write_bytes(b"no archive")
    got = warc.read_warc(spark, str(top)).filter("record_type = 'response'").collect()
    assert sorted((r.target_uri, bytes(r.payload)) for r in got) == sorted((w[1], w[3]) for w in WANT if w[0] == "response" for _ in FORMS)
    assert {r.record_date for r in got} == {"2020-01-02T03:04:05Z"}
    assert warc.read_warc(spark, str(top / "plain.warc"), payload=False).count() == len(WANT)
    pages = spark.createDataFrame([(1, "u", "one"), (2, "v", "two")], "page_id long, url string, html string")
    for k in (1, 2):
        warc.write_warc(warc.page_records(pages), str(tmp_path / "ours"))
        assert warc.read_warc(spark, str(tmp_path / "ours")).count() == 2 * k
