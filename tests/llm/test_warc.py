from __future__ import annotations

import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genotiles.llm.warc import ArchiveWriter, WarcOptions, archive_report, parse_records, record_bytes, stored_members

PAGES = "page_id long, url string, html string"


def source_of(data):
    return pa.PythonFile(io.BytesIO(data), mode="r")


class Kept(io.BytesIO):
    def close(self):
        self.data = self.getvalue()
        super().close()


def test_archives_agree_with_zipfile():
    sink = Kept()
    writer = ArchiveWriter(sink)
    members = {"a": b"x" * 70_000, "b/é": b"", "c": b"PK\5\6 looks like an end"}
    for name, data in members.items():
        writer.begin(name)
        for i in range(0, len(data), 999):
            writer.write(data[i:i + 999])
        writer.end()
    writer.close()
    with zipfile.ZipFile(io.BytesIO(sink.data)) as theirs:
        assert theirs.testzip() is None and {n: theirs.read(n) for n in theirs.namelist()} == members
    ours = stored_members(source_of(sink.data))
    assert {n: sink.data[at:at + size] for n, (at, size) in ours.items()} == members


def test_foreign_archives():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as out:
        out.writestr("one", b"1" * 10)
        out.comment = b"note"
    data = plain.getvalue()
    ((at, size),) = stored_members(source_of(data)).values()
    assert data[at:at + size] == b"1" * 10
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("one", b"1" * 1000)
    for broken in (packed.getvalue(), b"", b"no archive" * 9, data[:-30]):
        with pytest.raises(ValueError):
            stored_members(source_of(broken))
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as out:
        for i in range(70_000):
            out.writestr(f"{i}", b"")
    assert struct.unpack_from("<H", many.getvalue(), len(many.getvalue()) - 12)[0] == 65_535
    assert len(stored_members(source_of(many.getvalue()))) == 70_000


def test_records_round_trip():
    payload = "é\r\n\r\nWARC/1.1\r\n\0".encode()
    data = record_bytes(7, "http://x/a\r\nb", payload, "d", None) + record_bytes(None, None, payload, "d", 7)
    (one, http, got), (two, http2, none) = parse_records(data)
    assert got == payload and none == b"" and one["warc-type"] == "response" and two["warc-refers-to"] == "<urn:page:7>"
    assert http["content-length"] == http2["content-length"] == str(len(payload)) and one["warc-target-uri"] == "http://x/a b"


@pytest.mark.parametrize("options", [WarcOptions(), WarcOptions(archive_bytes=5000, range_bytes=1500)])
def test_report(spark, options):
    long, other = "é" * 500, "y" * 1000
    rows = [(i, f"http://h/{i}", long) for i in range(40)] + [(100, None, other), (101, "u", other), (102, "u", "y" * 999)]
    rows += [(103, "u", "y" * 999), (104, "u", None), (105, "u", ""), (106, "u", "z" * 20_000), (None, "u", long)]
    rows += [(200, "u", "w" * 1200), (200, "u", "w" * 1200), (None, "u", "v" * 1100), (None, "u", "v" * 1100)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    got = archive_report(pages, options).cache()
    largest = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000 and i is not None:
            largest[html] = max(i, largest.get(html, i))
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html)
        to = None if first is None or first == i else first
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(got.drop("intact").collect()) == as_text(expected)
    assert got.where("NOT intact").count() == 0


def test_empty_table(spark):
    assert archive_report(spark.createDataFrame([], PAGES)).count() == 0
