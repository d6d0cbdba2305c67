"""WARC archives packed as ZIP files: written by tasks, read again by byte ranges.

An archive is a ZIP whose members are stored, not compressed: `data.warc` holds WARC records one after another,
`index.tsv` a line per record (byte range in data.warc). A reader opens the end of the file, follows the ZIP64
records where there are any, reads the central directory, finds where a stored member's bytes start from the
member's local header, and reads record ranges from there. Nothing is extracted and no archive is read whole.

Files are reached through their URI (local, HDFS, object stores) by pyarrow.fs. A task writes to a name of its
own and reports it; only reported archives are read, so a repeated task leaves nothing but an unread file.

Of records with equal payloads of at least `min_bytes`, the one with the largest page_id is the response, and others
revisit it: they keep the HTTP header, whose Content-Length is the payload's, but not the payload.

Cases: a null payload is empty; a null page_id is written as such, revisits others and is revisited by none but
rows without id; rows that share the largest page_id and payload are all responses; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.bits import maybe_in
from genotiles.llm.tables import new_path, written
from genotiles.llm.tokens import column_of

DATA, INDEX = "data.warc", "index.tsv"


@dataclass(frozen=True)
class WarcOptions:
    min_bytes: int = 1000
    #: Bytes of data.warc after which a task starts another archive.
    archive_bytes: int = 256 << 20
    #: Bytes of records that one row of the read plan covers, about.
    range_bytes: int = 4 << 20


# ---- ZIP, the fixed layout of its records ----
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64, _EXTRA64 = b"PK\x06\x06", b"PK\x06\x07", 0x0001
_FULL32, _FULL16, _UTF8 = 0xFFFFFFFF, 0xFFFF, 0x0800


class ArchiveWriter:
    """Stored members, streamed to a file that is never read or rewound.

    Sizes and checksum of a member follow its bytes (a data descriptor); sizes and offsets go to ZIP64 fields
    always, so a member may grow beyond 4 GB while it is written.
    """

    def __init__(self, sink):
        self.sink, self.at, self.members, self.open = sink, 0, [], None

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        encoded = name.encode()
        self.open = [encoded, self.at, 0, 0]
        extra = struct.pack("<HHQQ", _EXTRA64, 16, 0, 0)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 8 | _UTF8, 0, 0, 0x21, 0, _FULL32, _FULL32, len(encoded), len(extra)))
        self._put(encoded + extra)

    def write(self, data: bytes) -> None:
        self._put(data)
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])

    def end(self) -> None:
        _, _, size, check = self.open
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", check, size, size))
        self.members.append(self.open)
        self.open = None

    def close(self) -> None:
        start = self.at
        for name, offset, size, check in self.members:
            extra = struct.pack("<HHQQQ", _EXTRA64, 24, size, size, offset)
            self._put(_CENTRAL + struct.pack(
                "<HHHHHHIIIHHHHHII", 45, 45, 8 | _UTF8, 0, 0, 0x21, check, _FULL32, _FULL32, len(name), len(extra), 0, 0, 0, 0, _FULL32,
            ))
            self._put(name + extra)
        size, end64, count = self.at - start, self.at, len(self.members)
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start))
        self._put(_LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(count, _FULL16), min(count, _FULL16), min(size, _FULL32), _FULL32, 0))
        self.sink.close()


def stored_members(source) -> dict[str, tuple[int, int]]:
    """(first byte, size) of every member of an open archive, from its central directory.

    Raises ValueError where the file is no ZIP, or a member is compressed or encrypted.
    """
    size = source.size()
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if _FULL16 == count or _FULL32 in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        record = source.read_at(56, end64)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = source.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", directory, at + 20)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_size].decode()
        extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
        if method or flags & 1:
            raise ValueError(f"{name} is not stored")
        wide = _wide_fields(extra)
        # ZIP64 fields stand in this order, each only where its 32-bit field is full.
        full, packed, offset = (next(wide) if value == _FULL32 else value for value in (full, packed, offset))
        head = source.read_at(30, offset)
        if head[:4] != _LOCAL:
            raise ValueError(f"{name} has no local header")
        found[name] = (offset + 30 + sum(struct.unpack_from("<HH", head, 26)), full)
        at += 46 + name_size + extra_size + note_size
    return found


def _wide_fields(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == _EXTRA64:
            yield from struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
        at += 4 + size


# ---- WARC records ----
def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response, or a revisit of another page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    target = "" if url is None else " ".join(url.split())
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of whole records, field names in lower case."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record")
        head_end = data.index(b"\r\n\r\n", at) + 4
        fields = _fields(data[at:head_end])
        end = head_end + int(fields["content-length"])
        http_end = data.index(b"\r\n\r\n", head_end, end) + 4
        yield fields, _fields(data[head_end:http_end]), data[http_end:end]
        at = end + 4


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page(uri: str | None) -> int | None:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


# ---- Spark jobs ----
def _write_archives(folder: str, options: WarcOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        writer = None
        index: list[str] = []

        def finish() -> pa.RecordBatch:
            size = writer.open[2]
            writer.end()
            writer.begin(INDEX)
            writer.write("".join(index).encode())
            writer.end()
            writer.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [len(index)], "data_bytes": [size]})

        for batch in batches:
            names = ("page_id", "url", "html", "digest", "refers_to")
            # Row by row: a batch as Python objects is several times as large.
            for row in zip(*(column_of(batch, c) for c in names), strict=True):
                page_id, url, html, digest, refers_to = (value.as_py() for value in row)
                if writer is None:
                    name, index = f"{uuid.uuid4().hex}.zip", []
                    files.create_dir(root, recursive=True)
                    writer = ArchiveWriter(files.open_output_stream(f"{root}/{name}"))
                    writer.begin(DATA)
                record = record_bytes(page_id, url, (html or "").encode(), digest, refers_to)
                index.append(f"{writer.open[2]}\t{len(record)}\n")
                writer.write(record)
                if writer.open[2] >= options.archive_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()
    return run


def write_archives(pages: DataFrame, folder: str, options: WarcOptions | None = None) -> DataFrame:
    """Write all pages as archives in folder (a URI that executors share); (archive, records, data_bytes)."""
    options = options or WarcOptions()
    html = F.coalesce("html", F.lit(""))
    records = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = F.octet_length("html") >= options.min_bytes
    originals = written(records.where(long).groupBy("digest").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 AND original IS NOT NULL").select(F.col("digest").alias("key"), "original"), "originals")
    # Pages whose payload occurs once, nearly all, are written where they are read; the others meet their original.
    copied = long & maybe_in(originals.select(F.xxhash64("key").alias("h")), F.xxhash64("digest"))
    met = records.where(copied).join(originals, F.col("digest") == F.col("key"), "left")
    revisit = F.col("original").isNotNull() & ~F.equal_null("page_id", "original")
    columns = ("page_id", "url", "html", "digest")
    alone = records.where(~copied).select(*columns, F.lit(None).cast("long").alias("refers_to"))
    marked = alone.unionByName(met.select(*columns, F.when(revisit, F.col("original")).cast("long").alias("refers_to")))
    return written(marked.mapInArrow(_write_archives(folder, options), "archive string, records long, data_bytes long"), "manifest")


def _plan_ranges(folder: str, options: WarcOptions):
    """Byte ranges of about range_bytes, each of whole records, from the archives' indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in column_of(batch, "archive").to_pylist():
                with files.open_input_file(f"{root}/{archive}") as source:
                    members = stored_members(source)
                    (data_at, _), (index_at, index_size) = members[DATA], members[INDEX]
                    lines = source.read_at(index_size, index_at).decode().splitlines()
                starts, sizes, room = [], [], 0
                for line in lines:
                    at, size = map(int, line.split("\t"))
                    if room < size and (not sizes or sizes[-1] + size > options.range_bytes):
                        starts.append(data_at + at)
                        sizes.append(0)
                        room = options.range_bytes
                    sizes[-1] += size
                    room -= size
                yield pa.RecordBatch.from_pydict({"archive": [archive] * len(starts), "at": starts, "size": sizes})
    return run


def _read_ranges(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, at, size in zip(*(column_of(batch, c).to_pylist() for c in ("archive", "at", "size")), strict=True):
                with files.open_input_file(f"{root}/{archive}") as source:
                    data = source.read_at(size, at)
                rows = [
                    {
                        "page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"),
                        "record_type": warc["warc-type"], "payload": payload if warc["warc-type"] == "response" else None,
                        "payload_bytes": int(http["content-length"]),
                        "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:"),
                        "refers_to": _page(warc.get("warc-refers-to")),
                        "intact": warc["warc-type"] != "response"
                        or hashlib.sha1(payload).hexdigest() == warc["warc-payload-digest"].removeprefix("sha1:"),
                    }
                    for warc, http, payload in parse_records(data)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
    return run


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
])
_RECORD_SQL = (
    "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string,"
    " refers_to long, intact boolean"
)


def read_archives(manifest: DataFrame, folder: str, options: WarcOptions | None = None) -> DataFrame:
    """A row per record of the archives named in manifest; a response has its payload, a revisit none."""
    options = options or WarcOptions()
    ranges = (
        manifest.select("archive").repartition("archive")
        .mapInArrow(_plan_ranges(folder, options), "archive string, at long, size long").repartition("archive", "at")
    )
    return ranges.mapInArrow(_read_ranges(folder), _RECORD_SQL)


def archive_report(pages: DataFrame, options: WarcOptions | None = None) -> DataFrame:
    """Pages written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    folder = new_path(pages.sparkSession, "archives")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    manifest = write_archives(pages, folder, options)
    return read_archives(manifest, folder, options).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )
