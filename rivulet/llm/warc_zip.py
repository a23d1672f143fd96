"""WARC records in ZIP archives: packing, and reading back by range without extraction.

An archive holds two stored (uncompressed) members: `archive/data.warc.gz`, each record a gzip member of its own, and
`indexes/index.cdx`, a line of JSON for each record with its place in the WARC member. The reader parses the end
record, the ZIP64 end record and locator, the central directory and the members' local headers, finds the index and
reads each record by its range. Nothing is unpacked to disk, and no more than a record is held besides the index.

Files are opened through `pyarrow.fs`, so archives may be on a shared folder, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, new_path, table

# Fixed values of the ZIP format (APPNOTE 4.3, 4.5).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
END_BYTES, LOCATOR_BYTES, MAX_COMMENT, ZIP64_TAG = 22, 20, 0xFFFF, 0x0001
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A new archive is begun when the open one holds this many bytes of records.
ARCHIVE_BYTES = 128 << 20
CRLF = b"\r\n"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    offset: int  # of its local header
    packed: int
    size: int


def open_input(uri: str) -> BinaryIO:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def open_output(uri: str) -> BinaryIO:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def read_range(f: BinaryIO, offset: int, n: int) -> bytes:
    f.seek(offset)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"archive ends at {offset + len(got)}, wanted {offset + n}")
    return bytes(got)


def directory(f: BinaryIO, size: int) -> list[Member]:
    """The members by the central directory; ZIP64 fields are followed where the short ones are full."""
    tail_at = max(0, size - END_BYTES - MAX_COMMENT)
    tail = read_range(f, tail_at, size - tail_at)
    # The last record whose comment goes just to the end of the file; a comment may have the signature in it.
    at = tail.rfind(END)
    while at >= 0 and (at + END_BYTES > len(tail) or at + END_BYTES + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at + len(END) - 1)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= LOCATOR_BYTES and (loc := read_range(f, end_at - LOCATOR_BYTES, LOCATOR_BYTES)).startswith(LOCATOR64):
        (end64,) = struct.unpack_from("<Q", loc, 8)
        record = read_range(f, end64, 56)
        if not record.startswith(END64):
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    block, out, p = read_range(f, start, length), [], 0
    for _ in range(count):
        if block[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", block, p + 10)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", block, p + 20)
        (offset,) = struct.unpack_from("<I", block, p + 42)
        name, extra = block[p + 46 : p + 46 + n], block[p + 46 + n : p + 46 + n + m]
        wide = _zip64(extra)
        if plain == 0xFFFFFFFF:
            plain = next(wide)
        if packed == 0xFFFFFFFF:
            packed = next(wide)
        if offset == 0xFFFFFFFF:
            offset = next(wide)
        out.append(Member(name.decode("utf-8"), method, offset, packed, plain))
        p += 46 + n + m + k
    return out


def _zip64(extra: bytes) -> Iterator[int]:
    p = 0
    while p + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, p)
        if tag == ZIP64_TAG:
            yield from struct.unpack_from(f"<{n // 8}Q", extra, p + 4)
        p += 4 + n


def data_at(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin: after its local header, whose own lengths count."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = read_range(f, member.offset, 30)
    if not head.startswith(LOCAL):
        raise ValueError(f"no local header of {member.name}")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.offset + 30 + n + m


class Archive:
    """Writes one archive: records as they come, then the index, the central directory and the end records."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.at, self.lines, self.crc, self.members = f, 0, [], 0, []
        self._begin(DATA)

    def _put(self, data: bytes) -> None:
        self.f.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        # Sizes follow the data (flag 8), so records stream; the UTF-8 flag is set.
        self.start, self.crc = self.at, 0
        raw = name.encode()
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", ZIP64_TAG, 16, 0, 0))
        self.name, self.first = raw, self.at

    def _end(self) -> None:
        size = self.at - self.first
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.start))

    def add(self, record: bytes, about: dict) -> None:
        packed = zlib.compress(record, 1, 31)
        self.lines.append(json.dumps(about | {"offset": self.at - self.first, "length": len(packed)}))
        self.crc = zlib.crc32(packed, self.crc)
        self._put(packed)

    def size(self) -> int:
        return self.at

    def close(self) -> int:
        self._end()
        self._begin(INDEX)
        lines = "".join(x + "\n" for x in self.lines).encode()
        self.crc = zlib.crc32(lines)
        self._put(lines)
        self._end()
        start = self.at
        for name, crc, size, offset in self.members:
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", ZIP64_TAG, 24, size, size, offset))
        length, n = self.at - start, len(self.members)
        end64 = self.at
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        self.f.close()
        return self.at


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that has the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8") + CRLF + CRLF + block + CRLF + CRLF


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode("utf-8") for k, _, v in (x.partition(b":") for x in lines.split(CRLF)[1:])}


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields, body."""
    head, _, rest = record.partition(CRLF + CRLF)
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(CRLF + CRLF)
    return fields, _fields(http), body


def _id(urn: str | None) -> int | None:
    last = (urn or "none").strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def pack(pages: DataFrame, out_dir: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, html, refers_to) as archives under `out_dir`; returns (uri, bytes, records).

    Run it through `cut`, once: rows come out as files are written. A task that is tried again writes files of
    other names, and only those of the try that counts are in the result.
    """

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, uri = None, ""
        for pdf in batches:
            for page_id, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                if archive is None:
                    uri = f"{out_dir}/{uuid.uuid4().hex}.zip"
                    archive = Archive(open_output(uri))
                archive.add(record_bytes(_int(page_id), url, (html or "").encode("utf-8"), _int(refers)), {"page_id": _int(page_id)})
                if archive.size() >= archive_bytes:
                    yield pd.DataFrame({"uri": [uri], "bytes": [archive.close()], "records": [len(archive.lines)]})
                    archive = None
        if archive is not None:
            yield pd.DataFrame({"uri": [uri], "bytes": [archive.close()], "records": [len(archive.lines)]})

    # As objects, so that ids stay whole numbers beside nulls.
    return pages.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string")).mapInPandas(write, "uri string, bytes long, records long")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Index entries of one range of work; bytes of an index that are looked at at a time.
RANGE_RECORDS, INDEX_BYTES = 4_096, 8 << 20
#: Reading tasks, at most: beyond it a task takes several ranges, one after the other.
MOST_TASKS = 20_000


def stretches(f: BinaryIO, start: int, size: int, records: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, bytes, lines) of each `records` lines of an index; no more of it is held than INDEX_BYTES."""
    begin = at = start
    lines = 0
    while at < start + size:
        block = read_range(f, at, min(INDEX_BYTES, start + size - at))
        p = block.find(b"\n") + 1
        while p:
            lines += 1
            if lines == records:
                yield begin, at + p - begin, lines
                begin, lines = at + p, 0
            p = block.find(b"\n", p) + 1
        at += len(block)
    if begin < at:
        yield begin, at - begin, lines + (block[-1:] != b"\n")


def ranges(archives: DataFrame, records: int = RANGE_RECORDS) -> DataFrame:
    """(uri, data_start, index_start, index_bytes): stretches of each archive's index, as work for readers."""

    def plan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, size in zip(pdf["uri"], pdf["bytes"], strict=True):
                with open_input(uri) as f:
                    members = {m.name: m for m in directory(f, int(size))}
                    data, index = data_at(f, members[DATA]), members[INDEX]
                    rows = [(uri, data, first, n) for first, n, _ in stretches(f, data_at(f, index), index.size, records)]
                yield pd.DataFrame(rows, columns=["uri", "data_start", "index_start", "index_bytes"])

    return archives.mapInPandas(plan, "uri string, data_start long, index_start long, index_bytes long")


def dealt(work: DataFrame) -> DataFrame:
    """Ranges, written and dealt over tasks of their own: rows of work are small, what they stand for isn't."""
    work = cut(work, "ranges")
    return work.repartition(max(1, min(MOST_TASKS, work.count())), "uri", "index_start")


def read(work: DataFrame) -> DataFrame:
    """The records of `ranges`: a row each, digest and length checked against the payload where there is one."""

    def fetch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, start, index_start, index_bytes in pdf.itertuples(index=False):
                with open_input(uri) as f:
                    rows, held = [], 0
                    for line in read_range(f, index_start, index_bytes).splitlines():
                        e = json.loads(line)
                        rows.append(_row(zlib.decompress(read_range(f, start + e["offset"], e["length"]), 31)))
                        held += len(rows[-1][-1] or b"")
                        if held >= 16 << 20:
                            yield pd.DataFrame(rows, columns=COLUMNS).astype(dict.fromkeys(IDS, "Int64"))
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=COLUMNS).astype(dict.fromkeys(IDS, "Int64"))

    return work.mapInPandas(fetch, READ_SCHEMA)


COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
IDS = ["page_id", "payload_bytes", "refers_to"]


def _row(record: bytes) -> tuple:
    fields, http, body = parse_record(record)
    kind, n, sha = fields["warc-type"], int(http["content-length"]), fields["warc-payload-digest"].partition(":")[2]
    if kind == "response" and (len(body) != n or digest(body) != sha):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    return _id(fields["warc-record-id"]), fields.get("warc-target-uri"), n, sha, kind, _id(fields.get("warc-refers-to")), body if kind == "response" else None


def with_referents(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to) of each row: for a payload of at least `min_bytes` bytes that a smaller page_id
    has too, the least such id.

    Null html is an empty payload. Rows with null page_id are responses and are referred to by none; of rows with the
    same id and payload all are responses. Other columns are left out; an empty table gives an empty result.

    Payloads meet by digest without their html: a digest that a great part of the rows shares moves ids alone. Those
    that revisit are then joined by (page_id, digest), which spreads evenly.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select("page_id", F.sha2(body, 256).alias("__sha"), F.octet_length(body).alias("__n")).where((F.col("__n") >= min_bytes) & F.col("page_id").isNotNull())
    first = cut(ids.groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count("*").alias("__of")).where("__of > 1").select("__sha", "__first"), "payloads")
    again = cut(ids.join(first, "__sha").where("__first < page_id").select("page_id", "__sha", F.col("__first").alias("__refers")).distinct(), "revisits")
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("__sha"))
    return rows.join(again, ["page_id", "__sha"], "left").select("page_id", "url", "html", F.col("__refers").alias("refers_to"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_referents(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    archives = cut(pack(pages, new_path(spark, "warc")), "manifest")
    return read(dealt(ranges(archives))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_zip": op4_warc_zip}
# html as UTF-8; SHA-1 in base32 from its hex, five bits a character.
ORACLE = {
    "op4_warc_zip": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(0, 4), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * CAST(g AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31)::INTEGER, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f"""
}
