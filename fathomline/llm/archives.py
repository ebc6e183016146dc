"""Web archives inside ZIP packages: written, and read by ranges without extraction.

A package stores, uncompressed, an archive of WARC records (each a gzip member of
its own) and an index with the place of every record. Reading parses the central
directory (ZIP64 records included), finds the stored members through their local
headers, turns the index into byte ranges, and reads these ranges in parallel.

Records with equal payloads: the one with the largest id is the response, the
others are revisits that name it. A revisit has no payload; its size and digest are
those of the response that it refers to.

A null payload is empty. A null id counts as smaller than all others; if a group of
equal payloads has no other id, its rows are responses. Rows that repeat the
largest id are responses each. A null url becomes an empty one. Only id, url and
payload are read; an empty table gives no packages and no rows.

Packages lie in the shared folder under names that no other attempt uses; the table
of packages, which Spark commits, lists those of the attempts that counted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .arrow import blocks, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 128 << 20
RANGE_BYTES = 4 << 20
SMALLEST = 0
# Signatures and sizes of the ZIP format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 46, 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(ident: int | None, url: str, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{ident}>", "WARC-Date": DATE, "WARC-Target-URI": " ".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Package:
    """A ZIP package in the making."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        files, at = fs.FileSystem.from_uri(self.path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, data: bytes, url: str) -> None:
        self.member.write(data)
        entry = {"url": url, "filename": ARCHIVE.rpartition("/")[2], "offset": self.size, "length": len(data)}
        self.lines.append(f"{url} 20000101000000 {json.dumps(entry)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


class Reader:
    """Stored members of a ZIP package, by reads of ranges only."""

    def __init__(self, path: str):
        files, at = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(at)
        self.members = self._directory()

    def at(self, begin: int, size: int) -> bytes:
        data = self.file.read_at(size, begin)
        if len(data) != size:
            raise ValueError("the package ends too early")
        return data

    def _directory(self) -> dict[str, tuple[int, int]]:
        total = self.file.size()
        tail_at = max(0, total - END_SIZE - 65_535 - LOCATOR_SIZE)
        tail = self.at(tail_at, total - tail_at)
        end = tail.rfind(END)
        while end >= 0 and not (end + END_SIZE <= len(tail) and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no ZIP package")
        count, size, begin = struct.unpack_from("<HII", tail, end + 10)
        if end >= LOCATOR_SIZE and tail[end - LOCATOR_SIZE:end - LOCATOR_SIZE + 4] == LOCATOR:
            where = struct.unpack_from("<Q", tail, end - LOCATOR_SIZE + 8)[0]
            large = self.at(where, 56)
            if large[:4] != END64:
                raise ValueError("the ZIP64 record is not where it should be")
            count, size, begin = struct.unpack_from("<QQQ", large, 32)
        data, out, p = self.at(begin, size), {}, 0
        for _ in range(count):
            if data[p:p + 4] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, p + 8)
            packed, plain, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", data, p + 20)
            local = struct.unpack_from("<I", data, p + 42)[0]
            name = data[p + CENTRAL_SIZE:p + CENTRAL_SIZE + name_size].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[p + CENTRAL_SIZE + name_size:p + CENTRAL_SIZE + name_size + extra_size]
            wide = self._wide(extra)
            if plain == 0xFFFFFFFF:
                plain, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if packed == 0xFFFFFFFF:
                packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if local == 0xFFFFFFFF:
                local = struct.unpack_from("<Q", wide)[0]
            if method == 0 and not flags & 1:
                out[name] = (local, packed)
            p += CENTRAL_SIZE + name_size + extra_size + note_size
        return out

    @staticmethod
    def _wide(extra: bytes) -> bytes:
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                return extra[4:4 + n]
            extra = extra[4 + n:]
        return b""

    def place(self, name: str) -> tuple[int, int]:
        """First byte and size of a stored member's data."""
        local, size = self.members[name]
        head = self.at(local, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError("no local header here")
        name_size, extra_size = struct.unpack_from("<HH", head, 26)
        return local + LOCAL_SIZE + name_size + extra_size, size

    def records(self, index: str = INDEX, archive: str = ARCHIVE) -> Iterator[tuple[int, int]]:
        """Begin and size, in the package, of every record that the index lists."""
        data, size = self.place(archive)
        for line in self.at(*self.place(index)).decode().splitlines():
            entry = json.loads(line[line.index("{"):])
            begin, n = int(entry["offset"]), int(entry["length"])
            if begin + n > size:
                raise ValueError("the index points outside its archive")
            yield data + begin, n


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in blocks(batches, "body"):
            for ident, url, body, refers, revisit in zip(*(b.column(c).to_pylist() for c in ("id", "url", "body", "refers", "revisit"))):
                package = package or Package(folder)
                package.add(record(ident, url, body, refers, revisit), " ".join(url.split()))
                if package.size > PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return run


def write_packages(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", smallest: int = SMALLEST, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` and returns the table of packages: path, records."""
    folder = folder or shared_folder(pages.sparkSession, "packages")
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body")).withColumn("sha", F.sha2("body", 256))
    last = rows.groupBy("sha").agg(F.max("id").alias("last"))
    small = F.length("body") < smallest
    revisit = ~small & F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    told = rows.join(last, "sha").select("id", "url", "body", F.when(revisit, F.col("last")).alias("refers"), revisit.alias("revisit"))
    return written(told.mapInArrow(_write(folder), "path string, records long"), "package-list")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole records, about RANGE_BYTES each."""
    for b in batches:
        for path in b.column("path").to_pylist():
            rows, sizes = [], []
            for begin, n in Reader(path).records():
                if rows and begin == rows[-1] + sum(sizes[-1]) and sum(sizes[-1]) < RANGE_BYTES:
                    sizes[-1].append(n)
                else:
                    rows.append(begin)
                    sizes.append([n])
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(sizes, pa.list_(pa.int64()))], ["path", "begin", "sizes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers: dict[str, Reader] = {}
    for b in batches:
        for path, begin, sizes in zip(*(b.column(c).to_pylist() for c in ("path", "begin", "sizes"))):
            if path not in readers:
                readers = {path: Reader(path)}
            data, at, rows = readers[path].at(begin, sum(sizes)), 0, []
            for n in sizes:
                fields, payload = parsed(zlib.decompress(data[at:at + n], 31))
                at += n
                told = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and digest_of(payload) != told:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                rows.append((_number(fields["warc-record-id"]), None if revisit else payload, told, fields["warc-type"], _number(fields.get("warc-refers-to")), fields["warc-target-uri"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                                             ["id", "payload", "digest", "kind", "refers", "url"])


def _number(urn: str | None) -> int | None:
    n = (urn or "None").strip("<>").rpartition(":")[2]
    return None if n == "None" else int(n)


def read_records(packages: DataFrame) -> DataFrame:
    """All records of the packages: id, payload (null for revisits), digest, kind, refers, url."""
    ranges = packages.select("path").repartition("path").mapInArrow(_ranges, "path string, begin long, sizes array<long>")
    return ranges.repartition("path", "begin").mapInArrow(_read, "id long, payload binary, digest string, kind string, refers long, url string")


def pages_of(records: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a record, revisits with the size of the payload that they refer to."""
    narrow = written(records.select("id", F.length("payload").cast("long").alias("bytes"), "digest", "kind", "refers"), "records")
    responses = narrow.where("kind = 'response'").groupBy(F.col("id").alias("refers"), "digest").agg(F.max("bytes").alias("full"))
    first = narrow.where("kind = 'response'").withColumn("full", F.col("bytes"))
    others = narrow.where("kind = 'revisit'").join(responses, ["refers", "digest"]).select("id", "bytes", "digest", "kind", "refers", "full")
    both = first.select("id", "bytes", "digest", "kind", "refers", "full").unionByName(others)
    return both.select(F.col("id").alias(key), F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
