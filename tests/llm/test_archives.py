"""Packages written and read back, against plain Python and the zipfile module."""

import base64
import hashlib
import io
import struct
import zipfile

import duckdb
import pytest

from fathomline.llm import archives, queries
from fathomline.llm.registry import ORACLE
from tests.conftest import SF
from tests.oracle import check


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(rows, smallest=0):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            last[b] = max(i, last.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= smallest and b in last and i != last[b]
        out.append((i, len(b), base32(b), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=str)


def back(df, **more):
    return sorted((tuple(r) for r in archives.pages_of(archives.read_records(archives.write_packages(df, **more))).collect()), key=str)


def test_pages_come_back(spark, con):
    ok, message = check(spark, con, "op3", queries.op3, ORACLE["op3_zip_archives"], SF)
    assert ok, message
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert back(spark.read.parquet(f"{SF}/pages.parquet")) == plain(rows)


@pytest.mark.parametrize("smallest", [0, 4])
def test_odd_pages(spark, monkeypatch, smallest):
    rows = [(1, "u", None), (2, None, ""), (3, "http://a b\r\nc", "x\r\n\r\ny"), (4, "é", "x\r\n\r\ny"), (5, "u", "WARC/1.1\r\n"), (None, "u", "only null"), (None, "u", "abc"), (6, "u", "abc"), (6, "u", "abc"),
            (7, "u", "é" * 200_000), (8, "u", "é" * 200_000), (9, "u", "PK\5\6" * 50), (9, "v", "other of nine"), (-3, "u", "abc")] + [(100 + i, "u", "same") for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert back(df, smallest=smallest) == plain(rows, smallest)
    assert back(df.where("false")) == []


def test_small_packages_and_ranges(spark, monkeypatch, tmp_path):
    made = archives.Package(str(tmp_path))
    sizes = []
    for i in range(50):
        data = archives.record(i, "u", b"x" * i * 100, None, False)
        made.add(data, "u")
        sizes.append(len(data))
    path, n = made.close()
    assert n == 50 and [x for _, x in archives.Reader(path).records()] == sizes
    z = zipfile.ZipFile(path)
    assert z.testzip() is None and set(z.namelist()) == {archives.ARCHIVE, archives.INDEX}
    begin, size = archives.Reader(path).place(archives.ARCHIVE)
    assert open(path, "rb").read()[begin:begin + size] == z.read(archives.ARCHIVE)


def large_package(members):
    """A package whose sizes, places and counts all stand in ZIP64 records."""
    out, central = io.BytesIO(b"leading bytes"), b""
    out.seek(0, 2)
    for name, data in members.items():
        at, raw = out.tell(), name.encode()
        out.write(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, len(data), len(data)) + data)
        extra = struct.pack("<2H", 0x5455, 1) + b"\0" + struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        central += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra
    begin = out.tell()
    out.write(central)
    end = out.tell()
    out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), begin))
    out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    note = b"a note with PK\5\6 in it"
    out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(note)) + note)
    return out.getvalue()


def test_zip64_directory(tmp_path):
    members = {"a.txt": b"", "indexes/index.cdxj": b"line\n", "archive/data.warc.gz": bytes(range(256))}
    path = tmp_path / "large.zip"
    path.write_bytes(large_package(members))
    r = archives.Reader(str(path))
    assert {n: r.at(*r.place(n)) for n in members} == members


def test_broken_packages(tmp_path):
    for k, data in enumerate([b"", b"no package", b"PK\5\6" + b"\0" * 10]):
        path = tmp_path / f"{k}.zip"
        path.write_bytes(data)
        with pytest.raises(ValueError):
            archives.Reader(str(path))
