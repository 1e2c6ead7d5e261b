"""Archives written by the standard library, sound and bad ones, read entry by entry."""

import io
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import archives as A
from palimpsest.sources import collect_files


def zipped(files, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name) if isinstance(name, str) else name, data, how.get("method", zipfile.ZIP_DEFLATED))
    return out.getvalue()


def link(name):
    info = zipfile.ZipInfo(name)
    info.create_system, info.external_attr = 3, 0o120777 << 16
    return info


def patched(data, entry, offset, value):
    """The directory's record of the n-th entry, with other bytes at an offset."""
    at = -1
    for _ in range(entry + 1):
        at = data.index(b"PK\x01\x02", at + 1)
    return data[: at + offset] + value + data[at + offset + len(value) :]


def wide(name, data):
    """An archive whose sizes, places and counts are all in the 64-bit records."""
    full = 0xFFFFFFFF
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 33, zlib.crc32(data), full, full, len(name), 0) + name.encode() + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 3 << 8 | 45, 45, 0, 0, 0, 33, zlib.crc32(data), full, full, len(name), len(extra), 0, 0, 0, 0o100644 << 16, full) + name.encode() + extra
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    where = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    return local + entry + end + where + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)


FILES = {f"src/m{i}/f{i}.py": f"print({i})\n".encode() * (i + 1) for i in range(40)} | {"src/empty.py": b"", "src/": b"", "big.txt": b"x" * (A.MAX_FILE + 1), "ünï/é.md": b"# text\n" * 9, ".github/ci.yml": b"on: push\n"}
SOUND = zipped(FILES)
BAD = {
    "cut": (SOUND[:-30], "no directory"), "front": (SOUND[500:], "truncated"), "text": (b"hello", "no directory"), "nothing": (b"", "no directory"), "climbs": (zipped({"a": b"1", "x/../../b": b"2"}), "path"), "root": (zipped({"/etc/passwd": b"2"}), "path"),
    "drive": (zipped({"C:\\x": b"2"}), "path"), "linked": (zipped({"a": b"1", link("b"): b"/etc/passwd"}), "symlink"), "bomb": (zipped({f"f{i}": bytes(30_000_000) for i in range(2)}), "bomb"), "many": (zipped({f"f{i}": b"x" for i in range(61)}), "entries"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("zips")
    (base / "sound.zip").write_bytes(SOUND)
    (base / "wide.zip").write_bytes(wide("a/wide.txt", b"sixty-four bits"))
    (base / "noted.zip").write_bytes(zipped({"n.txt": b"note"})[:-2] + struct.pack("<H", 5) + b"PK\x05x!")
    for name, (data, _) in BAD.items():
        (base / f"{name}.zip").write_bytes(data)
    return base


def listing(spark, folder, *names):
    return spark.createDataFrame([(os.path.join(folder, f"{n}.zip"),) for n in names], "archive string").repartition(3)


def test_directory_and_guards(spark, folder):
    entries = A.archive_entries(listing(spark, folder, "sound", "wide", "noted", *BAD), 60)
    got = {os.path.basename(r.archive)[:-4]: (r.entries, r.refused) for r in A.judge_archives(entries, 60).collect()}
    assert {n: r[1] for n, r in got.items()} == {"sound": None, "wide": None, "noted": None} | {n: why for n, (_, why) in BAD.items()}
    assert got["sound"][0] == len(FILES) and got["many"][0] == 61  # one more than the most is read, and no more
    with zipfile.ZipFile(io.BytesIO(SOUND)) as z:
        want = {(i.filename, i.file_size, i.compress_size, i.CRC, i.header_offset) for i in z.infolist()}
    rows = entries.where(F.col("archive").endswith("sound.zip")).collect()
    assert {(r.path, r.expanded, r["size"], r.crc, r.place) for r in rows} == want


def test_files(spark, folder, monkeypatch):
    monkeypatch.setattr(A, "SPAN_BYTES", 500)
    read = A.read_archives(listing(spark, folder, "sound", "wide", "climbs", "cut"))
    got = {(os.path.basename(r.root), r.path): (r.bytes, r.data and bytes(r.data), r.problem) for r in read.collect()}
    want = {("sound.zip", n): (len(d), d if 0 < len(d) <= A.MAX_FILE else None, None) for n, d in FILES.items() if not n.endswith("/")}
    assert got == want | {("wide.zip", "a/wide.txt"): (15, b"sixty-four bits", None)}
    kept = collect_files(read)
    assert "src/m3/f3.py" in {r.path for r in kept.select("path").collect()}
    assert A.read_archives(listing(spark, folder, "sound").limit(0)).count() == 0


def test_bad_entries(spark, tmp_path):
    """Entries that aren't what the directory says have no data and a problem; those beside them are read."""
    plain = zipped({"a": b"abc" * 99, "b": b"xyz" * 50})
    stored_ = zipped({"a": b"abc" * 99, "b": b"xyz" * 50}, method=zipfile.ZIP_STORED)
    cases = {
        "crc": (patched(plain, 0, 16, b"\x01\x02\x03\x04"), "checksum"), "small": (patched(plain, 0, 24, struct.pack("<I", 10)), "larger than it says"), "large": (patched(plain, 0, 24, struct.pack("<I", 4000)), "size"), "secret": (patched(plain, 0, 8, b"\x01\x00"), "encrypted"),
        "method": (patched(plain, 0, 10, b"\x0c\x00"), "method"), "place": (patched(plain, 0, 42, struct.pack("<I", 7)), "local header"), "far": (patched(plain, 0, 42, struct.pack("<I", 10**6)), "truncated"), "flat": (patched(stored_, 0, 20, struct.pack("<I", 200)), "size"),
        "noise": (plain.replace(plain[31:40], b"\xff" * 9, 1), "data"),
    }
    for name, (data, _) in cases.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    got = {(os.path.basename(r.root)[:-4], r.path): (r.data and bytes(r.data), r.problem) for r in A.read_archives(listing(spark, tmp_path, *cases)).collect()}
    assert got == {(n, "a"): (None, why) for n, (_, why) in cases.items()} | {(n, "b"): (b"xyz" * 50, None) for n in cases}


def test_data_source(spark, folder, monkeypatch):
    A.register(spark)
    df = spark.read.format("zip").load(str(folder / "sound.zip"))
    assert {r.path: r.data and bytes(r.data) for r in df.collect()} == {n: d if 0 < len(d) <= A.MAX_FILE else None for n, d in FILES.items() if not n.endswith("/")}
    monkeypatch.setattr(A, "SPAN_BYTES", 100)
    assert len(A._ZipReader(str(folder / "sound.zip"), 10).partitions()) > 5
    with pytest.raises(Exception, match="no directory"):
        spark.read.format("zip").load(str(folder / "cut.zip")).collect()


def test_round_trip(spark):
    rows = [(f"a{i % 4}", f"d/f{i}.txt", None if i == 3 else f"text {i} ".encode() * (i % 50)) for i in range(300)]
    files = spark.createDataFrame(rows, "archive string, path string, data binary").repartition(7)
    made = A.write_archives(files)
    assert {r.entries for r in made.collect()} == {75}
    got = {r.path: (r.bytes, bytes(r.data or b"")) for r in A.read_archives(made).collect()}
    assert got == {p: (len(d or b""), d or b"") for _, p, d in rows}
