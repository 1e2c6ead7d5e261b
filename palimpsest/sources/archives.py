"""ZIP archives as a source and a sink.

An archive's directory is at its end. A task finds it by reading the last bytes, then reads the directory in pieces, and no entry; entries
are rows with their places. What the directory says decides whether the archive is refused (`archive_refusals`) before
anything is inflated. Entries are then dealt out in spans and inflated where they land, each from its own place in the file, so a
large archive is the work of many tasks. Sizes and checksums in the directory are held against what comes out: an entry that
inflates to more than it says is stopped there.

`read_archives` gives the rows that `scan_tree` gives for folders. `spark.read.format("zip")` is the same reader as a data source, for single archives.
"""

from __future__ import annotations

import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import fresh_dir, stored
from . import MAX_BYTES, MAX_ENTRIES, MAX_FILE, archive_refusals

#: Bytes of entries, packed, that a span holds on average; bytes that are read or inflated at once.
SPAN_BYTES, PIECE = 8 << 20, 1 << 20
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
UNIX, UTF8_FLAG, ENCRYPTED_FLAG, STORED, DEFLATED = 3, 0x800, 1, 0, 8
ENTRY_SCHEMA = "archive string, n long, path string, mode int, packed long, expanded long, size long, method int, crc long, flags int, place long, problem string"
_ENTRIES = pa.schema([("archive", pa.string()), ("n", pa.int64()), ("path", pa.string()), ("mode", pa.int32()), ("packed", pa.int64()), ("expanded", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("flags", pa.int32()), ("place", pa.int64()), ("problem", pa.string())])
_FILES = pa.schema([("root", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("data", pa.binary()), ("problem", pa.string())])


class BadArchive(ValueError):
    """What is wrong with an archive or an entry, in a word or two."""


def _open(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return store.open_input_file(inner)


def _at(file: pa.NativeFile, place: int, size: int) -> bytes:
    if place < 0 or size < 0 or place + size > file.size():
        raise BadArchive("truncated")
    return file.read_at(size, place)


def find_directory(file: pa.NativeFile) -> tuple[int, int, int]:
    """Entries, place and size of the directory, from the record at the end of the file."""
    whole = file.size()
    tail = _at(file, max(0, whole - 65_557), min(whole, 65_557))
    at = tail.rfind(_END)
    if at < 0 or at + 22 > len(tail):
        raise BadArchive("no directory")
    entries, size, place = struct.unpack_from("<HII", tail, at + 10)
    end = whole - len(tail) + at
    if entries == 0xFFFF or 0xFFFFFFFF in (size, place):
        locator = _at(file, end - 20, 20)
        if locator[:4] == _LOCATOR64:
            end = struct.unpack_from("<Q", locator, 8)[0]
            record = _at(file, end, 56)
            if record[:4] != _END64:
                raise BadArchive("no directory")
            entries, size, place = struct.unpack_from("<QQQ", record, 32)
    if place + size > end:
        raise BadArchive("truncated")
    return entries, place, size


def read_directory(file: pa.NativeFile, most: int) -> Iterator[dict]:
    """The first `most` entries, as the directory has them."""
    entries, place, left = find_directory(file)
    data, at = b"", 0
    for n in range(1, min(entries, most) + 1):
        while len(data) - at < 46 or len(data) - at < 46 + sum(struct.unpack_from("<HHH", data, at + 28)):
            if not left:
                raise BadArchive("truncated")
            data, at = data[at:] + _at(file, place, min(left, PIECE)), 0
            place, left = place + min(left, PIECE), left - min(left, PIECE)
        if data[at : at + 4] != _ENTRY:
            raise BadArchive("directory")
        maker, flags, method, crc, size, expanded, name_size, extra_size, note_size, attributes, local = struct.unpack_from("<5xB2xHH4xIIIHHH4xII", data, at)
        name = data[at + 46 : at + 46 + name_size]
        extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
        at += 46 + name_size + extra_size + note_size
        wide = [expanded, size, local]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{min(length, len(extra) - 4) // 8}Q", extra, 4))
                wide = [next(values, v) if v == 0xFFFFFFFF else v for v in wide]
            extra = extra[4 + length :]
        yield {"n": n, "path": name.decode("utf-8" if flags & UTF8_FLAG else "cp437", "replace"), "mode": attributes >> 16 if maker == UNIX else None, "expanded": wide[0], "size": wide[1], "method": method, "crc": crc, "flags": flags, "place": wide[2]}


def inflate(file: pa.NativeFile, entry: dict) -> bytes:
    """An entry's bytes; BadArchive where they aren't what the directory says."""
    if entry["flags"] & ENCRYPTED_FLAG:
        raise BadArchive("encrypted")
    if entry["method"] not in (STORED, DEFLATED):
        raise BadArchive("method")
    head = _at(file, entry["place"], 30)
    if head[:4] != _LOCAL:
        raise BadArchive("local header")
    place, left = entry["place"] + 30 + sum(struct.unpack_from("<HH", head, 26)), entry["size"]
    unpack, out, have = zlib.decompressobj(-15), [], 0
    while left or entry["method"] == DEFLATED and not unpack.eof and unpack.unconsumed_tail:
        piece = unpack.unconsumed_tail
        if not piece:
            piece = _at(file, place, min(left, PIECE))
            place, left = place + len(piece), left - len(piece)
        try:
            new = piece if entry["method"] == STORED else unpack.decompress(piece, PIECE)
        except zlib.error:
            raise BadArchive("data") from None
        have += len(new)
        if have > entry["expanded"]:
            raise BadArchive("larger than it says")
        out.append(new)
    data = b"".join([*out, unpack.flush()] if entry["method"] == DEFLATED else out)
    if len(data) != entry["expanded"] or zlib.crc32(data) != entry["crc"]:
        raise BadArchive("checksum" if len(data) == entry["expanded"] else "size")
    return data


def archive_entries(archives: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The directory of every archive (a column `archive` of paths), one more entry than the most allowed at the most. An archive whose
    directory can't be read is one row with its problem."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["archive"].to_pylist():
                rows, problem = [], None
                try:
                    with _open(path) as file:
                        whole = file.size()
                        rows = [e | {"archive": path, "packed": whole, "problem": None} for e in read_directory(file, most + 1)]
                except (BadArchive, OSError, struct.error) as e:
                    problem = str(e) if isinstance(e, BadArchive) else type(e).__name__
                if problem:
                    rows = [dict.fromkeys(_ENTRIES.names) | {"archive": path, "n": 0, "problem": problem}]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 5000], schema=_ENTRIES)

    return archives.select("archive").mapInArrow(listed, ENTRY_SCHEMA)


def judge_archives(entries: DataFrame, most_entries: int = MAX_ENTRIES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """archive, entries, refused: why an archive is refused as a whole, or null. An archive has at most one more entry here than is allowed, so its running sum is a bounded window."""
    bad = entries.where(F.col("problem").isNotNull()).select("archive", F.lit(0).cast("long").alias("entries"), F.col("problem").alias("refused"))
    return archive_refusals(entries.where(F.col("problem").isNull()), ["archive"], most_entries, most_bytes).unionByName(bad)


def read_archives(archives: DataFrame, most_file: int = MAX_FILE, most_entries: int = MAX_ENTRIES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """root (the archive), path, bytes, data, problem of every file in the archives that aren't refused.

    Files of more than `most_file` bytes, and empty ones, have null data, as in `scan_tree`; an entry that isn't what the directory says has null data and its problem.
    """
    entries = stored(archive_entries(archives, most_entries), "archive-entries")
    taken = entries.join(judge_archives(entries, most_entries, most_bytes).where("refused IS NULL").select("archive"), "archive", "left_semi").where(~F.col("path").endswith("/"))
    spans = F.ceil(F.col("packed") / SPAN_BYTES)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != path:
                    if file:
                        file.close()
                    path, file = row["archive"], _open(row["archive"])
                data = problem = None
                if 0 < row["expanded"] <= most_file:
                    try:
                        data = inflate(file, row)
                    except (BadArchive, struct.error) as e:
                        problem = str(e)
                yield pa.RecordBatch.from_pydict({"root": [path], "path": [row["path"]], "bytes": [row["expanded"]], "data": [data], "problem": [problem]}, schema=_FILES)
        if file:
            file.close()

    dealt = taken.withColumn("__span", F.pmod(F.xxhash64("n"), spans)).repartition("archive", "__span").sortWithinPartitions("archive", "place").drop("__span")
    return dealt.mapInArrow(opened, "root string, path string, bytes long, data binary, problem string")


def write_archives(files: DataFrame, name: str = "archives") -> DataFrame:
    """Write one ZIP for each value of `archive` (columns archive, path, data) into a new folder that all executors share; gives archive (its path), entries and bytes. A task streams
    each archive's rows into it, under a name of its own, and moves it when it is whole."""
    spark = files.sparkSession
    folder = fresh_dir(spark, name)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        key = stream = made = draft = None
        n = 0

        def close() -> pa.RecordBatch:
            made.close()
            stream.close()
            path = f"{base}/{key}.zip"
            store.move(draft, path)
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{key}.zip"], "entries": [n], "bytes": [store.get_file_info(path).size]}, schema=pa.schema([("archive", pa.string()), ("entries", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for archive, path, data in zip(*(batch[c].to_pylist() for c in ("archive", "path", "data")), strict=True):
                if archive != key:
                    if made:
                        yield close()
                    key, n, draft = archive, 0, f"{base}/{archive}.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(draft)
                    made = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                made.writestr(zipfile.ZipInfo(path, (2000, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_DEFLATED)
                n += 1
        if made:
            yield close()

    dealt = files.select("archive", "path", "data").repartition("archive").sortWithinPartitions("archive", "path")
    return stored(dealt.mapInArrow(pack, "archive string, entries long, bytes long"), "archive-list")


class _Span(InputPartition):
    def __init__(self, entries: list[dict]):
        self.entries = entries


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, most_file: int):
        self.path, self.most_file = path, most_file

    def partitions(self) -> list[InputPartition]:
        """One partition for each span of entries. The directory that the driver reads has at most `MAX_ENTRIES` entries: more are refused."""
        with _open(self.path) as file:
            entries = [e for e in read_directory(file, MAX_ENTRIES + 1)]
        if len(entries) > MAX_ENTRIES:
            raise BadArchive("entries")
        spans, size = [[]], 0
        for entry in sorted((e for e in entries if not e["path"].endswith("/")), key=lambda e: e["place"]):
            if size > SPAN_BYTES:
                spans.append([])
                size = 0
            spans[-1].append(entry)
            size += entry["size"]
        return [_Span(s) for s in spans]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as file:
            for e in partition.entries:
                data = inflate(file, e) if 0 < e["expanded"] <= self.most_file else None
                yield pa.RecordBatch.from_pydict({"root": [self.path], "path": [e["path"]], "bytes": [e["expanded"]], "data": [data]}, schema=pa.schema([f for f in _FILES if f.name != "problem"]))


class ZipSource(DataSource):
    """spark.read.format("zip").load(path): root, path, bytes, data of the files of one archive. Unlike `read_archives` it fails on a bad entry, as a file reader does; option maxfile is the
    greatest size that is inflated."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "root string, path string, bytes long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"], int(self.options.get("maxfile", MAX_FILE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSource)
