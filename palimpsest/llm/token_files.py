"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 128. A block stores its minimum, and every id less that minimum in as many bits as the
90th percentile of them needs; ids that need more bits keep their low bits there and their high bits in the file's
exception lists. The block table gives each block's minimum, bit width, first payload word and first exception, so
that any block is read without those before it. A file holds whole documents: their ids, their lengths and, from a
range partitioning by document id, their order over all files.

File: magic, eight counts, then the arrays of `_LAYOUT` in order, all little-endian.

Null texts are empty, and an empty text still has its end id. Null document ids come first, in one run. Rows with
equal ids are in the order in which they are read; those and null ids may be in several files. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_slices
from .common import fresh_dir, materialise, text_of
from .tokens import encoder

BLOCK = 128
MAGIC = b"PFORIDS1"
#: A file is closed after the document with which it reaches so many ids; a document is never split.
FILE_IDS = 4_000_000
#: Ids that are packed or unpacked at once.
CHUNK_BLOCKS = 4096
PERCENTILE = 0.9
#: Texts of each task that are encoded by the tokenizers library as a whole, too.
HELD_TEXTS = 16
_LAYOUT = (("doc_id", "<i8"), ("doc_null", "u1"), ("doc_len", "<i8"), ("low", "<u4"), ("width", "u1"), ("word_at", "<i8"), ("patch_at", "<i8"), ("patch_pos", "u1"), ("patch_high", "<u4"), ("word", "<u8"))


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2^width as (blocks, 2 * width) words."""
    out = np.zeros((len(rows), 2 * width + 1), dtype=np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 64)
        out[:, at] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, at + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out[:, : 2 * width]


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK) if width else ():
        at, shift = divmod(j * width, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[:, at + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out


def encode_blocks(ids: np.ndarray) -> dict[str, np.ndarray]:
    """The block arrays of `_LAYOUT` for these ids; the last block is filled up with its own first id."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, dtype=np.uint64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK] if n else 0
    out: dict[str, list] = {k: [] for k, _ in _LAYOUT[3:]}
    words = patches = 0
    for at in range(0, n, CHUNK_BLOCKS):
        rows = full[at * BLOCK : (at + CHUNK_BLOCKS) * BLOCK].reshape(-1, BLOCK)
        low = rows.min(axis=1)
        rest = rows - low[:, None]
        ranked = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
        width = _bits(ranked)
        over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
        block, pos = np.nonzero(over)
        out["patch_pos"].append(pos.astype("u1"))
        out["patch_high"].append((rest[block, pos] >> width[block].astype(np.uint64)).astype("<u4"))
        count = over.sum(axis=1)
        out["patch_at"].append(patches + np.cumsum(count) - count)
        starts = words + np.cumsum(2 * width) - 2 * width
        packed = np.zeros(int(2 * width.sum()), dtype="<u8")
        for w in np.unique(width[width > 0]):
            mine = np.nonzero(width == w)[0]
            packed[(starts[mine] - words)[:, None] + np.arange(2 * w)] = _pack(rest[mine] & np.uint64((1 << int(w)) - 1), int(w))
        out["word"].append(packed)
        out["word_at"].append(starts)
        out["low"].append(low.astype("<u4"))
        out["width"].append(width.astype("u1"))
        words, patches = words + len(packed), patches + len(block)
    return {k: np.concatenate([np.zeros(0), *v]).astype(kind) if not v else np.concatenate(v).astype(kind) for (k, kind), v in ((x, out[x[0]]) for x in _LAYOUT[3:])}


def decode_blocks(file: dict[str, np.ndarray], first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last - 1; only these blocks are read."""
    width, starts = file["width"][first:last].astype(np.int64), file["word_at"][first:last]
    out = np.zeros((last - first, BLOCK), dtype=np.uint64)
    for w in np.unique(width[width > 0]):
        mine = np.nonzero(width == w)[0]
        out[mine] = _unpack(file["word"][starts[mine][:, None] + np.arange(2 * w)], int(w))
    ends = np.append(file["patch_at"], len(file["patch_pos"]))
    a, b = ends[first], ends[last]
    block = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
    out[block, file["patch_pos"][a:b]] |= file["patch_high"][a:b].astype(np.uint64) << width[block].astype(np.uint64)
    return (out + file["low"][first:last].astype(np.uint64)[:, None]).astype("<u4").ravel()


def file_bytes(docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    arrays = {"doc_id": np.array([d or 0 for d, _ in docs], "<i8"), "doc_null": np.array([d is None for d, _ in docs], "u1"), "doc_len": np.array([n for _, n in docs], "<i8")} | encode_blocks(ids)
    parts = [MAGIC, np.array([len(ids), *(len(arrays[k]) for k, _ in _LAYOUT)], "<i8").tobytes(), *(arrays[k].tobytes() for k, _ in _LAYOUT)]
    return b"".join(parts)


def read_file(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a file, as views on its bytes; n_ids is their number."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    counts = np.frombuffer(data, "<i8", 1 + len(_LAYOUT), 8)
    out, at = {"n_ids": counts[0]}, 8 + counts.nbytes
    for (name, kind), n in zip(_LAYOUT, counts[1:], strict=True):
        out[name] = np.frombuffer(data, kind, int(n), at)
        at += out[name].nbytes
    return out


def documents_of(file: dict[str, np.ndarray]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, first id's place in the file, ids) for each document, decoding a bounded run of blocks at a time."""
    have, left = 0, np.zeros(0, "<u4")
    at, block = 0, 0
    n_blocks = len(file["low"])
    for doc, null, n in zip(file["doc_id"], file["doc_null"], file["doc_len"], strict=True):
        parts = [left]
        while have < n and block < n_blocks:
            upto = min(n_blocks, block + CHUNK_BLOCKS)
            parts.append(decode_blocks(file, block, upto))
            have, block = have + len(parts[-1]), upto
        left = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield None if null else int(doc), at, left[:n]
        left, have, at = left[n:], have - int(n), at + int(n)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Encode every text, append end_id (None: nothing) and write files in ascending order of doc_id.

    Texts are dealt out by ranges of doc_id once; each task encodes and writes its range. Texts of Latin letters go through the tokenizer's merges as ranks
    (`encode_ranked`), others through the tokenizers library; each task holds its first `HELD_TEXTS` texts against the library's own encoding. A file is written under a
    name of its own and then moved, so that a task that runs again replaces it by the same bytes. Returns the
    manifest (part, file, path, n_docs, n_ids, start: ids in files of the same part before it) and the folder.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "token-files")
    rows = docs.select("doc_id", text_of().alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, coder, made, start = TaskContext.get().partitionId(), encoder(tokenizer_path), 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, int]] = []
        data: list[bytes] = []
        size = told = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, start, held, data, size
            ids = np.frombuffer(b"".join(data), "<u4")
            path = f"{base}/part-{part:06d}-{made:06d}.pfor"
            draft = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(held, ids))
            store.move(draft, path)
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [made], "path": [path], "n_docs": [len(held)], "n_ids": [len(ids)], "start": [start]}, schema=_MANIFEST)
            made, start, held, data, size = made + 1, start + len(ids), [], [], 0
            return row

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = coder.encode_ranked(text)
                if told < HELD_TEXTS and own != coder.whole(text):
                    raise ValueError(f"ranks and library differ on document {doc}")
                told += 1
                ids = own + end
                held.append((doc, len(ids) // 4))
                data.append(ids)
                size += len(ids) // 4
                if size >= file_ids:
                    yield flush()
        if held:
            yield flush()

    # Ranges end inside runs of null or equal ids, too.
    order = ["doc_id", "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = ranged.mapInArrow(in_slices(write, "text"), "part int, file int, path string, n_docs long, n_ids long, start long")
    return materialise(manifest, "token-manifest"), folder


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("start", pa.int64())])
_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for.

    Places within a part are in the files; the sums of the parts before, one number a part, are joined.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(row["path"]) as f:
                    file = read_file(f.read())
                out: dict[str, list] = {k: [] for k in _READ.names}
                size = 0
                for doc, at, ids in documents_of(file):
                    for k, v in (("part", row["part"]), ("doc_id", doc), ("in_part", row["start"] + at), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.tobytes())), ("ids", ids.astype("i4") if with_ids else None)):
                        out[k].append(v)
                    size += len(ids)
                    if with_ids and size > 1_000_000:
                        yield pa.RecordBatch.from_pydict(out, schema=_READ)
                        out, size = {k: [] for k in _READ.names}, 0
                yield pa.RecordBatch.from_pydict(out, schema=_READ)

    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = {r["part"]: r["n"] for r in parts.collect()}  # one number for each task that wrote
    total, bases = 0, []
    for part in sorted(before):
        bases.append((part, total))
        total += before[part]
    base = manifest.sparkSession.createDataFrame(bases, "part int, base long")
    docs = manifest.select("part", "file", "path", "start").mapInArrow(in_slices(read, "path"), "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long, ids array<int>")
    kept = ["ids"] if with_ids else []
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *kept)
