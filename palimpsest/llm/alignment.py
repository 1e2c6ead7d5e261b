"""Alignment of two tokenizers over the same bytes, by bitsets of token ends.

Both tokenizers cut the same bytes: A the text with a space before it (byte-level BPE), B the text (SentencePiece, which adds
the space). Packed bitsets mark the ends of A's tokens and of B's, document after document. Their AND marks shared cuts, which part
the tokens into groups; a running popcount (rank) turns a cut into ranges of tokens, the places of set bits are select. Their OR marks links:
between two neighbouring ends lies the one stretch that one A token and one B token have in common, so every set bit
is a pair of tokens that overlap, and its ranks say which.

How often a pair of ids is linked in the corpus takes a shuffle of pairs, not of links. A task cuts its documents into chunks of
about `CHUNK_LINKS` links, writes each chunk's links (as places in the chunk's list of distinct pairs) as a file of the
shared folder, and puts out the list with its counts. Counts are summed by pair, compared with the highest of their
B id, and joined back to the lists: a pair has one row a chunk, however often it occurs. A last step reads each chunk's
file beside its counted list. A chunk that is written again by another attempt has another name, and only the list that
Spark keeps is ever read, so lost executors cost their own chunks.

A document has no tokens if its text is null or empty, or if either tokenizer's bytes differ from space + text (a text that
holds U+2581, say). Null and repeated document ids are rows of their own. An empty table gives no rows. Other columns are left out, whatever
their names. A document is never split: one that is longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_slices, release
from .common import fresh_dir, materialise
from .pieces import piece_encoder
from .tokens import BYTE_LETTERS, encoder

#: Links of a chunk: memory of a task is some tens of bytes for each.
CHUNK_LINKS = 2_000_000


class Bits:
    """A packed bitset with ranks; `places` are the set positions in ascending order."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits below each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@lru_cache(maxsize=1)
def byte_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {letter: byte for byte, letter in BYTE_LETTERS.items()}
    known = {i: bytes(map(back.__getitem__, piece)) for piece, i in spec["model"]["vocab"].items() if all(c in back for c in piece)}
    known |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
    return [known.get(i, b"") for i in range(max(known) + 1)]


def _spelled(ids: list[np.ndarray], vocabulary: np.ndarray, sizes: np.ndarray, want: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each text's ids spell its bytes; `vocabulary` has all ids' bytes in a row, `want` all texts'."""
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    of = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    own = np.bincount(of, weights=sizes[flat], minlength=len(ids)).astype(np.int64)
    same = own == lengths
    flat = flat[same[of]]
    size = sizes[flat]
    starts = np.cumsum(sizes) - sizes
    # The place of every byte: where its id's bytes begin, and how far into them it is.
    at = np.repeat(starts[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    where = np.repeat(np.flatnonzero(same), lengths[same])
    wrong = vocabulary[at] != want[np.repeat(same, lengths)]
    same[where[wrong]] = False
    return same


class Aligner:
    """Aligns lists of texts. `a` and `b` are the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        self.a_coder, self.b_coder = encoder(a_path), piece_encoder(b_path)
        self.a, self.b = byte_vocabulary(a_path), self.b_coder.piece_bytes()
        self.a_size, self.b_size = np.array([*map(len, self.a)]), np.array([*map(len, self.b)])
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a, self.b))
        # An id in its place in a group: with what follows it.
        self.shown = [f"{i}{end}".encode() for i in range(len(self.a)) for end in ",|"] + [f"{i}{end}".encode() for i in range(len(self.b)) for end in ",;"]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none where either's bytes differ from space + text."""
        a = [np.frombuffer(self.a_coder.encode_ranked(" " + t) if t else b"", "<u4") for t in texts]
        b = [x[:, 0] for x in self.b_coder.encode_all([t or "" for t in texts])]
        none, want = np.zeros(0, np.int64), [b" " + t.encode() if t else b"" for t in texts]
        joined = np.frombuffer(b"".join(want), np.uint8)
        same = np.ones(len(texts), bool)
        for ids, vocabulary, sizes in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            same &= _spelled(ids, vocabulary, sizes, joined, np.array([*map(len, want)], np.int64))
        return tuple([x.astype(np.int64) if ok else none for x, ok in zip(ids, same.tolist(), strict=True)] for ids in (a, b))

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """n_a, n_b, n_groups and n_links of each text; group_ids (ids of each group, see `groups_text`); pairs: a * (number of B ids) + b for each link."""
        found = self.tokens(texts)
        a, b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in found)
        n_a, n_b = (np.array([*map(len, ids)], np.int64) for ids in found)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        total = int(a_ends[-1]) + 1 if len(a_ends) else 1
        a_bits, b_bits = Bits.of(a_ends, total), Bits.of(b_ends, total)
        cuts, ends = Bits(a_bits.words & b_bits.words), Bits(a_bits.words | b_bits.words)
        doc_end = np.concatenate([[0], a_ends])[np.cumsum(n_a)] + 1
        n_groups, n_links = (np.diff(bits.rank(doc_end), prepend=0) for bits in (cuts, ends))
        at = ends.places()
        pairs = a[a_bits.rank(at)] * len(self.b) + b[b_bits.rank(at)] if len(at) else np.zeros(0, np.int64)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "pairs": pairs, "groups_text": self._groups(a, b, n_a + n_b, cuts, a_bits, b_bits)}

    def _groups(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, cuts: Bits, a_bits: Bits, b_bits: Bits) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text: A ids of a group, then its B ids, in order."""
        at = cuts.places() + 1
        a_upto, b_upto = a_bits.rank(at), b_bits.rank(at)
        a_n, b_n = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_upto - 1], last_b[b_upto - 1] = 1, 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(b_upto - b_n, a_n)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(a_upto, b_n)] = 2 * len(self.a) + 2 * b + last_b
        codes, shown = order.tolist(), self.shown.__getitem__
        return [b"".join(map(shown, codes[begin:end]))[:-1] for begin, end in pairwise(np.concatenate([[0], np.cumsum(sizes)]).tolist())]


_DOC = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())])
_LISTED = pa.schema([("chunk", pa.string()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def link_chunks(docs: DataFrame, a_path: str, b_path: str, chunk_links: int = CHUNK_LINKS) -> tuple[DataFrame, str]:
    """Align every whole text. Returns the lists (chunk, place, pair, n: links of the chunk that hold the pair) and the folder of
    the chunks' files. Every chunk has one more row, without a pair, so that documents without links are met too."""
    folder = fresh_dir(docs.sparkSession, "link-chunks")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        aligner = Aligner(a_path, b_path)
        held: list[tuple] = []
        links: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, links
            where, distinct = pd.factorize(np.concatenate(links))
            counts = np.bincount(where, minlength=len(distinct))
            del links[:]
            name = uuid.uuid4().hex
            width = "<u2" if len(distinct) <= 1 << 16 else "<u4"
            parts = np.split(where.astype(width), np.cumsum([h[4] for h in held])[:-1])
            rows = [pa.array(c, f.type) for c, f in zip([*zip(*held, strict=True), [p.tobytes() for p in parts]], _DOC, strict=True)]
            pq.write_table(pa.Table.from_arrays(rows, schema=_DOC), f"{base}/{name}.parquet", filesystem=store, compression="zstd", use_dictionary=False)
            del held[:]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64())], schema=_LISTED)
            for i in range(0, len(distinct), 50_000):
                own = distinct[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(np.arange(i, i + len(own)), pa.int32()), pa.array(own), pa.array(counts[i : i + len(own)])], schema=_LISTED)

        size = 0
        for batch in batches:
            got = aligner.align(batch["text"].to_pylist())
            shas = [hashlib.sha256(t).hexdigest() if t else "" for t in got["groups_text"]]
            held += zip(batch["doc_id"].to_pylist(), *(got[k].tolist() for k in ("n_a", "n_b", "n_groups", "n_links")), shas, strict=True)
            links.append(got["pairs"])
            size += len(got["pairs"])
            if size >= chunk_links:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    rows = docs.select("doc_id", "text").mapInArrow(in_slices(step, "text"), "chunk string, place int, pair long, n long")
    return materialise(rows, "link-lists"), folder


def link_counts(lists: DataFrame, n_b: int) -> DataFrame:
    """pair, count (links of the corpus that hold it), best (whether no pair of the same B id has more). `n_b`: number of B ids, so at most as
    many rows are the highest counts."""
    counts = materialise(lists.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("count")), "link-counts")
    b = F.col("pair") % n_b
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is their B id's highest), count_sum (of its links) and groups_sha256."""
    lists, folder = link_chunks(docs, a_path, b_path, chunk_links)
    counted = lists.join(link_counts(lists, len(piece_encoder(b_path).texts)), "pair", "left").select("chunk", "place", "count", "best")

    def read(key: tuple, table: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        place = table["place"].to_numpy()
        counts, best = np.zeros(max(1, len(place) - 1), np.int64), np.zeros(max(1, len(place) - 1), np.int64)
        pairs = place >= 0
        counts[place[pairs]] = table["count"].filter(pa.array(pairs)).to_numpy()
        best[place[pairs]] = table["best"].filter(pa.array(pairs)).to_numpy(zero_copy_only=False)
        width = "<u2" if len(place) - 1 <= 1 << 16 else "<u4"
        out = pq.read_table(f"{base}/{key[0].as_py()}.parquet", filesystem=store)
        links = [np.frombuffer(x, width) for x in out["links"].to_pylist()]
        sums = [[int(values[x].sum()) for x in links] for values in (best, counts)]
        release()
        return pa.Table.from_arrays([*(out[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *(pa.array(x, pa.int64()) for x in sums), out["groups_sha256"]], names=[f.split()[0] for f in _RESULT.split(", ")])

    return counted.groupBy("chunk").applyInArrow(read, _RESULT)
