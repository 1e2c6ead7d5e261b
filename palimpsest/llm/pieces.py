"""SentencePiece encoding that keeps offsets, and decoding.

A model file holds pieces and a normaliser: a compiled character map (a double-array trie from byte prefixes to their
replacements) and flags for spaces. `Normaliser` takes, from the left, the longest prefix that the map knows, or one character, and
records for every byte that it writes where in the original the prefix began. The library then merges normalised text, through a
copy of the model whose normaliser does nothing, and each piece's end in the normalised bytes is projected through that record to
an end in the original bytes. Spans follow each other without gaps; of pieces that share one original character (byte pieces,
or a character whose replacement is cut) the last one has its bytes and the others are empty, as in the library.

Merges never cross the place between a character and a space after it if no piece of the model does. `PieceEncoder` checks
that, and that the map leaves plain spaces alone, and then merges each distinct word once; a line feed that is in no
piece of several characters and in no entry of the map cuts words as well. Models for which it doesn't hold, and texts that hold
the mark of a space themselves, are encoded whole.

Null texts are empty: their ids are the begin and end ids alone. Null and repeated document ids are rows of their own. An
empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import in_slices
from .common import text_of
from .tokens import WordCache

SPACE = "▁"  # what stands for a space in pieces
WORDS, WORDS_OF_LINES = re.compile(r" *[^ ]+| +"), re.compile(r"\n| *[^ \n]+| +")
#: Fields of the model file's messages.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALISER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE, TYPE_BYTE, TRAINER_SUFFIX = 1, 3, 6, 24
NORM_MAP, NORM_PREFIX, NORM_TRIM, NORM_ESCAPE = 2, 3, 4, 5
ANSWER_PIECES, ANSWER_END = 2, 5


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Field number, value and whole encoding of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        began = at
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[began:at]


class CharacterMap:
    """The compiled map: a four-byte size, the trie's units, then replacements that end in a zero byte.

    A unit's low byte is its label, bit 8 says that a value hangs on it, the bits from 10 on (from 18 on, scaled, if bit 9 is set) are
    the offset of its children; a value is the place of a replacement."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little") if data else 0
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64).tolist()
        self.texts = data[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of text from `at` on that has a replacement, and the replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._below(0, units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node = self._below(node, unit)
            if unit >> 8 & 1:
                place = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[place : self.texts.index(0, place)]
        return found

    @staticmethod
    def _below(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 512) >> 6)

    def entries(self) -> Iterator[bytes]:
        """Every prefix that has a replacement."""
        units, labels = np.array(self.units, np.int64), np.arange(256)
        open_ = [(b"", self._below(0, self.units[0]))] if self.units else []
        while open_:
            prefix, node = open_.pop()
            near = node ^ labels
            near = np.where(near < len(units), near, 0)
            for label in np.flatnonzero((units[near] & 0x800000FF == labels) & (near != 0) & (labels != 0)).tolist():
                unit, key = self.units[node ^ label], prefix + bytes([label])
                if unit >> 8 & 1:
                    yield key
                open_.append((key, self._below(node ^ label, unit)))


class Normaliser:
    """normalise(text) -> normalised bytes, and for each of them and for their end the place in the original bytes."""

    def __init__(self, spec: bytes, suffix: bool = False):
        told = {number: value for number, value, _ in fields(spec)}
        self.map = CharacterMap(told.get(NORM_MAP, b""))
        self.prefix, self.trim, escape = (bool(told.get(k, 1)) for k in (NORM_PREFIX, NORM_TRIM, NORM_ESCAPE))
        self.suffix, self.space = suffix, SPACE.encode() if escape else b" "

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(text, at)
        if found:
            return found
        first = text[at]
        size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, text[at : at + size]

    def normalise(self, text: bytes, prefix: bool = True) -> tuple[bytes, list[int]]:
        """prefix: whether a space is put before (or, for models that say so, behind) the text where the model wants one."""
        out, places, at = bytearray(), [], 0
        while self.trim and at < len(text):  # what normalises to spaces, at the beginning
            size, new = self._step(text, at)
            if new.strip(b" "):
                break
            at += size
        if at == len(text):
            return b"", [at]

        def put(new: bytes, place: int) -> None:
            out.extend(new)
            places.extend([place] * len(new))

        if prefix and self.prefix and not self.suffix:
            put(self.space, at)
        after_space = self.trim
        while at < len(text):
            size, new = self._step(text, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", self.space), at)
                after_space = self.trim and new.endswith(b" ")
            at += size
        while self.trim and out.endswith(self.space):
            at = places[len(out) - len(self.space)]
            del out[-len(self.space) :], places[-len(self.space) :]
        if prefix and self.prefix and self.suffix:
            put(self.space, at)
        return bytes(out), [*places, at]


class PieceEncoder:
    """encode(text) -> an array of rows (id, bytes of the original text that the piece stands for); its ids are the library's."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        parts = list(fields(model))
        trainer = next((dict((k, v) for k, v, _ in fields(v)) for n, v, _ in parts if n == MODEL_TRAINER), {})
        spec = next((v for n, v, _ in parts if n == MODEL_NORMALISER), b"")
        self.normaliser = Normaliser(spec, bool(trainer.get(TRAINER_SUFFIX, 0)))
        self.library = SentencePieceProcessor(model_proto=model)
        still = bytes([NORM_PREFIX << 3, 0, NORM_TRIM << 3, 0, NORM_ESCAPE << 3, 0])
        bare = b"".join(whole for n, _, whole in parts if n != MODEL_NORMALISER) + bytes([MODEL_NORMALISER << 3 | 2, len(still)]) + still
        self.merger = SentencePieceProcessor(model_proto=bare)
        pieces = [{k: v for k, v, _ in fields(v)} for n, v, _ in parts if n == MODEL_PIECES]
        self.is_byte = np.array([p.get(PIECE_TYPE, 1) == TYPE_BYTE for p in pieces])
        self.texts = [p[PIECE_TEXT].decode() for p in pieces]
        self.sizes = np.where(self.is_byte, 1, [len(p[PIECE_TEXT]) for p in pieces]).tolist()
        self.unknown = self.library.unk_id()
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        known = list(self.normaliser.map.entries())
        free = not self.normaliser.trim and not self.normaliser.suffix and self.normaliser.space == SPACE.encode()
        spaced = any(b" " in k + (new := self.normaliser.map.longest(k, 0)[1]) or SPACE.encode() in k + new for k in known)
        leads = free and self.normaliser.prefix and not spaced
        self.by_words = leads and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.texts)
        by_lines = not any(b"\n" in k for k in known) and not any("\n" in t for t in self.texts if len(t) > 1)
        self.cut = WORDS_OF_LINES if by_lines else WORDS
        #: Words that the map leaves as they are: those of ASCII alone, or all.
        self.plain_ascii, self.plain = not any(k.isascii() for k in known), not known
        self.plain_sizes = np.where(self.is_byte, 1, [len(t.replace(SPACE, " ").encode()) for t in self.texts]).astype(np.uint32)
        # Of a character spelled in bytes, the last one has its bytes: by the first byte, how many follow.
        first = np.array([int(t[3:5], 16) if b else 0 for t, b in zip(self.texts, self.is_byte, strict=True)])
        self.following = np.select([first >= 0xF0, first >= 0xE0, first >= 0xC0], [3, 2, 1], 0)
        self.words = WordCache(lambda w: self.merge(w, False))

    def piece_bytes(self) -> list[bytes]:
        """The bytes that each id stands for: a byte piece's byte, others' text with spaces for their marks."""
        return [bytes([int(t[3:5], 16)]) if b else t.replace(SPACE, " ").encode() for t, b in zip(self.texts, self.is_byte, strict=True)]

    def merge(self, text: str, prefix: bool) -> bytes:
        """Rows of a text, or of one of its words."""
        normal, places = self.normaliser.normalise(text.encode(), prefix)
        shown = normal.decode()
        ids = self.merger.encode(shown)
        if self.unknown in ids:  # a run of unknown characters is one piece
            answer = self.merger.encode(shown, return_type="serialized_proto")
            ends = [dict((k, v) for k, v, _ in fields(piece)).get(ANSWER_END, 0) for n, piece, _ in fields(answer) if n == ANSWER_PIECES]
        else:
            ends = np.cumsum([self.sizes[i] for i in ids])
        at = np.asarray(places)[np.concatenate([[0], ends]).astype(int)]
        return np.stack([np.asarray(ids, "<u4"), np.diff(at).astype("<u4")], axis=1).tobytes()

    def _merge_all(self, words: list[str]) -> list[bytes]:
        """Rows of words, the plain ones in one call."""
        plain = [w for w in words if self.plain or self.plain_ascii and w.isascii()]
        ids = self.merger.encode([w.replace(" ", SPACE) for w in plain]) if plain else []
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        sizes = self.plain_sizes[flat]
        for n in (1, 2, 3):
            lead = np.flatnonzero(self.following[flat] == n)
            for i in range(n):
                sizes[lead + i] = 0
            sizes[lead + n] = n + 1
        data = np.stack([flat, sizes], axis=1).astype("<u4").tobytes()
        upto = [0, *accumulate(8 * len(x) for x in ids)]
        found = {w: data[upto[i] : upto[i + 1]] for i, w in enumerate(plain)}
        if (flat == self.unknown).any():  # a run of unknown characters is one piece
            found = {w: x for w, x, own in zip(found, found.values(), ids, strict=True) if self.unknown not in own}
        return [found[w] if w in found else self.merge(w, False) for w in words]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """`encode` of each text; words that are new are merged together."""
        # The space that the model puts before a text makes its first word like the others; its byte is taken off again.
        cut = [self.cut.findall(" " + t) if t and self.by_words and SPACE not in t else None for t in texts]
        self.words.fill({w for c in cut if c for w in c}, self._merge_all)
        out = []
        for text, words in zip(texts, cut, strict=True):
            data = b"".join(map(self.words.__getitem__, words)) if words else self.merge(text, True) if text else b""
            rows = np.frombuffer(bytearray(data), "<u4").reshape(-1, 2)
            if words:
                rows[0, 1] -= 1
            out.append(rows)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def lead(self, text: str) -> int:
        """Bytes of the original before the first piece: only models that drop spaces have any."""
        return self.normaliser.normalise(text.encode())[1][0] if self.normaliser.trim else 0


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a process, with its cached words."""
    return PieceEncoder(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("decoded", pa.string())])


def encode_pieces(docs: DataFrame, model_path: str, ends_too: bool = True) -> DataFrame:
    """doc_id, ids (with the begin and end ids), ends and decoded of every whole text.

    ids and ends are little-endian unsigned 32-bit numbers. A piece's span in the text's UTF-8 bytes is from the
    end of the one before it to its own end; the begin id ends where the first piece's span begins. decoded is what
    the library makes of the ids. ends_too=False leaves `ends` null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(model_path)
        for batch in batches:
            ids, ends = [], []
            texts = batch["text"].to_pylist()
            for text, rows in zip(texts, coder.encode_all(texts), strict=True):
                ids.append(np.concatenate([[coder.begin], rows[:, 0], [coder.end]]).astype("<u4"))
                if ends_too:
                    lead = coder.lead(text)
                    upto = np.concatenate([[lead], lead + np.cumsum(rows[:, 1], dtype=np.int64)])
                    ends.append(np.append(upto, upto[-1]).astype("<u4").tobytes())
            decoded = [coder.library.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(ends if ends_too else [None] * len(ids), pa.binary()), pa.array(decoded, pa.string())], schema=_ENCODED)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(in_slices(encode, "text"), "doc_id long, ids binary, ends binary, decoded string")
