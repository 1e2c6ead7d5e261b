"""Token ids of whole texts, from public tokenizer files, with a cache by word.

A byte-pair tokenizer never merges across the borders of its pre-tokens, so the ids of a text are the ids of its
words in a row. `TextEncoder` cuts a text only at places where such a border is certain, asks the tokenizers library
for each distinct word once, and keeps the answers in two bounded generations. Texts with characters for which a
border is not certain are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

#: Cached words per generation; two generations are kept by a cache, about 60 MB at most.
CACHE_WORDS = 150_000
#: Words of so many characters are not kept.
LONG_WORD = 64
#: Characters that Python's str.split takes for white space and the tokenizers' patterns don't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: A space before more white space: the words around it are not independent.
SPACE_RUN = re.compile(r" \s")
#: Marks behind a word that are pre-tokens of their own.
TAILS = (".", ",", "|")
#: Characters, and lengths of words, for which ranks are not used.
UNSURE = re.compile("[^\t\n\r -~\xa0-\u024f]|[^\t\n\r ]{1000}")
#: Fixed value: the pre-tokens of byte-level vocabularies.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = re.compile(r"\s*\S+|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others, in order, for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class WordCache(dict):
    """Word -> its bytes (ids as little-endian unsigned 32-bit numbers); `make` answers for words seen for the first time."""

    def __init__(self, make, size: int | None = None):
        super().__init__()
        self.make, self.size, self.old, self.long = make, size or CACHE_WORDS, {}, []

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(word) < LONG_WORD and ("\n" not in word or word == "\n"):  # words on both sides of a line feed seldom meet again
            self[word] = ids
        return ids

    def rest(self) -> None:
        """Keep one generation while nothing is asked: a worker lives on between stages."""
        self.old = {}

    def fill(self, words: set[str], make_all: Callable[[list[str]], Iterable[bytes]]) -> None:
        """Have the answers for all these words, with one call for those that aren't known. They stay until the next call, long ones no longer."""
        for word in self.long:
            self.pop(word, None)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        absent = [w for w in words if w not in self]
        self.update((w, self.old[w]) for w in absent if w in self.old)
        unseen = [w for w in absent if w not in self.old]
        if unseen:
            self.update(zip(unseen, make_all(unseen), strict=True))
        self.long = [w for w in unseen if len(w) >= LONG_WORD]


class TextEncoder:
    """encode(text) -> bytes of unsigned 32-bit ids, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = before.get("pretokenizers", [before])
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not norm and not before.get("add_prefix_space"):
            self.encode = self._spaced_text
        elif steps[0].get("type") == "Split" and steps[0].get("invert") and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.encode = self._worded_text
        else:
            self.encode = self.whole
        self.ranked = self._ranks(spec) if self.encode == self._spaced_text else None
        self.worded = WordCache(self._worded, 2 * CACHE_WORDS)  # the only cache of such a tokenizer
        self.spaced = WordCache(lambda w: self._part(" ", w, self.spaced))
        self.bare = WordCache(lambda w: self._part("", w, self.bare))

    @staticmethod
    def _ranks(spec: dict):
        """The same merges as ranks, for the tiktoken library, where each merge makes the next id; else None."""
        import tiktoken

        vocabulary, back = spec["model"]["vocab"], {letter: byte for byte, letter in BYTE_LETTERS.items()}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if [vocabulary.get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(map(back.__getitem__, piece)): i for piece, i in vocabulary.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode_ranked(self, text: str) -> bytes:
        """`encode`, in half of its time: texts of Latin letters, whose pre-tokens any version of Unicode cuts alike, go through the ranks."""
        if self.ranked is None or UNSURE.search(text):
            return self.encode(text)
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """One pre-token of letters, straight to the library's merge model."""
        shown = word.replace(" ", BYTE_LETTERS[32]) if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    # Words: white space is dropped, case is folded.
    def _worded_text(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return self.whole(text)
        return b"".join(map(self.worded.__getitem__, text.split()))

    def _worded(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                low = word.lower()
                return self._letters(word) if low == word else self.worded[low]
            if unicodedata.is_normalized("NFC", word):
                low = "".join(map(str.lower, word))
                return self._letters(low) if low.isalpha() else self.whole(word)
        elif word[-1] in TAILS and word[:-1].isalpha() and word[:-1].lower().isalpha():
            return self.worded[word[:-1]] + self.worded[word[-1]]
        return self.whole(word)

    # Words with the space before them: nothing is dropped.
    def _spaced_text(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return self.whole(text)
        if SPACE_RUN.search(text) or text[-1:].isspace():
            return b"".join(map(self.bare.__getitem__, PIECES.findall(text)))
        head, *rest = text.split(" ")
        return (self.bare[head] if head else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def _part(self, space: str, word: str, own: WordCache) -> bytes:
        if word.isalpha():
            return self._letters(space + word)
        if word and word[-1] in TAILS and word[:-1].isalpha():
            return own[word[:-1]] + self.bare[word[-1]]
        line, newline, rest = word.partition("\n")
        if line and rest and not line[-1].isspace() and not rest[0].isspace():
            return own[line] + self.bare[newline] + self.bare[rest]
        return self.whole(space + word)


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """One encoder a process: Spark keeps Python workers between tasks, and their caches with them."""
    return TextEncoder(path)
