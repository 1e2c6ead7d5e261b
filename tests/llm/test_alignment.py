"""Alignment of two tokenizers against a naive version over byte ranges."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm.alignment import Aligner, Bits, align_documents
from palimpsest.llm.catalogue import QUERIES

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@pytest.fixture(scope="module")
def naive():
    a, b, back = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH), byte_letters()
    a.encode_special_tokens = True

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def ranges(tokens):
        at, out = 0, []
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def align(text):
        """Token ranges of both, or none."""
        if not text:
            return [], []
        ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = [(i, piece(i)) for i in b.encode(text)]
        want = b" " + text.encode()
        return (ranges(ta), ranges(tb)) if b"".join(x for _, x in ta) == want == b"".join(x for _, x in tb) else ([], [])

    def split(side, cuts):
        """Token ranges of each group."""
        out = [[] for _ in cuts]
        for t in side:
            out[bisect.bisect_left(cuts, t[2])].append(t)
        return out

    def corpus(texts):
        found = [align(t) for t in texts]
        owners = [[[(k, t[0]) for k, t in enumerate(side) for _ in range(t[1], t[2])] for side in doc] for doc in found]
        links = [[(i, j) for (_, i), (_, j) in sorted(set(zip(*sides, strict=True)))] for sides in owners]
        counts = Counter(x for doc in links for x in doc)
        highest = Counter()
        for (_, j), n in counts.items():
            highest[j] = max(highest[j], n)
        out = []
        for (ta, tb), own in zip(found, links, strict=True):
            cuts = sorted({e for *_, e in ta} & {e for *_, e in tb})
            group = lambda side: [",".join(str(i) for i, *_ in own) for own in split(side, cuts)]
            text = ";".join(map("|".join, zip(group(ta), group(tb), strict=True)))
            out.append((len(ta), len(tb), len(cuts), len(own), sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return out

    return corpus


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "a", "a b", "  a   b  ", "x▁y", "\n\n a", "日本語 テキスト", "😀 a😀", "<|endoftext|> <s> </s> <0x41>", "\x00", "\x1c a", "1234 don't", "é é", "the cat sat on the mat. the cat\nsat", "the cat sat on the mat. the cat\nsat"]


def test_odd_texts(spark, naive):
    docs = spark.createDataFrame([(None if i == 3 else min(i, 15), t, "n") for i, t in enumerate(ODD)], "doc_id long, text string, n_a string").repartition(3)
    for chunk in (1, 20, 10**6):
        got = [(r.doc_id, *(r[f] for f in FIELDS)) for r in align_documents(docs, A_PATH, B_PATH, chunk).collect()]
        want = [(None if i == 3 else min(i, 15), *w) for i, w in enumerate(naive(ODD))]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert align_documents(docs.limit(0), A_PATH, B_PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([" ", "\n", "the", "ing", "é", "日", "▁", "3", "Zq", "😀", "."]), max_size=9).map("".join), max_size=4))
def test_any_texts(naive, texts):
    got, want = Aligner(A_PATH, B_PATH).align(texts), naive(texts)
    assert [tuple(int(got[f][i]) for f in FIELDS[:4]) for i in range(len(texts))] == [w[:4] for w in want]
    assert [hashlib.sha256(t).hexdigest() if t else "" for t in got["groups_text"]] == [w[-1] for w in want]
    assert len(got["pairs"]) == sum(w[3] for w in want)


def test_ranks():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.3)
        bits, at = Bits.of(places, size), np.arange(size + 1)
        assert bits.places().tolist() == places.tolist() and bits.rank(at).tolist() == [int((places < i).sum()) for i in at]


def test_op12(spark, sf_dir, naive):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op12_alignment"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, want in zip(docs, naive([d.text for d in docs]), strict=True):
        assert rows[d.doc_id] == want
