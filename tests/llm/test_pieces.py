"""SentencePiece encoding against the library: ids, spans in original bytes, decoded text; the character map against its normaliser."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import pieces, tokens
from palimpsest.llm.catalogue import QUERIES
from palimpsest.llm.pieces import MODEL_NORMALISER, Normaliser, PieceEncoder, encode_pieces, fields

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "\n", "a\nb", "a \n b", "\n\na", "a\n", " \na", "<s> x </s>", "<0x41> <unk>", "x▁y ▁", "▁", "\x00 a\x00", "日本語 テキスト", "😀 a😀😀", "é é", "a\tb\r\n c",
       "ab.\nCd.\n\nEf\n", "1234 5a", "x" * 300, ("word " * 40 + "\n") * 3, "�", "  \xa0a"]


@pytest.fixture(scope="module")
def coder():
    return PieceEncoder(PATH)


def spans(library, text):
    """Ids and ends in bytes, by the library."""
    found = [{k: v for k, v, _ in fields(piece)} for n, piece, _ in fields(library.encode(text, return_type="serialized_proto")) if n == 2]
    return [p[2] for p in found], [p.get(5, 0) for p in found]


def same(coder, text):
    rows = coder.encode(text)
    ids, ends = spans(coder.library, text)
    assert rows[:, 0].tolist() == ids, repr(text)
    assert (coder.lead(text) + np.cumsum(rows[:, 1])).tolist() == ends, repr(text)
    assert np.frombuffer(coder.merge(text, True), "<u4").reshape(-1, 2).tolist() == rows.tolist()


def test_odd_texts(coder):
    assert coder.by_words and coder.cut is pieces.WORDS_OF_LINES
    for text in ODD:
        same(coder, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "▁", "a", "the", "ing", "é", "日", "\x00", ".", "1", "Zq", "😀"]), max_size=14))
def test_any_text(coder, parts):
    same(coder, "".join(parts))


def test_small_caches(coder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    texts = [t for n in range(1, 8) for t in [*ODD, *(" ".join(f"w{i * n}" for i in range(9)) for _ in range(3))]]
    fresh = PieceEncoder(PATH)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        assert [r[:, 0].tolist() for r in fresh.encode_all(part)] == [coder.library.encode(t) for t in part]
    assert len(fresh.words.old) < 100 and not any(len(w) >= tokens.LONG_WORD for w in fresh.words.old)


def rule(name):
    found = sentencepiece.SentencePieceNormalizer(rule_name=name)
    spec = next(v for n, v, _ in fields(found.serialized_model_proto()) if n == MODEL_NORMALISER)
    return found, Normaliser(spec)


@pytest.mark.parametrize("name", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_character_map(name):
    theirs, ours = rule(name)
    for text in [*ODD, "ﬁ ①", " ﬀ  ﬃx ", "Å Å Å", "が ガ", "㍿\x0b ½ café", "  　Ａ　 ", "ÄÖÜ ß İ", "x ¨ y", "​ a", "̈", "ä́"]:
        normal, places = ours.normalise(text.encode())
        want, at = theirs.normalize(text, with_offsets=True)
        assert normal.decode() == want, repr(text)
        ends = np.cumsum([0, *(len(c.encode()) for c in normal.decode())])
        assert [places[i] for i in ends] == [len(text[:i].encode()) for i in at] or not want, repr(text)


def test_entries_of_the_map():
    _, ours = rule("nfkc")
    known = list(ours.map.entries())
    assert len(known) > 3000 and len(set(known)) == len(known)
    assert all(ours.map.longest(k, 0)[0] == len(k) for k in known)


def test_edges_and_other_columns(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, " a\nb", None), (3, "é" * 5, "z"), (3, "é" * 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = encode_pieces(docs, PATH).collect()
    want = []
    for doc, text, _ in rows:
        ids, ends = spans(library, text or "")
        want.append((doc, [1, *ids, 2], [0, *ends, ends[-1] if ends else 0], library.decode([1, *ids, 2])))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.ends, "<u4").tolist(), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert encode_pieces(docs.limit(0), PATH).collect() == []


def test_op13(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = {r.doc_id: r for r in QUERIES["op13_pieces"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
