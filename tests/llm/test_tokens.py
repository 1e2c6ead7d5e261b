import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.tokens import TextEncoder

ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n\nb", "x.\nY z", "don't I'll", "É́a É", "a\x1cb !\x1d?", "\xa0 a\xa0  b",
       "ab,\ncd. Ef| gh", "İstanbul ΣΑΣ ς", "<|endoftext|> x", "1234 5a b6", "😀 a😀", "á ́b", "ǅ ﬁ ª", "   x\x85y", "a\tb\r\nc", "\n\nLine", "w.\n", "日本語 テキスト", "ab.\nCd.\n\nEf\n", "it's we'll I'M 's", "\xa0a \xa0", "½ ² ª º ß ÿ ĳ ǆ", "x" * 3000, "a\r\n\tb \t"]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def coder(request):
    return TextEncoder(public_tokenizers.path(request.param))


def same(coder, text):
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == want, repr(text)
    assert np.frombuffer(coder.encode_ranked(text), "<u4").tolist() == want, repr(text)


def test_odd_texts(coder):
    for text in ODD:
        same(coder, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\xa0", "\x1c", " ", "a", "B", "é", "ß", "Σ", "'s", ".", ",", "|", "1", "́", "the", "İ"]), max_size=14))
def test_any_text(coder, parts):
    same(coder, "".join(parts))


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=40))
def test_latin_text(coder, text):
    same(coder, text)


def test_ranks_are_used(coder):
    assert (coder.ranked is not None) == (coder.encode == coder._spaced_text)
