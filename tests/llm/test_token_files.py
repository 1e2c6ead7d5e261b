import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm.token_files import decode_blocks, documents_of, file_bytes, read_file, read_token_files, write_token_files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, "<u4")
    cut = len(ids) // 3
    file = read_file(file_bytes([(5, cut), (None, len(ids) - cut), (9, 0)], ids))
    got = list(documents_of(file))
    assert [d for d, _, _ in got] == [5, None, 9]
    assert np.concatenate([x for _, _, x in got]).tolist() == values
    if len(file["low"]) > 1:
        assert decode_blocks(file, 1, 2)[: len(values) - 128].tolist() == values[128:256]


def check(rows, got, tokenizer):
    """Every row's ids, in ascending order of doc_id with nulls first, one behind the other."""
    want, at = Counter((doc, *tokenizer.encode(text or "", add_special_tokens=False).ids, 0) for doc, text, _ in rows), 0
    assert Counter((r.doc_id, *r.ids) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)


def test_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, f"word{i} " * (i % 50), "x") for i in range(300, 0, -1)] + [(None, "a", "x"), (1000, None, "x"), (5, "", "x"), (2000, "long text. " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    manifest, folder = write_token_files(docs, path, file_ids=500)
    got = sorted(read_token_files(manifest, folder, with_ids=True).collect(), key=lambda r: r.start)
    check(rows, got, Tokenizer.from_file(path))
    manifest, folder = write_token_files(docs.limit(0), path)
    assert read_token_files(manifest, folder).count() == 0


def test_null_and_equal_rows_in_several_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, f"text {i}", "x") for i in range(400)] + [(7, "the same", "x")] * 400 + [(i, "one", "x") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest, folder = write_token_files(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in manifest.collect()) < 300
    check(rows, sorted(read_token_files(manifest, folder, with_ids=True).collect(), key=lambda r: r.start), Tokenizer.from_file(path))
