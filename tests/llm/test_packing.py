from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.packing import PLANS, assign_sequences, pack_documents, plan_packing


def check_plan(counts, capacity, plan):
    runs, used = plan_packing(counts, capacity, *plan)
    by = defaultdict(list)
    for run in runs:
        by[run[0]].append(run)
    spans = defaultdict(list)
    for length, n in counts.items():
        mine = sorted(by[length], key=lambda r: r[1])
        ends = [r[1] for r in mine[1:]] + [n]
        for (_, rank, sequence, each, offset), end in zip(mine, ends, strict=True):
            for i in range(end - rank):
                spans[sequence + i // each].append((offset + i % each * length, length))
    assert sum(map(len, spans.values())) == sum(counts.values())
    assert set(spans) == set(range(used))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return used


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30), st.sampled_from(PLANS))
def test_plans_hold(counts, plan):
    check_plan(counts, 64, plan)


def test_close_to_bound():
    counts = {n: 3 * (65 - n) for n in range(1, 65)}
    assert min(check_plan(counts, 64, p) for p in PLANS) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 64)


def test_documents(spark):
    rows = [(i, "the cat sat " * (i % 40), i) for i in range(200)] + [(None, None, 1), (7, "", 2), (7, "", 3), (8, "dog " * 500, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 128, with_ids=True).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append((r.start, list(r.ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert sum(r.length for r in packed) == sum(len((t or "").split()) + 1 for _, t, _ in rows)
    assert [i for _, x in sorted(texts[8])[1:] for i in x][-1] == 0
    assert len(sequences) <= 1.05 * sum(r.length for r in packed) / 128 + 1
    empty = pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 128)
    assert empty.count() == 0


def test_extra_columns(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 5, 9, "x"), (None, 0, 0, 3, 9, None)], "doc_id long, piece int, start long, length long, ids_crc32 long, note string")
    got = assign_sequences(pieces, 8).collect()
    assert {(r.doc_id, r.note, r.sequence_id) for r in got} == {(1, "x", 0), (None, None, 0)}


def test_equal_rows(spark, monkeypatch):
    """Null ids and equal rows, more than a bucket holds: every piece still has its own place."""
    from palimpsest.llm import packing

    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    docs = spark.createDataFrame([(None, "the cat")] * 150 + [(None, f"dog {i}") for i in range(60)] + [(3, "a b c d")] * 30, "doc_id long, text string").repartition(4)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 16).collect()
    places = {(r.sequence_id, r.offset + i) for r in packed for i in range(r.length)}
    assert len(packed) == 240 and len(places) == sum(r.length for r in packed) and max(p for _, p in places) < 16
