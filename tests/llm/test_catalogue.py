"""The registered queries, with their production parameters, against brute force on the smallest tables."""

import hashlib
import html
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_native import targets
from test_similar import brute
from tokenizers import Tokenizer

from palimpsest.llm.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)


def result(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def ids_of(name, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_op1(spark, sf_dir, documents):
    rows, sequences = result(spark, sf_dir, "op1_pack"), defaultdict(list)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for d in documents:
        ids = ids_of("word_bpe_49k.json", d.text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d.doc_id, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    assert got == want and len(rows) == len(want)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_op2(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in result(spark, sf_dir, "op2_shards")}
    slots = defaultdict(list)
    for d in documents:
        r, data = rows[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op3(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op3_line_dedup']})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in result(spark, sf_dir, "op3_line_dedup")) == sorted(want)


def test_op4(spark, sf_dir, documents):
    want = brute([(d.doc_id, d.text) for d in documents])
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in result(spark, sf_dir, "op4_similar")) == sorted(want.elements())


def test_op5(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = result(spark, sf_dir, "op5_main_text")
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op6(spark, sf_dir, documents):
    size, source, taken, longest = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for d in documents:
        size[d.doc_id] = len(re.findall("[^\x20\x09-\x0d]+", d.text or ""))
        source[d.source] += size[d.doc_id]
        longest[d.source] = max(longest[d.source], size[d.doc_id])
    want, rows = targets(source), {r.doc_id: r for r in result(spark, sf_dir, "op6_mix")}
    assert abs(sum(want.values()) - sum(source.values())) < 1e-6
    for d in documents:
        r = rows[d.doc_id]
        assert (r["size"], r.source_size) == (size[d.doc_id], source[d.source]) and abs(r.target - want[d.source]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[d.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in want)
    assert rows == {r.doc_id: r for r in result(spark, sf_dir, "op6_mix")}


def test_op7(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in result(spark, sf_dir, "op7_fingerprints")}
    order = documents[::-1]
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        half, r = len(d.text) // 2, rows[d.doc_id]
        edited = d.text[: len(d.text) - half] + after.text[:half]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.fingerprint == rows[after.doc_id].fingerprint) == (r.near_next == 1)


def test_op8(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in result(spark, sf_dir, "op8_media")}
    for d in documents:
        data = (d.text or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 if data else 64)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by_text = defaultdict(set)
    for d in documents:
        by_text[d.text].add((rows[d.doc_id].feature, rows[d.doc_id].media_sha256))
    assert all(len(x) == 1 for x in by_text.values())


def test_op9(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in result(spark, sf_dir, "op9_toxicity")}
    assert set(rows) == {d.doc_id for d in documents}
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op9_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in result(spark, d, "op9_toxicity") if r.held_out and r.doc_id in labels]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.03


def test_op10(spark, sf_dir, documents):
    rows, at = {r.doc_id: r for r in result(spark, sf_dir, "op10_token_files")}, 0
    for d in documents:
        ids = ids_of("byte_bpe_50k.json", d.text)
        assert (rows[d.doc_id].start, rows[d.doc_id].n_tokens, rows[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
