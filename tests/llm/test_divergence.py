"""The divergence audit against plain counting over all terms of all groups, and against DuckDB."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from palimpsest.llm import divergence
from palimpsest.llm.catalogue import ORACLE_SQL, QUERIES
from palimpsest.llm.divergence import audit, possible_terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least=3, top=200):
    by, groups, frequency = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        by[lang, source].update(words(text))
        frequency[lang].update(set(words(text)))
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in frequency[lang].items() if n >= least]
        share = lambda count, v=len(kept): {t: 1 + 10**9 * (count[t] + 1) // (sum(count[x] for x in kept) + v) for t in kept}  # noqa: E731, B023
        sources = [s for x, s in groups if x == lang]
        p = {s: share(by[lang, s]) for s in sources}
        q = share(sum((by[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            told = [(f(p[s][t], q[t]), t) for t in kept if by[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", told, top)):
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


ROWS = [
    ("The cat's Ärger ärger x1y", "en", "a"), ("the cat the dog", "en", "b"), ("THE dog_dog cat", "en", "a"), (None, "en", "empty"), ("", "en", None), ("the\x00cat zebra", None, "a"), ("zebra", None, "b"), ("zebra 日本 日本", None, None),
    ("日本 zebra", "", "b"), ("once", "fr", "only"), ("x" * 5000 + " the cat", "en", "c"), ("the cat's Ärger", "en", "b"), ("The cat's Ärger ärger x1y", "en", "a"), ("Ärger", "de", "a"), ("Ärger", "de", "b"), ("Ärger", "de", "b"),
]


def test_edges(spark):
    docs = spark.createDataFrame([(i, *r, 5) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, count int").repartition(3)
    assert result(audit(docs)) == brute(ROWS)
    assert result(audit(docs, least=1, top=2)) == brute(ROWS, 1, 2)
    assert result(audit(docs, least=400)) == brute(ROWS, 400)
    assert audit(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_random_rows(spark, small, monkeypatch):
    """Tasks that put out their terms many times; one source with a third of the rows."""
    monkeypatch.setattr(divergence, "HELD_TERMS", 300)
    rng = np.random.default_rng(5)
    rows = [(text, ["en", "de"][int(rng.integers(2))], "hot" if rng.random() < 0.33 else f"s{rng.integers(6)}") for text, *_ in small]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert result(audit(docs)) == brute(rows)


def test_sketch_never_underestimates(spark, small):
    docs = spark.createDataFrame([(t or "", lang or "", "") for t, lang, _ in small], "text string, lang string, source string").repartition(4)
    frequency = Counter((lang or "", t) for text, lang, _ in small for t in set(words(text)))
    for width in (1 << 16, 1 << 18):
        bits = possible_terms(docs, width)
        passed = {}
        for lang, term in frequency:
            cells = divergence._cells(lang, [term.encode()], width)[0]
            passed[lang, term] = all(bits[c >> 3] >> (c & 7) & 1 for c in cells)
        assert all(passed[k] for k, n in frequency.items() if n >= 3)
    rare = [passed[k] for k, n in frequency.items() if n < 3]
    assert sum(rare) < 0.1 * len(rare)


def test_op11(spark, sf_dir, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op11_divergence']})").fetchall()
    got = result(QUERIES["op11_divergence"](spark, sf_dir))
    assert got == sorted(want) and got == brute(small)
