"""The lexical index against a scan of all texts."""

import random

import pytest

from palimpsest.operators import lexical_index as L
from palimpsest.operators.retrieval import lexical_topk

WORDS = "alpha beta gamma delta the of and parse_tree token user_id x_y ünïcode Zürich 日本語 config retry".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))) for i in range(0, 900, 3)]
    out += [(1000 + i, "retry the same text of a copied page with user_id") for i in range(300)]  # ties, a third of all rows
    return out + [(5, None), (7, ""), (8, "ab"), (2000, "parseXtree " * 3000), (2001, "user_identity"), (2002, "ALPHA BETA")]


@pytest.fixture(scope="module")
def index(spark, rows):
    before, L.BLOCK = L.BLOCK, 64
    yield L.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    L.BLOCK = before


QUERIES = ["parse_tree retry", "the the of alpha", "user_id user_id config", "x_y", "x_y alpha", "zzz qqq", "", "___", "Alpha BETA gamma delta token retry the of and parse_tree user_id config extra", "ident parse xtree", "same text copied page"]


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("k", [1, 24, 1000])
def test_like_the_scan(spark, rows, index, query, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(r.doc_id, r.hits) for r in lexical_topk(docs, query, k).collect()]
    found, told = L.search(index, query, k)
    assert [(r.doc_id, r.hits) for r in found.collect()] == want
    assert told.tested <= len(rows)


def test_what_is_read(index, rows):
    """A rare term reads the postings of its own three-character runs and the texts that can hold it; many copies end the search early."""
    _, told = L.search(index, "ident", 24)
    assert told.tested <= 3 and told.postings < 40
    _, told = L.search(index, "copied", 24)
    assert told.tested <= 304
    total = index.postings.count()
    assert told.postings < 0.05 * total


def test_empty(spark):
    index = L.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert L.search(index, "alpha beta", 5)[0].collect() == []
