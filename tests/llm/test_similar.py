import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.components import connected_components
from palimpsest.llm.similar import chosen_paths, drop_near_duplicates, exact_links, jaccard_join, roots_of, runs_for, token_set


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def corpus(n=260, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(rng.choice([6, 20, 80, 200]))) for _ in range(n // 2)]
    rows = list(enumerate(base))
    for _ in range(n // 4):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        rows.append((len(rows), " ".join(words)))
    first = " ".join(word() for _ in range(150)).split()
    for i in range(160):  # one group of near copies
        words = list(first)
        words[i % 150] = word()
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, base[3]) for i in range(30)]  # exact copies
    rows += [(len(rows) + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(90)]  # a shared passage
    rows += [(len(rows), "one two"), (len(rows) + 1, "one  TWO\n"), (len(rows) + 2, None), (len(rows) + 3, ""), (len(rows) + 4, " \n"), (None, base[3]), (0, base[1]), (len(rows) + 5, "w x y z " * 20_000)]
    return rows


def brute(rows):
    sets = [shingles(t) if d is not None else frozenset() for d, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, least.get(find(i)) if d is not None else None, n) for i, ((d, _), n) in enumerate(zip(rows, links, strict=True)))


def test_join(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sid string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    want = brute(rows)
    assert sum(((got - want) + (want - got)).values()) == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, c, _ in want.elements() if d == c)
    assert jaccard_join(docs.where("false")).count() == 0


def test_join_of_blocks(spark, monkeypatch):
    from palimpsest.llm import similar

    for name, value in (("EXACT_SETS", 50), ("LEAF_SETS", 8), ("BLOCK_SETS", 20)):
        monkeypatch.setattr(similar, name, value)
    rows = corpus(seed=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    want = brute(rows)
    assert sum(((got - want) + (want - got)).values()) == 0


def test_join_of_deeper_paths(spark, monkeypatch):
    """Large buckets of texts that share half their words go on to longer paths; what is left after the last round meets in pairs of blocks."""
    from palimpsest.llm import similar

    rounds = []
    deeper = similar._deeper
    monkeypatch.setattr(similar, "_deeper", lambda *a: rounds.append(1) or deeper(*a))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    texts = [passage + " " + " ".join(word() for _ in range(30)) for _ in range(80)]
    texts += [" ".join([*t.split()[:68], word(), word()]) for t in texts[:20]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for name, value in (("EXACT_SETS", 50), ("LEAF_SETS", 4), ("BLOCK_SETS", 10)):
        monkeypatch.setattr(similar, name, value)
    for most in (3, 1):
        monkeypatch.setattr(similar, "ROUNDS", most)
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect()) == want
        assert len(rounds) == (2 if most == 3 else 0)
        rounds.clear()


def test_recall_of_deeper_paths():
    """A pair at the threshold that goes on from each path it shares meets again with the stated probability."""
    from palimpsest.llm.similar import AGAIN, _mixed, _ODD

    rng = np.random.default_rng(4)
    met = 0
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        b = np.unique(np.concatenate([a[:89], rng.integers(0, 2**63, 11).astype(np.uint64)]))
        starts = [chosen_paths(t, roots_of(runs_for()))[-1][1] for t in (a, b)]
        x, y = (chosen_paths(t, _mixed((s[:, None] + _ODD[None, :AGAIN]).ravel()))[-1][1] for t, s in zip((a, b), starts, strict=True))
        met += len(np.intersect1d(x, y)) > 0
    assert met / 200 > 0.97, met


def test_recall_of_runs():
    """Pairs at the threshold meet in a bucket of every length."""
    rng = np.random.default_rng(1)
    met = np.zeros(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        b = np.unique(np.concatenate([a[:89], rng.integers(0, 2**63, 11).astype(np.uint64)]))
        x, y = chosen_paths(a, roots_of(runs_for())), chosen_paths(b, roots_of(runs_for()))
        met += [len(np.intersect1d(p, q)) > 0 for (_, p), (_, q) in zip(x, y, strict=True)]
    assert (met / 200 > 0.97).all(), met


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.integers(0, 5))
def test_exact_links(sets, cut):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    same = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    got = exact_links(arrays, None)
    assert all(got[i, j] == (i != j and same(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))
    if 0 < cut < len(sets):
        got = exact_links(arrays[:cut], arrays[cut:])
        assert all(got[i, j] == same(a, b) for i, a in enumerate(sets[:cut]) for j, b in enumerate(sets[cut:]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 102), (103, 102), (200, 200)] + [(300, 301 + i) for i in range(100)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in range(100, 104)} == {100} and got[200] == 200 and {got[i] for i in range(300, 401)} == {300}


def test_token_set():
    assert len(token_set("")) == 0 and len(token_set("a b")) == 1 and (token_set("A b c d e f") == token_set("a  b c d\ne f")).all()
    assert len(token_set("a b c d e " * 40)) == 5


def test_one_row_of_each_class(spark):
    """Rows that share a doc_id are judged by their own texts; of repeated rows of a class one stays; rows without words all stay."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (2, b, "y"), (2, a, "z"), (1, a, "x2"), (3, b + " more", "y"), (4, "", "e"), (4, "", "e"), (5, None, "e"), (None, a, "n"), (None, a, "n"), (6, "quite another text of a few words", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect())
    assert got == Counter([(1, a), (2, b), (4, ""), (4, ""), (5, None), (None, a), (None, a), (6, rows[-1][1])])
    assert drop_near_duplicates(docs).columns == docs.columns
