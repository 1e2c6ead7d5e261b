from collections import Counter

import pytest

import corpus_pipeline as P
from palimpsest.llm.common import materialise, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in P.STAGES:
        out.append((name, docs, materialise(stage(spark, docs, sf_dir), name)))
        docs = out[-1][2]
    return out


def test_stages(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns == stages[0][1].columns, name
        assert after.schema == before.schema, name


def test_near_duplicates_by_brute_force(stages):
    from test_similar import brute

    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, c, _ in brute(rows).elements() if d == c}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_lines_by_brute_force(stages):
    from test_native import key

    _, before, after = stages[1]
    first: dict[str, int] = {}
    rows = {r.doc_id: r.text or "" for r in before.collect()}
    for doc, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    got = {r.doc_id: (r.text or "", r.n_chars) for r in after.collect()}
    assert got == {d: (k := "\n".join(x for x in t.split("\n") if first.get(key(x), d) == d), len(k)) for d, t in rows.items()}


def test_mix_and_packing(stages):
    _, before, mixed = stages[3]
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in before.collect()} and max(times.values()) <= 3
    packed = stages[4][2].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= P.CAPACITY and len(used) <= 1.02 * sum(used.values()) / P.CAPACITY + 1


def test_toxicity_keeps_rows_whole(stages):
    _, before, after = stages[0]
    assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()


def test_edge_documents(spark, sf_dir):
    """What each stage makes of nulls, empty, long and repeated rows, with extra columns of clashing names."""
    long = "x " * 100_000
    rows = [(1, None, "en", None, 0, "a", 1), (2, "", "en", "a", 0, "b", 2), (2, "", "en", "a", 0, "b", 2), (None, "some text of a row without id", None, "a", None, None, None), (5, long, "en", "b", 200_000, "c", 3)]
    schema = f"{', '.join(f'{n} {t}' for n, t in table(spark, sf_dir, 'documents').dtypes)}, score string, __toxicity int"
    docs = spark.createDataFrame(rows, schema)
    after = {}
    for name, stage in P.STAGES:
        docs = after[name] = materialise(stage(spark, docs, sf_dir), "edge")
    key = lambda r: (r[0] or 0, r[1] or "")
    got = {name: sorted(map(tuple, df.collect()), key=key) for name, df in after.items() if name != "packing"}
    assert all(after[n].schema == spark.createDataFrame([], schema).schema for n in got)
    assert got["toxicity"] == sorted(rows, key=key)  # none of them is toxic
    # Null and empty texts are one empty line; a line is dropped only where a smaller id has it; n_chars follows the text.
    assert got["line_dedup"] == sorted(((*r[:4], None if r[1] is None else len(r[1]), *r[5:]) for r in rows), key=key)
    assert got["near_duplicates"] == got["line_dedup"]  # rows without an id or without words have no class and stay
    before = Counter(got["near_duplicates"])
    assert all(n <= 3 * before[r] for r, n in Counter(got["mixing"]).items())
    packed = after["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in got["mixing"])
    for name, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0, name
