import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import models
from palimpsest.operators import sessions


def test_models(spark):
    df = spark.createDataFrame([(1, "foo bar"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r for r in models.embed(df, "text").collect()}
    assert abs(sum(x * x for x in got[1].embedding) - 1) < 1e-9 and sum(x != 0 for x in got[1].embedding) == 3 and not any(got[2].embedding) and got[3].embedding is None

    def odd(texts):
        if any(not t for t in texts):
            raise ValueError("empty")
        return [t.upper() for t in texts]

    out = {r.id: (r.up, r.up_error) for r in models.apply_model(df, "text", "up", T.StringType(), odd).collect()}
    assert out == {1: ("FOO BAR", None), 2: (None, "ValueError: empty"), 3: (None, None)}
    assert models.stub_answer(["a"]) == models.stub_answer(["a"])


def test_turns(spark):
    rows = [("s", "quick", "interviewer", 0, "q"), *(("s", "quick", "candidate", i, f"a{i}") for i in range(1, 4)), *(("t", "quick", "candidate", i, "x") for i in range(6))]
    got = {r.session: r for r in sessions.next_turn(spark.createDataFrame(rows, "session string, mode string, role string, idx int, text string")).collect()}
    assert (got["s"].answered, got["s"].remaining, got["s"].beat, got["s"].move, got["s"].query) == (3, 3, 2, "ask", "a3")
    assert (got["t"].remaining, got["t"].beat, got["t"].move) == (0, 4, "wrap")


def test_claims_suite_readme(spark, tmp_path):
    docs = spark.createDataFrame([(1, "we use kafka and redis"), (2, "nothing")], "doc_id long, text string")
    assert [r.doc_id for r in sessions.check_claims(docs, ["kafka", "redis"]).collect()] == [1]
    found = spark.createDataFrame([("a", 6, ["SQL", "JavaScript"], 3), ("b", 2, ["PHP"], 0)], "repo string, files int, languages array<string>, findings int")
    want = spark.createDataFrame([("a", 4, ["JavaScript"], True), ("b", 3, ["PHP"], False), ("c", 1, ["Go"], False)], "repo string, min_files int, languages array<string>, redaction boolean")
    assert {r.repo: r.passed for r in sessions.suite_results(found, want).collect()} == {"a": True, "b": False, "c": False}
    files = spark.createDataFrame([("b/README.md", "two"), ("a/readme.txt", "one"), ("x.md", "no")], "path string, content string")
    assert sessions.first_readme(files).first().readme == "one"
    sessions.write_snapshot(files.withColumn("snapshot", F.lit("s1")), f"file://{tmp_path}/out")
    sessions.write_snapshot(files.withColumn("snapshot", F.lit("s2")), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").where("snapshot = 's1'").count() == 3


def test_jobs(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 12, m)
    rows = [(1, "queued", 0, at(0)), (2, "queued", 0, at(0)), (2, "done", 1, at(1)), (3, "failed", 1, at(0)), (4, "failed", 2, at(0)), (5, "active", 1, at(0)), (6, "active", 1, at(58)), (1, "queued", 0, at(0))]
    got = sessions.take_jobs(spark.createDataFrame(rows, "job_id int, state string, tries int, at timestamp"), F.lit("2026-01-01 12:59:00"))
    assert sorted(r.job_id for r in got.collect()) == [1, 3, 5]


@pytest.mark.parametrize("text", ["foo bar", "a_b 12 x"])
def test_embedders_agree(spark, text):
    """The Python embedder and the column functions hash alike."""
    from palimpsest.functions.vectors import fnv1a

    for w in text.split():
        assert spark.range(1).select(fnv1a(F.lit(w)).alias("h")).first().h == int(models._fold([w], np.full(1, 2166136261, np.uint64))[0])


def test_many_queries_like_single_ones(spark):
    """Lexical and hybrid retrieval for all queries at once, against one at a time; one query's term in all documents, one without terms, one null."""
    import random

    from palimpsest.operators import retrieval, vector_index

    rng = random.Random(6)
    words = ["alpha", "beta", "the", "user_id", "userXid", "Ünder", "gamma", "delta9"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))) + (" everywhere" if i % 3 else "")) for i in range(150)] + [(200, None)], "doc_id long, text string").repartition(4)
    asked = [(1, "alpha user_id beta"), (2, "everywhere"), (3, "a b"), (4, None), (5, "the the everywhere delta9 alpha"), (6, "nothing here")]
    queries = spark.createDataFrame(asked, "query long, text string")
    before = retrieval.BLOCK_DOCS, retrieval.BLOCK_QUERIES
    retrieval.BLOCK_DOCS, retrieval.BLOCK_QUERIES = 40, 2
    try:
        got = {}
        for r in retrieval.lexical_topk_many(docs, queries, 7).collect():
            got.setdefault(r["query"], []).append((r["rank"], r.doc_id, r.hits))
        for key, text in asked:
            want = [(i + 1, r.doc_id, r.hits) for i, r in enumerate(retrieval.lexical_topk(docs, text or "", 7).collect())]
            assert sorted(got.get(key, [])) == want, text
        vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)], "vec_id long, embedding array<double>")
        index = vector_index.build_index(vectors, cells=4)
        own = queries.join(vectors.withColumnRenamed("vec_id", "query"), "query")
        many = {}
        for r in retrieval.hybrid_many(docs, index, own, 5).collect():
            many.setdefault(r["query"], []).append((r["rank"], r.doc_id, r.score))
        for r in own.collect():
            want = [(i + 1, x.doc_id, x.score) for i, x in enumerate(retrieval.hybrid(docs, vectors, r.text or "", list(r.embedding), 5).collect())]
            assert sorted(many[r["query"]]) == want
    finally:
        retrieval.BLOCK_DOCS, retrieval.BLOCK_QUERIES = before


def test_texts_meet_terms_once(spark):
    """A text is read once for all queries and gives each distinct term that it is LIKE: inside longer runs, in other letters' neighbourhood, and with wildcards."""
    from pyspark.sql import functions as F

    from palimpsest.operators import retrieval

    texts = spark.createDataFrame([(1, "thereafter, éthe9 x"), (2, "user-id and a\nb"), (3, "nothing"), (4, ""), (1, "thereafter, éthe9 x")], "d long, t string")
    terms = [["the", "here", "user_id", "a_b"], ["___", "zzz", "the9", "erst"]]
    packs = spark.createDataFrame(list(enumerate(terms)), "pack int, terms array<string>")
    before = retrieval.BLOCK_TEXTS
    retrieval.BLOCK_TEXTS = 2
    try:
        got = sorted((r.d, sorted(terms[i // 4][i % 4] for i in r.ids)) for r in retrieval.held_terms(texts, packs, 4).collect())
    finally:
        retrieval.BLOCK_TEXTS = before
    assert got == [(1, ["___", "here", "the", "the9"])] * 2 + [(2, ["___", "a_b", "user_id"]), (3, ["___"])]
    queries = spark.range(400).select(F.col("id").alias("query"), F.concat(F.lit("the everywhere term"), "id").alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), F.when(F.col("id") == 7, "everywhere ").otherwise(""), F.lit("term"), "id").alias("text"))
    best = {r["query"]: r.doc_id for r in retrieval.lexical_topk_many(docs, queries, 1).collect()}
    assert len(best) == 400 and all(best[q] == 7 for q in range(10, 400) if q != 7)


def shuffled_bytes(spark, run):
    """Bytes that tasks write for shuffles while it runs."""
    sc = spark.sparkContext._jsc.sc()

    def told():
        sc.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (lambda seq: [seq.apply(i) for i in range(seq.size())])(sc.statusStore().executorList(False)))

    before = told()
    run()
    return told() - before


def test_many_queries_shuffle_little(spark):
    """What is shuffled grows with the queries, not with the texts, nor with the cells that vectors without clusters lie in."""
    import random

    from palimpsest.operators import retrieval, vector_index

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(100)) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    docs.cache().count()
    asked = spark.createDataFrame([(i, " ".join(rng.choice(texts[i * 7].split()) for _ in range(5))) for i in range(60)], "query long, text string")
    found = []
    sent = shuffled_bytes(spark, lambda: found.extend(retrieval.lexical_topk_many(docs, asked, 3).collect()))
    assert {r["query"]: r.doc_id for r in found if r["rank"] == 1} == {i: i * 7 for i in range(60) if any(w[0].isalpha() for w in asked.where(f"query = {i}").first().text.split())}
    assert sent < sum(map(len, texts)) / 8
    docs.unpersist()
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(2000)], "vec_id long, embedding array<double>")
    index = vector_index.build_index(vectors, cells=128)
    near = index.rows.where("vec_id < 500").select(index.rows.vec_id.alias("query"), "embedding")
    got = []
    sent = shuffled_bytes(spark, lambda: got.extend(vector_index.search_many(index, near, 3).collect()))
    assert sent < 2000 * 32 * 8 * 5  # a query that went to all cells would be 128 rows
    x = {r.vec_id: r.embedding for r in vectors.collect()}
    for q in (0, 77, 499):
        want = sorted(((-round(sum(a * b for a, b in zip(x[q], v, strict=True)), 6), i) for i, v in x.items()))[:3]
        assert [r.vec_id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [i for _, i in want]


def test_best_of_blocks():
    """Blocks of documents and of vectors in any order of keys against all at once: equal hits, repeated terms, equal keys, null and text keys, terms with and without bitmaps."""
    import random

    import numpy as np
    import pyarrow as pa

    from palimpsest.operators import retrieval, vector_index

    rng = random.Random(8)
    before = retrieval.BITMAP_BYTES, retrieval.CELLS, retrieval.MERGED
    try:
        for kind, bitmaps, cells in ((pa.int64(), 1 << 20, 1 << 20), (pa.string(), 300, 500), (pa.int64(), 1, 64)):
            retrieval.BITMAP_BYTES, retrieval.CELLS, retrieval.MERGED = bitmaps, cells, 13
            keys = [None if i == 9 else i // 2 * 2 if i % 17 == 1 else i for i in range(400)]
            rng.shuffle(keys)
            keys = pa.array([k if k is None or pa.types.is_integer(kind) else f"d{k}" for k in keys], kind)
            held = [sorted(rng.sample(range(60), rng.randrange(1, 30)) if i % 3 else rng.sample(range(8), 5)) for i in range(400)]
            queries = [rng.choices(range(70), k=rng.randrange(1, 13)) if i % 4 else rng.choices(range(9), k=12) for i in range(40)]
            ids, ends = np.array([t for q in queries for t in q], np.int32), np.cumsum([0, *map(len, queries)])
            order = {k: i for i, k in enumerate(sorted(set(keys.to_pylist()), key=lambda k: (k is not None, k if k is not None else 0)))}
            best = retrieval.Best(len(queries), 5, kind, np.uint8, 0)
            batches = [pa.RecordBatch.from_pydict({"d": keys[a : a + 50], "ids": pa.array(held[a : a + 50], pa.list_(pa.int32()))}) for a in range(0, 400, 50)]
            for block in ([batches[0]], batches[1:3], batches[3:]):
                retrieval._meet(block, ids, ends, best, 5)
            got = {i: [] for i in range(len(queries))}
            for i, found, hits in best.finds(7):
                for q, k, h in zip(i.to_pylist(), found.to_pylist(), hits.to_pylist(), strict=True):
                    got[q].append((-h, order[k]))
            for i, q in enumerate(queries):
                every = sorted((-sum(t in own for t in q), order[k]) for k, own in zip(keys.to_pylist(), map(set, held), strict=True))
                assert got[i] == [e for e in every if e[0] < 0][:5]
            x, y = (np.random.default_rng(s).integers(-2, 3, (n, 3)).astype(np.float64) for s, n in ((1, 30), (2, 400)))
            near = retrieval.Best(30, 5, kind, np.float64, -np.inf)
            for a in range(0, 400, 90):
                vector_index._scan_block(pa.RecordBatch.from_pydict({"k": keys[a : a + 90], "v": pa.array(y[a : a + 90].tolist())}), x, near, 5)
            got = {i: [] for i in range(30)}
            for i, found, score in near.finds():
                for q, k, h in zip(i.to_pylist(), found.to_pylist(), score.to_pylist(), strict=True):
                    got[q].append((-h, order[k]))
            for i in range(30):
                assert got[i] == sorted((-float(x[i] @ v), order[k]) for k, v in zip(keys.to_pylist(), y, strict=True))[:5]
    finally:
        retrieval.BITMAP_BYTES, retrieval.CELLS, retrieval.MERGED = before
