import numpy as np

from pyspark.sql import functions as F

from palimpsest.llm.toxicity import THRESHOLD, _numbers, class_prior, corrected_risk, fit, held_out, keep_below, score_documents, train


def texts(n, toxic_share=0.2):
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(300)]
    base = ["".join(chr(97 + int(c)) for c in f"{i:05d}") for i in range(300)]
    out = []
    for i in range(n):
        words = list(rng.choice(base, 20))
        bad = rng.random() < toxic_share
        if bad:
            words[3] = "nastyword" + "abcdef"[i % 6]
        out.append((i, " ".join(words), int(bad)))
    return out


def test_learns_from_positives_and_unlabelled():
    rows = texts(3000)
    sets = [set(t.split()) for _, t, _ in rows]
    model = train([s for s, r in zip(sets, rows, strict=True) if r[2]][:300], sets, 0.2)
    got = model.score([t for _, t, _ in rows], model.words()) >= THRESHOLD
    truth = np.array([r[2] for r in rows], bool)
    assert (got == truth).mean() > 0.99


def test_edge_rows(spark):
    rows = texts(1200)
    docs = spark.createDataFrame([*((i, t, "a") for i, t, _ in rows), (None, "nastyworda x", "b"), (9000, None, "b"), (9001, "", "b"), (9001, "", "b"), (9002, "long nastywordb " + "aaaaa " * 200_000, "b")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (None, 1), (9000, None), (77777, 1)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = score_documents(docs, model, "found").collect()
    assert len(got) == 1205 and got[0]["score"] in ("a", "b")
    by = {r.doc_id: r.found for r in got}
    assert by[None] > THRESHOLD > by[9000] == by[9001] and by[9002] > THRESHOLD and all(0 <= v <= 1 for v in by.values())
    out = {r.doc_id: r.h for r in docs.select("doc_id", held_out(docs.doc_id).alias("h")).collect()}
    import zlib

    assert all(out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows) and out[None] is False
    late = [(r.found >= THRESHOLD) == bool(y) for r, (_, _, y) in zip(sorted((r for r in got if r.doc_id is not None and r.doc_id < 1200), key=lambda r: r.doc_id), rows, strict=True) if out[r.doc_id]]
    assert sum(late) / len(late) > 0.97
    nothing = fit(docs, labels.limit(0))
    assert {r.s for r in score_documents(docs, nothing, "s", keep=["doc_id"]).collect()} == {0.0}
    assert score_documents(docs.limit(0), model, "s").count() == 0


def test_risk_and_gradient_by_brute_force():
    """The two parts of the risk text by text, and the direction against differences of them."""
    rng = np.random.default_rng(5)
    x_p, x_u = rng.integers(0, 2, (7, 5)).astype(float), (rng.random((23, 5)) < 0.15).astype(float)
    seen = set()
    for prior in (0.05, 0.3, 0.5):
        for theta in (rng.normal(size=5), np.array([2.0, 2.0, 2.0, 2.0, 2.0]), np.array([-1.0, -2.0, 0.5, 0.0, -3.0]), np.where(x_p.mean(0) > x_u.mean(0), 6.0, -6.0)):

            def parts(t, prior=prior):
                loss = lambda g: np.log1p(np.exp(-g))
                p, u = [float(r @ t) for r in x_p], [float(r @ t) for r in x_u]
                return prior * sum(map(loss, p)) / 7, sum(loss(-g) for g in u) / 23 - prior * sum(loss(-g) for g in p) / 7

            positive, negative, step = corrected_risk(theta, x_p, x_u, prior)
            assert np.allclose((positive, negative), parts(theta), atol=1e-8)
            seen.add(negative >= 0)
            for i in range(5):
                e = np.eye(5)[i] * 1e-5
                (a1, b1), (a0, b0) = parts(theta + e), parts(theta - e)
                want = (a1 + b1 - a0 - b0) / 2e-5 if negative >= 0 else -(b1 - b0) / 2e-5
                assert abs(step[i] - want) < 1e-6
    assert seen == {True, False}


def test_texts_without_feature_words_stay_below(spark):
    """However few texts teach, the mean score is the prior, so a text that holds nothing telling is not toxic."""
    for n in (60, 200, 900):
        rows = texts(n, 0.14)
        sets = [set(t.split()) for _, t, _ in rows]
        for some in (sets, sets[: n // 2]):
            model = train([s for s, r in zip(sets, rows, strict=True) if r[2]], some, 0.14)
            empty = float(model.score([""], model.words())[0])
            assert empty < 0.15 < THRESHOLD


def test_small_table_keeps_clean_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs.select("doc_id", "text"), labels)
    assert float(model.score([""], model.words())[0]) < THRESHOLD
    found = {r.doc_id: r.s for r in score_documents(docs, model, "s", keep=["doc_id"]).collect()}
    clean = [r.doc_id for r in labels.where("toxic = 0").collect()]
    assert sum(found[i] >= THRESHOLD for i in clean) <= 0.05 * len(clean)


def test_prior_follows_the_unlabelled_texts():
    """Labelled rows with twice the toxic share of the texts at large: the words' coverage shows it."""
    rows = texts(4000, 0.1)
    sets = [set(t.split()) for _, t, _ in rows]
    vocabulary: dict[str, int] = {}
    u = [_numbers(sorted(s), vocabulary) for s in sets]
    p = [t for t, r in zip(u, rows, strict=True) if r[2]]
    assert abs(class_prior(0.2, p, u, len(vocabulary)) - 0.1) < 0.02


def test_columns_with_the_scores_name(spark):
    sets = [set(t.split()) for _, t, _ in texts(300, 0.2)]
    model = train([s for s, r in zip(sets, texts(300, 0.2), strict=True) if r[2]], sets, 0.2)
    docs = spark.createDataFrame([(i, t, f"s{i}", f"x{i}", i) for i, (_, t, _) in enumerate(texts(40, 0.4))], "doc_id long, text string, score string, __toxicity string, text2 int")
    scored = score_documents(docs, model)
    assert scored.columns == ["doc_id", "text", "__toxicity", "text2", "score"]
    kept = keep_below(docs, model)
    assert kept.schema == docs.schema
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect()} - {tuple(r) for r in docs.join(scored.where(F.col("score") >= THRESHOLD).select("doc_id"), "doc_id", "left_semi").collect()}
    assert 0 < kept.count() < 40 and keep_below(docs.limit(0), model).count() == 0
