"""The hashed embedding against a plain version, and answers that are asked for again."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import models


def plain(text):
    words, v = re.findall(r"[a-z_][a-z0-9_]+|\d+", text.lower()), [0.0] * models.WIDTH
    for f, w in [*((x, 1.0) for x in words), *((f"{a}~{b}", 0.6) for a, b in zip(words, words[1:], strict=False))]:
        h = 2166136261
        for c in f:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        v[h % models.WIDTH] += -w if h >> 16 & 1 else w
    v = [math.copysign(math.log1p(abs(x)), x) if abs(x) > 1e-9 else 0.0 for x in v]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_hashed_embedding():
    rng = random.Random(2)
    words = ["alpha", "b2", "x_y", "1234", "9" * 200, "w" * 47, "w" * 48, "w" * 49, "Ünder", "a", "the"] + [f"t{i}" for i in range(50)]
    texts = ["", " ", "a", "one", "one one", "é à", *(" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 40, 900))]
    assert np.allclose(models.hashed(texts), [plain(t) for t in texts], atol=1e-12)
    assert np.allclose(models.hashed(texts[6:7]), [plain(texts[6])], atol=1e-12) and models.hashed([]) == []


def test_sparse_embedding(spark):
    texts = {1: "alpha beta alpha", 2: "", 3: None, 4: "x " * 3, None: "gamma delta"}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, dim int").repartition(2)
    got = {}
    for r in models.sparse_embedding(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, {})[r.dim] = r.x
    assert set(got) == {1, None}  # a text without words of two letters has no rows
    for key, own in got.items():
        want = plain(texts[key])
        assert np.allclose([own.get(i, 0.0) for i in range(models.WIDTH)], want, atol=1e-12)
    assert models.sparse_embedding(df.limit(0), "doc_id", "text").count() == 0


def test_repairs(spark):
    """Good at once, good after one repair, never good, failing calls, and null prompts; only broken ones are asked again."""

    def call(prompts):
        out = []
        for p in prompts:
            kind, tries = p.split("\n")[0], p.count("Your last answer was")
            if kind == "fails":
                raise RuntimeError("no answer")
            out.append({"good": '{"n": 5, "s": "x"}', "late": '{"n": 50}' if not tries else '{"n": 6}', "never": "nothing", "none": None, "half": '{"n": "many"}'}[kind])
        return out

    kinds = ["good", "late", "never", "fails", "half", None, "good", "none"]
    df = spark.createDataFrame([(i, k, "keep") for i, k in enumerate(kinds)], "id int, prompt string, parsed_other string").coalesce(1)
    said = models.apply_structured(df, "prompt", "out", call, "n int, s string", {"range": F.col("parsed.n").between(0, 10), "known": F.col("parsed.n").isNotNull()})
    got = {r.id: (r.out and r.out.n, r.out_tries, r.out_problems) for r in said.collect()}
    assert got[0] == got[6] == (5, 1, None) and got[1] == (6, 2, None) and got[2] == (None, 2, ["unreadable"]) and got[3] == (None, 2, ["RuntimeError: no answer"])
    assert got[4][0] is None and got[4][1] == 2 and got[5] == (None, 0, None) and got[7] == (None, 2, ["unreadable"])
    assert said.columns == ["id", "prompt", "parsed_other", "out", "out_tries", "out_problems"]
