"""Overlap join in bins, and checkpoints by content."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence, tables


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    span = lambda most: (a := rng.randrange(3000), a + rng.randrange(most))
    left = [("hot" if i % 3 == 0 else f"p{i % 9}", i, *span(60)) for i in range(500)] + [("hot", 900, 0, 5000), ("hot", 901, -50, -10), ("hot", 902, 4000, 4100), ("hot", 5, 10, 12), (None, 903, 1, 2), ("hot", 904, None, 7)]
    right = [("hot" if i % 3 == 0 else f"p{i % 9}", *span(25), f"c{i}") for i in range(900)] + [("hot", 7, 7, "same")] * 150 + [("hot", 3, 2990, "long"), (None, 1, 2, "null"), ("hot", 5, None, "open")]
    return left, right, spark.createDataFrame(left, "path string, id int, a int, b int").repartition(4), spark.createDataFrame(right, "path string, c int, e int, content string").repartition(4)


@pytest.mark.parametrize("rows", [20, 200, 10**6])
def test_pairs(sides, rows):
    left, right, x, y = sides
    want = sorted((i, c, e, t) for p, i, a, b in left for q, c, e, t in right if p is not None and p == q and None not in (a, b, c, e) and a <= e and b >= c)
    got = evidence.binned_overlap_join(x, y, ["path"], ("a", "b"), ("c", "e"), bin_rows=rows)
    assert got.columns == ["path", "id", "a", "b", "c", "e", "content"]
    assert sorted((r.id, r.c, r.e, r.content) for r in got.collect()) == want
    semi = evidence.binned_overlap_join(x, y, ["path"], ("a", "b"), ("c", "e"), "left_semi", rows)
    held = sorted(i for p, i, a, b in left if any(p is not None and p == q and None not in (a, b, c, e) and a <= e and b >= c for q, c, e, _ in right))
    assert semi.columns == x.columns and sorted(r.id for r in semi.collect()) == held


def test_hot_path_is_many_bins(spark):
    """One path with all rows: its pairs come from many (path, bin) groups, none of them with a third of the rows."""
    right = spark.range(6000).selectExpr("'hot' AS path", "id * 3 AS c", "id * 3 + 2 AS e")
    left = spark.range(3000).selectExpr("'hot' AS path", "id", "id * 6 AS a", "id * 6 + 3 AS b")
    got = evidence.binned_overlap_join(left, right, ["path"], ("a", "b"), ("c", "e"), bin_rows=100)
    assert got.count() == 6000
    edges = right.groupBy("path").agg(F.percentile_approx("c", [0.25, 0.5, 0.75], 1000).alias("__edges"))
    sizes = right.join(edges, "path").withColumn("bin", evidence._bin("c")).groupBy("bin").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1700


def test_bins_in_parts():
    """Between two edges places are in parts, in order; a part is no narrower than the mean range, so long ranges are not written out many times."""
    edges, at = np.array([0.0, 1000.0, 1010.0, 5000.0]), np.array([-np.inf, -5, 0, 1, 500, 999, 1000, 1009, 1010, 4999, 5000, 9000, np.inf, np.nan])
    fine, coarse = evidence.bins_of(at, edges, 10.0), evidence.bins_of(at, edges, 4000.0)
    assert (np.diff(fine) >= 0).all() and (np.diff(coarse) >= 0).all()
    assert coarse.tolist() == [0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 4]
    assert len(set(evidence.bins_of(np.arange(0, 1000.0), edges, 10.0).tolist())) == evidence.PARTS
    assert evidence.bins_of(at, np.array([]), 1.0).tolist() == [0] * len(at)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double", "decimal(20,3)"])
def test_places_of_other_kinds(spark, kind):
    """Dates, times and fractions have bins as whole numbers have."""
    timed = kind.startswith("time") or kind == "date"
    place = lambda c: f"cast(date_add(DATE'2024-01-01', cast({c} as int)) as {kind})" if timed else f"cast(({c}) * 1.5 as {kind})"
    right = spark.range(400).selectExpr("'hot' AS path", f"{place('id * 3')} AS c", f"{place('id * 3 + 2')} AS e")
    left = spark.range(200).selectExpr("'hot' AS path", "id", f"{place('id * 6')} AS a", f"{place('id * 6 + 3')} AS b")
    got = evidence.binned_overlap_join(left, right, ["path"], ("a", "b"), ("c", "e"), bin_rows=50)
    assert got.count() == got.distinct().count() == 400


def test_content_digest(spark, tmp_path):
    rows = [(1, "a", {"x": 1}), (2, None, None), (2, None, None), (None, "", {})]
    df = spark.createDataFrame(rows, "k long, v string, m map<string,int>")
    same = spark.createDataFrame(rows[::-1], "k long, v string, m map<string,int>").repartition(3).select("m", "k", "v")
    assert tables.content_digest(df) == tables.content_digest(same)
    others = [rows[:3], [*rows, rows[0]], [(1, "a", {"x": 2}), *rows[1:]], [(None, "a", {"x": 1}), (1, None, None), (2, None, None), (2, "", {})], [(1, "a", {"x": 1}), (2, None, None), (2, "", None), (None, None, {})]]
    digests = {tables.content_digest(spark.createDataFrame(o, df.schema)) for o in others} | {tables.content_digest(df), tables.content_digest(df.withColumn("k", F.col("k").cast("int"))), tables.content_digest(df.withColumnRenamed("v", "w")), tables.content_digest(df.limit(0))}
    assert len(digests) == len(others) + 4
    made = []
    for inputs in (df, same, df.where("k = 1"), [df, same], [same, df]):
        tables.checkpointed(spark, f"file://{tmp_path}", "stage", inputs, lambda: made.append(1) or df.select("k"))
    assert len(made) == 3
