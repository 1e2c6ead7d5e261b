"""Running sums, carried values, numbers and digests by ranges, where one key holds a third of all rows and more."""

import hashlib
import os
import random

import pytest

from palimpsest import sources
from palimpsest.operators import tables


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [("hot" if i % 2 else f"k{i % 7}", i, rng.choice([None, 1, 5, -2]), rng.choice([None, None, None, f"v{i}"])) for i in range(1500)]
    rng.shuffle(out)
    return out + [(None, 1, 3, "n"), (None, 2, None, None), ("lone", 1, None, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, n int, x int, v string").repartition(6)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_total(df, rows):
    want, sums = {}, {}
    for k, n, x, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        sums[k] = sums[k] if x is None and k in sums else x if sums.get(k) is None else sums[k] + x
        want[k, n] = sums[k]
    got = tables.running_total(df, "x", ["k"], ["n"], "total")
    assert got.columns == ["k", "n", "x", "v", "total"]
    assert {(r.k, r.n): r.total for r in got.collect()} == want
    parts = tables._ranged(df, ["k", "n"]).where("k = 'hot'").select("__range").distinct().count()
    assert parts > 2  # the hot key is several ranges


def test_last_known(df, rows):
    want, last = {}, {}
    for k, n, _, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        last[k] = v if v is not None else last.get(k)
        want[k, n] = last[k]
    from pyspark.sql import functions as F

    got = tables.last_known(df.where("k IS NOT NULL"), F.col("v"), ["k"], ["n"], "known")
    assert {(r.k, r.n): r.known for r in got.collect()} == want


def test_numbers(df, rows):
    got = sorted(tables.numbered(df, ["x", "n", "k"], "at").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(len(rows)))
    key = lambda r: tuple((v is not None, v) for v in (r[2], r[1], r[0]))
    assert [(r.x, r.n, r.k) for r in got] == [(r[2], r[1], r[0]) for r in sorted(rows, key=key)]


def test_line_digests(df, rows):
    lines = {}
    for k, _, _, v in rows:
        if v is not None:
            lines.setdefault(k, []).append(v)
    got = {r.k: (r.sha256, r.lines) for r in tables.line_digests(df, ["k"], "v").collect()}
    assert got == {k: (hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest(), len(x)) for k, x in lines.items()}
    assert tables.line_digests(df.limit(0), ["k"], "v").count() == 0


def test_tree(spark, tmp_path):
    """Several roots, deep and hidden folders, links to files and folders, empty folders and files."""
    for root in ("one", "two"):
        deep = "/".join(f"d{i}" for i in range(12))
        for path in ("a.txt", ".hidden/b.txt", f"{deep}/c.txt", "empty/"):
            os.makedirs(tmp_path / root / os.path.dirname(path), exist_ok=True)
            if not path.endswith("/"):
                (tmp_path / root / path).write_text(root + path)
        (tmp_path / root / "none").write_text("")
        os.symlink(tmp_path / root / "a.txt", tmp_path / root / "link")
        os.symlink(tmp_path / root / ".hidden", tmp_path / root / "folder")
    got = {(os.path.basename(r.root), r.path): (r.bytes, r.data and bytes(r.data).decode()) for r in sources.scan_tree(spark, str(tmp_path / "one"), f"file://{tmp_path}/two").collect()}
    want = {(root, p): (len(root + p), root + p) for root in ("one", "two") for p in ("a.txt", ".hidden/b.txt", f"{deep}/c.txt")}
    assert got == want | {(root, "none"): (0, None) for root in ("one", "two")}
    sources.write_tree(spark.createDataFrame([("x/y/z", b"1"), ("x/w", b""), ("v", None)], "path string, data binary"), f"file://{tmp_path}/made")
    assert {r.path: (r.bytes, r.data) for r in sources.scan_tree(spark, f"file://{tmp_path}/made").collect()} == {"x/y/z": (1, bytearray(b"1")), "x/w": (0, None), "v": (0, None)}
