"""Bounds of repositories: told for all of them, and kept by a run. Files that hold secrets."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest import queries, sources


def test_told_beyond_the_bounds_of_a_run(spark, tmp_path):
    """More files than a run reads are counted like others, and so are those without a source."""
    many = spark.range(sources.MAX_FILES + 1).select(F.lit("big").alias("source"), F.lit("é").alias("text"))
    few = spark.createDataFrame([("small", "abc"), (None, "ab"), (None, None)], "source string, text string")
    many.unionByName(few).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: (r.files, r.bytes, r.over) for r in queries.QUERIES["repository_limits"](spark, str(tmp_path)).collect()}
    assert got == {"big": (sources.MAX_FILES + 1, 2 * (sources.MAX_FILES + 1), "files"), "small": (1, 3, None), None: (2, 2, None)}


def test_run_within_limits(spark):
    files = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "source string, bytes int")
    assert sorted(r.bytes for r in sources.within_limits(files, ["source"], 2, 10).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="a has too many files"):
        sources.within_limits(files, ["source"], 1, 10).collect()


def test_collected_with_a_secret(spark, tmp_path):
    """The query tells of the file as it lies in the tree, the operator also of the redacted one."""
    text = "a = 1\n-----BEGIN RSA PRIVATE KEY-----\nMIIEabc\n-----END RSA PRIVATE KEY-----\nb = 2"
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["collected_files"](spark, str(tmp_path)).collect()
    assert [(r.path, r.loc, r.sha) for r in got] == [("a/src/f1.ts", 5, hashlib.sha256(text.encode()).hexdigest())]
    tree = spark.createDataFrame([("a/x.py", len(text), bytearray(text.encode()))], "path string, bytes long, data binary")
    r = sources.collect_files(tree).first()
    assert "BEGIN RSA" not in r.content and r.findings and r.loc == r.content.count("\n") + 1 and r.sha == hashlib.sha256(r.content.encode()).hexdigest()
    assert r.stored_loc == 5 and r.stored_sha == got[0].sha
