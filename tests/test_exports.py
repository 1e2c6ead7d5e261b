"""Exported documents, byte by byte; and what is published when a task fails."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import exports

SETS = [(1, "My Set: A & B", "ann"), (2, "other", "bob"), (3, "empty one", "ann")]
ITEMS = [(1, 10, "security", "L2", "Why <b>?", "Because\nof & this", "t1"), (1, 5, "data-modeling", "L1", "First\tone", "yes", "t2"), (1, 20, "data-modeling", "L3", "Third", "no", "t3"), (2, 1, "security", "L1", "Hidden", "x", "t"), (9, 1, "security", "L1", "Lost", "x", "t"), (None, 1, "x", "L1", "None", "x", "t")]
WANT = {
    "my-set-a-b.md": "# My Set: A & B\n## Data modeling\n### 1. First\tone\n\nyes\n\n---\n### 2. Third\n\nno\n\n---\n## Security\n### 1. Why <b>?\n\nBecause\nof & this\n\n---\n",
    "my-set-a-b.tsv": "#separator:tab\n#html:true\n#tags column:3\nFirst one\tyes\tt2\nWhy &lt;b&gt;?\tBecause<br>of &amp; this\tt1\nThird\tno\tt3\n",
    "my-set-a-b.html": '<!doctype html><html><head><meta charset="utf-8"><title>My Set: A &amp; B</title></head><body><h1>My Set: A &amp; B</h1>\n<article><div class="meta">Data modeling · L1</div><h3>1. First\tone</h3><p>yes</p></article>\n'
    '<article><div class="meta">Security · L2</div><h3>2. Why &lt;b&gt;?</h3><p>Because<br>of &amp; this</p></article>\n<article><div class="meta">Data modeling · L3</div><h3>3. Third</h3><p>no</p></article>\n</body></html>\n',
    "empty-one.md": "# empty one\n", "empty-one.tsv": "#separator:tab\n#html:true\n#tags column:3\n",
    "empty-one.html": '<!doctype html><html><head><meta charset="utf-8"><title>empty one</title></head><body><h1>empty one</h1>\n</body></html>\n',
}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ITEMS, "set_id int, position int, category string, level string, stem string, answer string, tags string").repartition(3), spark.createDataFrame(SETS, "set_id int, title string, owner string")


def test_documents(spark, tables, tmp_path):
    items, sets = tables
    for kind in exports.FORMATS:
        exports.write_documents(exports.export_lines(items, sets, "ann", kind), f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(WANT)
    for name, text in WANT.items():
        assert (tmp_path / "out" / name).read_text() == text, name
    back = {}
    for r in exports.read_documents(spark, f"file://{tmp_path}/out").orderBy("name", "n").collect():
        back.setdefault(r.name, []).append(r.line)
    assert {n: "\n".join(x) + "\n" for n, x in back.items()} == WANT


def test_guard(spark, tables):
    items, sets = tables
    assert exports.export_lines(items, sets, "carl", "html").count() == 0
    assert {r.name for r in exports.export_lines(items, sets, "bob", "markdown").collect()} == {"other.md"}
    with pytest.raises(ValueError, match="no such format"):
        exports.export_lines(items, sets, "ann", "pdf")


def test_nothing_is_published_by_a_failed_job(spark, tmp_path):
    blocks = spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 8).cast("string")).alias("name"), F.lit(0).alias("section"), F.col("id").alias("place"), F.expr("CASE WHEN id = 37 THEN raise_error('broken') ELSE 'line ' || id END").alias("block"))
    with pytest.raises(Exception, match="broken"):
        exports.write_documents(blocks, f"file://{tmp_path}/out")
    left = os.listdir(tmp_path / "out") if (tmp_path / "out").exists() else []
    assert [f for f in left if not f.startswith("_")] == []
    exports.write_documents(blocks.where("id != 37"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "d5").read_text() == "line 5\nline 13\nline 21\nline 29\n"
