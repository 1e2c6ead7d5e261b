"""Chunks and regions of files: no shuffle, one row a file, and work dealt by what is made of rows."""

from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import chunks
from palimpsest.queries import base, repository


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark):
    return spark.createDataFrame([("a.py", "Python", "import x\ndef f(a):\n  pass"), ("a.py", "Python", "def g(a):\n  pass"), ("n", "Go", None), ("b", "None", "x\ny")], "path string, lang string, content string")


def test_files_never_meet(spark):
    f = _files(spark)
    for df in (chunks.regions(f), chunks.chunk_by_lines(f), chunks.lines_of(f)):
        assert "Exchange" not in _plan(df) and "Window" not in _plan(df)
    got = sorted((r.path, r.symbol, r.first, r.last) for r in chunks.regions(f).collect())
    assert got == [("a.py", "(imports)", 1, 1), ("a.py", "f", 2, 3), ("a.py", "g", 1, 2), ("b", "(imports)", 1, 2), ("n", "(imports)", 1, 1)]  # two files of one path are two files
    assert sorted((r.path, r.symbol, r.start_line) for r in chunks.chunk_by_lines(f).collect()) == [("a.py", "(imports), f", 1), ("a.py", "g", 1), ("b", None, 1)]


def test_declared_is_symbol(spark):
    """Marks by language, pattern first, are those of `symbol` line by line."""
    lines = ["def f(x):", "", "   ", "# def g():", "// func h()", "func h()", "export const i = 1", "class J {", "x" * 301, "def k(" + "x" * 300, "CREATE TABLE l (", "go() {", "int m(int a) {", "* fn n()", "pub fn n()", "def é():"]
    langs = [*rules.SYMBOLS, *rules.SYMBOL_ALIASES, "Other", None]
    one = spark.createDataFrame([(lang, "\n".join(lines)) for lang in langs], "lang string, content string").withColumn("path", F.lit("p"))
    got = {(r.lang, m["first"]): m["symbol"] for r in chunks._marked(one.withColumn("path", F.col("lang"))).select(F.col("path").alias("lang"), "marks").collect() for m in r.marks if m["symbol"] is not None}
    flat = one.select("lang", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    want = {(r.lang, r.i + 1): r.s for r in flat.select("lang", "i", chunks.symbol(F.col("line"), F.col("lang")).alias("s")).where("s IS NOT NULL").collect()}
    assert got == want and len({k[0] for k in want}) > 15


def test_files_are_dealt_by_rows(spark, tmp_path):
    """A table of kilobytes on disk is as many tasks as its files ask for."""
    spark.range(1, 10 * base.SPREAD_ROWS + 1).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parts = repository._code(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) < 2 * base.SPREAD_ROWS
