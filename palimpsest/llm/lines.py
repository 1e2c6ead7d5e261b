"""Line dedup over all documents, by range-partitioned line hashes.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys of at least `LEAST` code points that
are in two documents or more lose all their lines except in the smallest doc_id that holds the key.

Two 64-bit hashes stand for a key. The table of line hashes is dealt out by ranges of (hash, salt) and sorted by
document and position within them, and each run's first occurrence is streamed out; the salt, a part of the document's
hash, cuts the run of a very common line into runs of at most `RUN_ROWS` lines on average, since there are as many salts as
the table has multiples of that. The first occurrences of a key's salts are reduced to the least, and only runs
whose first one is not the least of all hear of it. Lines to drop become bitmaps: per document, an array of 64-line
words up to the last one with a dropped line. Texts are not part of any of this; `with_kept_text` joins them once.

A null or empty text is one empty line. Rows with a null doc_id keep all lines and hold none from others. Rows that share a
doc_id are one document: they drop nothing from each other. Repeated rows get the same bitmap. An empty table gives
no rows. Columns other than doc_id and text are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialise, pack_rest, text_of, unpack_rest

LEAST = 10
#: Lines of a run, at most, on average.
RUN_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["__line_h1", "__line_h2"]
_ROW = ["doc_id", "__line_row"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Two hashes, doc_id, row (a hash of the text, to tell rows with equal ids apart) and position of every line that is
    long enough."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(text_of()).alias("__line_row"), F.posexplode(_lines(text_of())).alias("__line_pos", "__line"))
    key = F.translate(F.btrim("__line", F.lit(WHITE)), _UPPER, _LOWER)
    keyed = rows.withColumn("__line_key", key).where(F.length("__line_key") >= least)
    return keyed.select(F.xxhash64("__line_key").alias("__line_h1"), F.xxhash64(F.lit(1), "__line_key").alias("__line_h2"), *_ROW, "__line_pos")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, __line_row, __line_drop: array of words of 64 lines, set bits are dropped lines; one row for each document
    that loses lines. Lines behind the last word stay."""
    stored = materialise(line_hashes(docs, least), "line-hashes")
    salts = max(1, -(-stored.count() // RUN_ROWS))
    hashes = stored.withColumn("__line_salt", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(salts)))
    run = [*_KEY, "__line_salt"]
    ranged = hashes.repartitionByRange(*run)
    order = Window.partitionBy(*run).orderBy("doc_id", "__line_pos")
    streamed = ranged.withColumn("__line_first", F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = hashes.groupBy(*run).agg(F.min("doc_id").alias("__line_first"))
    lowest = firsts.groupBy(*_KEY).agg(F.min("__line_first").alias("__line_least"), F.count("*").alias("__line_runs")).where("__line_runs > 1")
    late = firsts.join(lowest, _KEY).where(F.col("__line_first") > F.col("__line_least")).select(*run, F.lit(True).alias("__line_late"))
    flagged = streamed.join(late, run, "left").where(F.col("__line_late") | (F.col("doc_id") > F.col("__line_first")))
    word, bit = F.expr("__line_pos div 64"), F.expr("shiftleft(1L, __line_pos % 64)")
    words = flagged.groupBy(*_ROW, word.alias("__line_word")).agg(F.bit_or(bit).alias("__line_bits"))
    sparse = words.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("__line_word", "__line_bits"))).alias("w"))
    # Words between two that are there are zero: the array is as long as the last one's number, and each word has its place.
    dense = "flatten(transform(w, (x, i) -> concat(array_repeat(0L, cast(x.__line_word - coalesce(get(w, i - 1).__line_word, -1L) - 1 as int)), array(x.__line_bits))))"
    return sparse.select(*_ROW, F.expr(dense).alias("__line_drop"))


def _with_bitmaps(packed: DataFrame, bitmaps: DataFrame) -> DataFrame:
    joined = packed.withColumn("__line_row", F.xxhash64(text_of())).join(bitmaps, _ROW, "left")
    dropped = F.expr("coalesce(aggregate(__line_drop, 0L, (n, bits) -> n + bit_count(bits)), 0L)")
    stays = "coalesce(getbit(get(__line_drop, cast(i div 64 as int)), i % 64), 0) = 0"
    kept = F.expr(f"array_join(filter(split(text, '\\n', -1), (line, i) -> {stays}), '\\n')")
    n = F.length(text_of()) - F.length(F.replace(text_of(), F.lit("\n"), F.lit(""))) + 1
    return joined.withColumns({"__line_n": n.cast("long"), "__line_dropped": dropped, "__line_kept": F.when(F.col("__line_drop").isNull(), text_of()).otherwise(kept)})


def with_kept_text(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with __line_n (lines before), __line_dropped and __line_kept (the text that stays); columns of these names are replaced."""
    new = ["__line_n", "__line_dropped", "__line_kept"]
    own = docs.drop(*new)
    found = _with_bitmaps(pack_rest(own, "doc_id", "text"), keep_bitmaps(docs.select("doc_id", "text"), least))
    return found.select(*unpack_rest(own.columns, "doc_id", "text"), *new)


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the text that stays; a text that loses nothing is not touched."""
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), least)
    found = _with_bitmaps(pack_rest(docs, "doc_id", "text"), bitmaps)
    kept = F.when(F.col("__line_drop").isNull(), F.col("text")).otherwise(F.col("__line_kept"))
    return found.select(*unpack_rest(docs.columns, "doc_id", "text", instead={"text": kept}))
