"""Audit of how sources differ in their words: counts behind a count-min prefilter, then sparse joins.

Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased. Each language keeps the terms that are in at least `LEAST` of its
documents (rows); with V kept terms and N occurrences of them in a group, a term has the smoothed share
p = 1 + floor(10^9 (count + 1) / (N + V)) there, and p and q diverge by f = floor((p - q)^2 / q).

1. Each task keeps a count-min sketch of the document frequencies of its (language, term) pairs, whose counters stop at LEAST, and
   puts out the cells that aren't zero in blocks; blocks are summed as they stream by. A merged counter is never below the
   pair's frequency, so a pair with a counter below LEAST can't be kept. What the driver and the tasks get is one bit a cell: at most
   DEPTH * MAX_WIDTH bits, 16 MB, whatever the input.
2. Texts are read again; each task counts its terms by source, drops those that the bits rule out, and only the rest are
   shuffled, by (language, term), and counted exactly.
3. For two sources of a language, f summed over all kept terms is V - |X| - |Y| times f of the two shares of a
   term that a source hasn't, plus one sum for each source over its own terms against the other's absent share, which takes
   that source's histogram of shares alone, plus a correction for the terms in both, found by a join on the term.

Divisions are of whole numbers. Null texts, languages and sources are ''. Document ids are not used: every row is a document, repeated ones
too. Equal values are ranked by item, in UTF-8 order. An empty table gives no rows. Columns other than text, lang and source are left
out, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import in_slices
from .common import materialise, text_of

LEAST, TOP = 3, 200
SCALE = 1_000_000_000
#: Rows of the sketch, and the bounds of their width: 16 cells a document, as a power of two.
DEPTH, MIN_WIDTH, MAX_WIDTH = 2, 1 << 16, 1 << 26
BLOCK = 1 << 16
#: Counted terms that a task holds before it puts them out.
HELD_TERMS = 400_000

#: Bytes of terms, A-Z lower-cased; all others become spaces, at which bytes.split cuts.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _cells(lang: str, found: list[bytes], width: int) -> np.ndarray:
    """(terms, DEPTH) cells of the sketch."""
    import xxhash

    head = lang.encode() + b"\0"
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(head + t) for t in found), ">u8").reshape(-1, DEPTH)
    return (hashes % np.uint64(width)).astype(np.int64) + np.arange(DEPTH) * width


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    texts = pc.cast(batch["text"], pa.binary()).to_pylist()
    for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts, strict=True):
        yield lang, source, terms(text)


def possible_terms(docs: DataFrame, width: int, least: int = LEAST) -> np.ndarray:
    """One bit a cell of the merged sketch: whether its counter reached `least`. docs: text, lang, source, never null."""
    kind = np.min_scalar_type(least)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(DEPTH * width, kind)
        held: dict[str, Counter] = defaultdict(Counter)

        def fold() -> None:
            for lang, counts in held.items():
                n = np.repeat(np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), least), DEPTH)
                cells, where = np.unique(_cells(lang, [*counts], width), return_inverse=True)
                sketch[cells] = np.minimum(sketch[cells] + np.bincount(where.ravel(), weights=n).astype(np.int64), least)
            held.clear()

        for batch in batches:
            for lang, _, found in _rows(batch):
                held[lang].update(set(found))
            if sum(map(len, held.values())) >= HELD_TERMS:
                fold()
        fold()
        for block in range(len(sketch) // BLOCK):
            part = sketch[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [part[at].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = sums.setdefault(row["block"], np.zeros(BLOCK, kind))
                at = np.frombuffer(row["at"], "<u2")
                own[at] = np.minimum(own[at].astype(np.int64) + np.frombuffer(row["n"], kind), least)
        for block, own in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": [np.packbits(own >= least, bitorder="little").tobytes()]})

    parts = docs.mapInArrow(in_slices(partial, "text"), "block int, at binary, n binary")
    merged = parts.repartition("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros((DEPTH * width // BLOCK, BLOCK // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def term_counts(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """lang, source, term, count, docs: partial counts of the terms that the sketch leaves."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # DEPTH * width bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def put() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, frequency) in held.items():
                found = [*counts]
                cells = _cells(lang, found, width)
                may = (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(axis=1)
                left = [t for t, m in zip(found, may.tolist(), strict=True) if m]
                for i in range(0, len(left), 20_000):
                    own = left[i : i + 20_000]
                    numbers = [pa.array([c[t] for t in own], pa.int64()) for c in (counts, frequency)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, found in _rows(batch):
                counts, frequency = held[lang, source]
                counts.update(found)
                frequency.update(set(found))
            if sum(len(c) for c, _ in held.values()) >= HELD_TERMS:
                yield from put()
        yield from put()

    return docs.mapInArrow(in_slices(count, "text"), "lang string, source string, term string, count long, docs long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); kept is never 0 here."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", scaled, (total + kept).cast("decimal(19,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by how far this source's shares are from that one's. Part `term`: the source's first `top`
    terms among those whose share is above the language's."""
    named = docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    width = min(MAX_WIDTH, max(MIN_WIDTH, 1 << (16 * docs.count() - 1).bit_length()))
    partial = term_counts(named, possible_terms(named, width, least), width)
    # One shuffle, by (lang, term): sums by source and over sources both find their rows together.
    exact = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = exact.withColumns({"all_docs": F.sum("docs").over(of_term), "all": F.sum("count").over(of_term), "one": (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")})
    kept = materialise(kept.where(F.col("all_docs") >= least).select("lang", "source", "term", "count", "all", "one"), "kept-terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"), F.sum("one").alias("ones"))
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "own", "ones"])
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "n", "own", F.sum("n").over(of_lang).alias("lang_n"), F.sum("ones").over(of_lang).alias("v"))
    absent = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1))))
    groups = materialise(groups.withColumn("absent", absent), "term-groups")  # one row a source of a language; a stored table's size is known to the planner

    shared = kept.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("count"), F.col("n"), F.col("v")), "q": _share(F.col("all"), F.col("lang_n"), F.col("v"))})
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return told.unionByName(_pairs(shared, groups).withColumn("rank", F.row_number().over(first)))


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value for every two sources of a language, both ways."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("absent").alias("item_absent"))
    both_ways = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    neither = F.coalesce((F.col("v") - F.col("own") - F.col("item_own")) * _apart(F.col("absent"), F.col("item_absent")), F.lit(0).cast("long"))
    parts = both_ways.select("lang", "source", "item", neither.alias("value"))

    # A source's own terms against the other's absent share, both ways.
    histogram = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    against = both_ways.select("lang", "source", "item", "item_absent").join(histogram, ["lang", "source"])
    against = against.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * _apart(F.col("p"), F.col("item_absent"))).alias("there"), F.sum(F.col("terms") * _apart(F.col("item_absent"), F.col("p"))).alias("back"))

    # Terms in both: their own value in place of what the sums above gave them.
    left = shared.select("lang", "term", "source", "p", "absent")
    right = shared.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("absent").alias("r_absent"))
    p, r, p0, r0 = F.col("p"), F.col("r"), F.col("absent"), F.col("r_absent")
    met = left.join(right, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(_apart(p, r) - _apart(p, r0) - _apart(p0, r) + _apart(p0, r0)).alias("there"),
        F.sum(_apart(r, p) - _apart(r0, p) - _apart(r, p0) + _apart(r0, p0)).alias("back"),
    )
    for sums in (against, met):
        turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
        parts = parts.unionByName(sums.select("lang", "source", "item", F.col("there").alias("value"))).unionByName(turned)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
