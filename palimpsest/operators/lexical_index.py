"""A 3-gram index for substring terms: which documents can hold a term, block by block, before any text is read.

Documents are numbered in the order of their id and cut into blocks of `BLOCK`. For each three characters of a lower-cased text the
postings have, block by block, the places of the documents that hold them. A term can only be in documents that hold all three-character runs of its
letters (`_` stands for any character and cuts the runs), so an intersection of postings gives each document an upper bound of its hits, and each
block its greatest one. Texts are then read by falling bound and, within a bound, by rising block, and each is tested with LIKE itself; the search
ends when the k-th best can't be passed: the next blocks have lower bounds, or the same and later ids. The answer is the scan's.

Terms without a run of three letters say nothing and count for every document's bound. Null texts are empty. Ids should be unique; null ids come first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored
from .retrieval import term_hits, terms_of
from .tables import numbered

BLOCK, GRAM = 1024, 3
#: Folders that the postings are stored in, by a hash of the three characters.
FOLDERS = 64
#: Blocks whose texts are read at first; each further step of a bound reads twice as many.
FIRST_BLOCKS = 16
_POSTINGS = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("places", pa.binary())])


@dataclass(frozen=True)
class LexicalIndex:
    """postings: folder, gram, block, n, places; texts: block, place, key, text."""

    postings: DataFrame
    texts: DataFrame
    key: str


@dataclass
class Report:
    """What a search read: rows of postings, and documents whose text was tested."""

    postings: int = 0
    tested: int = 0


def grams_of(term: str) -> set[str]:
    """The three-character runs of a term's letters."""
    return {run[i : i + GRAM] for run in re.split("[_%]", term) for i in range(len(run) - GRAM + 1)}


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Index every whole text."""
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = numbered(named, ["key"], "at").withColumns({"block": F.expr(f"at div {BLOCK}"), "place": F.expr(f"cast(at % {BLOCK} as int)")})
    texts = stored(placed.repartitionByRange("block").sortWithinPartitions("block", "place").select("block", "place", "key", "text"), "indexed-texts")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        holders: dict[str, list[int]] = {}

        def put() -> Iterator[pa.RecordBatch]:
            found = sorted(holders)
            for i in range(0, len(found), 20_000):
                some = found[i : i + 20_000]
                yield pa.RecordBatch.from_pydict({"gram": some, "block": [current] * len(some), "n": [len(holders[g]) for g in some], "places": [np.array(holders[g], "<u2").tobytes() for g in some]}, schema=_POSTINGS)

        for batch in batches:
            for block, place, low in zip(*(batch[c].to_pylist() for c in ("block", "place", "low")), strict=True):
                if block != current:
                    if holders:
                        yield from put()
                    current, holders = block, {}
                for gram in {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}:
                    holders.setdefault(gram, []).append(place)
        if holders:
            yield from put()

    ranged = texts.select("block", "place", F.lower("text").alias("low")).repartitionByRange("block").sortWithinPartitions("block", "place")
    postings = ranged.mapInArrow(post, "gram string, block long, n int, places binary")
    foldered = postings.withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")).repartition("folder").sortWithinPartitions("folder", "gram", "block")
    return LexicalIndex(stored(foldered.select("gram", "block", "n", "places", "folder"), "postings", "folder"), texts, key)


def bounds(index: LexicalIndex, terms: list[str]) -> tuple[DataFrame, int]:
    """block, bound, n, places: how many documents of each block can have so many hits, and which; and the rows of postings that were read."""
    times = Counter(terms)
    needs = {t: grams_of(t) for t in times}
    free = sum(times[t] for t, g in needs.items() if not g)
    asked = sorted(set().union(*needs.values())) if needs else []
    spark = index.postings.sparkSession
    folders = {r[0] for r in spark.createDataFrame([(g,) for g in asked], "g string").select(F.pmod(F.xxhash64("g"), F.lit(FOLDERS)).cast("int")).distinct().collect()} if asked else set()
    read = stored(index.postings.where(F.col("folder").isin(sorted(folders)) & F.col("gram").isin(asked)).select("gram", "block", "places"), "read-postings")
    sizes = stored(index.texts.groupBy("block").agg(F.count("*").alias("size")), "block-sizes")
    rows = sizes.join(read, "block", "left") if free else read.join(sizes, "block")

    def block(key: tuple, table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        held = {g: np.frombuffer(p, "<u2") for g, p in zip(table["gram"].to_pylist(), table["places"].to_pylist(), strict=True) if g is not None}
        hits = np.full(size, free, np.int32)
        for term, grams in needs.items():
            if grams and all(g in held for g in grams):
                seen = np.zeros(size, np.int32)
                for g in grams:
                    seen[held[g]] += 1
                hits[seen == len(grams)] += times[term]
        levels = sorted(set(hits.tolist()) - {0})
        places = [np.flatnonzero(hits == n).astype("<u2") for n in levels]
        return pa.Table.from_pydict({"block": [key[0].as_py()] * len(levels), "bound": levels, "n": [len(p) for p in places], "places": [p.tobytes() for p in places]}, schema=pa.schema([("block", pa.int64()), ("bound", pa.int32()), ("n", pa.int32()), ("places", pa.binary())]))

    return stored(rows.groupBy("block").applyInArrow(block, "block long, bound int, n int, places binary"), "bounds"), read.count()


def search(index: LexicalIndex, query: str, k: int) -> tuple[DataFrame, Report]:
    """key, hits of the k documents with most hits, at least one, ties by key; and what was read for it."""
    spark = index.texts.sparkSession
    terms = terms_of(spark, query)
    told = Report()
    limit, told.postings = bounds(index, terms)
    best: list[tuple[int, int, object, object]] = []  # -hits, block, order of the key, key: at most k
    levels = [r[0] for r in limit.select("bound").distinct().orderBy(F.desc("bound")).collect()]  # at most as many as there are terms
    kind = index.texts.schema["key"].dataType
    for level in levels:
        after, blocks = -1, FIRST_BLOCKS
        while True:
            if len(best) >= k and (-best[-1][0] > level):
                break
            some = limit.where((F.col("bound") == level) & (F.col("block") > after)).orderBy("block").limit(blocks)
            chosen = [r["block"] for r in some.select("block").collect()]
            if not chosen or (len(best) >= k and -best[-1][0] == level and best[-1][1] < chosen[0]):
                break
            rows = _members(index, limit.where((F.col("bound") == level) & F.col("block").between(chosen[0], chosen[-1])), chosen)
            tested = stored(rows.select("block", "key", term_hits(F.col("text"), terms).alias("hits")), "tested")
            told.tested += tested.count()
            found = tested.where("hits > 0").orderBy(F.desc("hits"), "key").limit(k).collect()
            best = sorted([*best, *((-r["hits"], r["block"], (r["key"] is not None, r["key"]), r["key"]) for r in found)], key=lambda b: (b[0], b[2]))[:k]
            after, blocks = chosen[-1], 2 * blocks
    answer = [(b[3], -b[0]) for b in best]
    return spark.createDataFrame(answer, T.StructType([T.StructField(index.key, kind), T.StructField("hits", T.IntegerType())])), told


def _members(index: LexicalIndex, bound: DataFrame, blocks: list[int]) -> DataFrame:
    """The texts of a range of blocks that stand at the places of `bound`."""
    texts = index.texts.where(F.col("block").between(blocks[0], blocks[-1]))

    def pick(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        places = np.frombuffer(right["places"][0].as_py(), "<u2") if right.num_rows else np.zeros(0, "<u2")
        return left.filter(pa.array(np.isin(left["place"].to_numpy(), places)))

    return texts.groupBy("block").cogroup(bound.groupBy("block")).applyInArrow(pick, texts.schema)
