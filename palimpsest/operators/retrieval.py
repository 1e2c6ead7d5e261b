"""Hybrid retrieval: lexical hits and vector distance, each ranked, fused by reciprocal rank."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import rules
from ..functions.text import query_terms
from ..functions.vectors import dot
from ..shared import stored


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms (repeats count) the lower-cased text is LIKE; _ in a term is a wildcard; null text is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for t in terms:
        out = out + F.when(low.like(f"%{t}%"), 1).otherwise(0)
    return out


def terms_of(spark, query: str) -> list[str]:
    return spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]


def lexical_topk(docs: DataFrame, query: str, k: int, text: str = "text", ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k documents with most hits, at least one; adds hits. Only k rows reach the last task (TakeOrderedAndProject)."""
    hits = term_hits(F.col(text), terms_of(docs.sparkSession, query))
    return docs.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), *ties).limit(k)


#: Bounds of what a task takes of its texts at a time (rows, bytes), of a pack of terms, of the distinct terms and the queries of a pass over the texts, and of the word runs that a task remembers.
BLOCK_TEXTS, BLOCK_CHARS, PACK_TERMS, PASS_TERMS, BLOCK_QUERIES, KNOWN_RUNS = 1024, 1 << 22, 1024, 1 << 20, 1 << 19, 1 << 19
#: Bounds of a block of documents that meets all queries of a pass (documents, numbered in 16 bits; terms of documents), of its bitmaps (bytes), of queries whose finds are merged at a time, and of numbers in an array on the way there.
BLOCK_DOCS, BLOCK_HELD, BITMAP_BYTES, MERGED, CELLS = 1 << 16, 1 << 24, 1 << 26, 16_384, 1 << 20


class Best:
    """The k best finds so far of each of n queries: the highest score first, then the smallest key (null before all). A score is above `none`.

    score, at: a row a query; `at` is a key's place among `keys`, which are sorted, so that keys of any type are compared as numbers.
    """

    def __init__(self, n: int, k: int, kind: pa.DataType, score: type, none: float):
        self.none, self.keys = none, pa.array([], kind)
        self.score, self.at = np.full((n, k), none, score), np.full((n, k), -1, np.int32)

    def enter(self, keys: pa.Array) -> np.ndarray:
        """The places of more keys; those that no query has any longer are forgotten."""
        found = self.at >= 0
        used, places = np.unique(self.at[found], return_inverse=True)
        every = pa.concat_arrays([self.keys.take(pa.array(used)), keys.cast(self.keys.type)])
        rank = pc.rank(every, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int32) - 1
        first = np.zeros(rank.max(initial=-1) + 1, np.int64)
        first[rank] = np.arange(len(rank))
        self.keys = every.take(pa.array(first))
        self.at[found] = rank[: len(used)][places]
        return rank[len(used) :]

    def add(self, rows: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(rows)
        i, j = np.nonzero(self.at[own] >= 0)
        rows, at, score = np.concatenate([own[i], rows]), np.concatenate([self.at[own][i, j], at]), np.concatenate([self.score[own][i, j], score])
        order = np.lexsort((at, -score.astype(np.float64), rows))
        rows, at, score = rows[order], at[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.at.shape[1]
        self.at[own], self.score[own] = -1, self.none
        self.at[rows[best], place[best]], self.score[rows[best], place[best]] = at[best], score[best]

    def finds(self, most: int = 65_536) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """Queries (their numbers), keys and scores."""
        i, j = np.nonzero(self.at >= 0)
        for a in range(0, len(i), most):
            own = i[a : a + most], j[a : a + most]
            yield pa.array(own[0]), self.keys.take(pa.array(self.at[own])), pa.array(self.score[own])


def few_tasks(rows: DataFrame) -> DataFrame:
    """rows in about as many tasks as there are cores, where each task gives back what it finds for every query: files as they lie where they are many and even, or else dealt anew."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]  # one row a task of the scan
    return rows.repartition(cores) if max(counts, default=0) * cores > 2 * sum(counts) else rows.coalesce(cores)


def lexical_topk_many(docs: DataFrame, queries: DataFrame, k: int, key: str = "query", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc, hits, rank: `lexical_topk` for each row of queries (key, text).

    A pass reads every text once, where it lies, against all distinct terms of up to `BLOCK_QUERIES` queries (`held_terms`); terms and queries of a pass are shared with the tasks. Documents, as lists
    of terms, meet its queries in the same tasks, block by block, and a task gives back k rows a query, so what is shuffled grows with the queries, not with the documents. Queries without terms have no rows.
    """
    spark, qtype, dtype = docs.sparkSession, queries.schema[key].dataType, docs.schema[doc].dataType
    asked = stored(queries.select(F.col(key).alias("q"), query_terms(F.col(text)).alias("terms")).where(F.size("terms") > 0).withColumn("u", F.monotonically_increasing_id()), "queries")
    parts = max(1, -(-asked.count() // BLOCK_QUERIES))
    part = lambda n: F.pmod(F.xxhash64("u"), F.lit(n)).cast("int")
    while asked.select(part(parts).alias("part"), F.explode("terms")).distinct().groupBy("part").count().where(F.col("count") > PASS_TERMS).take(1):
        parts *= 2
    texts = few_tasks(docs.select(F.col(doc).alias("d"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")))
    fields = T.StructType([T.StructField(key, qtype), T.StructField(doc, dtype), T.StructField("hits", T.IntegerType())])
    schema = to_arrow_schema(fields)

    def one_pass(own: DataFrame) -> DataFrame:
        words = own.select(F.explode("terms").alias("term")).distinct()
        pack = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-words.count() // PACK_TERMS)))).cast("int")
        packs = stored(words.groupBy(pack.alias("pack")).agg(F.collect_list("term").alias("terms")), "packs")
        width = packs.agg(F.max(F.size("terms"))).first()[0] or 1
        numbers = packs.select("pack", F.posexplode("terms").alias("at", "term")).select("term", (F.col("pack") * width + F.col("at")).alias("id"))
        sought = own.select("u", "q", F.explode("terms").alias("term")).join(numbers, "term").groupBy("u").agg(F.first("q").alias("q"), F.collect_list("id").alias("ids")).select("q", "ids").toArrow().combine_chunks()
        ids = pc.list_flatten(sought["ids"]).to_numpy().astype(np.int32)
        ends = np.cumsum([0, *pc.list_value_length(sought["ids"]).to_pylist()])
        shared = spark.sparkContext.broadcast((sought["q"].combine_chunks().cast(schema.field(key).type), ids, ends))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ids, ends = shared.value
            best = Best(len(names), k, schema.field(doc).type, np.uint8, 0)  # a query has 12 terms at most
            for block in _blocks(batches, BLOCK_DOCS, BLOCK_HELD):
                _meet(block, ids, ends, best, k)
            for i, found, hits in best.finds():
                yield pa.RecordBatch.from_arrays([names.take(i), found, hits.cast(pa.int32())], schema=schema)

        return held_terms(texts, packs, width).mapInArrow(meet, fields)

    found = one_pass(asked.where(part(parts) == 0))
    for n in range(1, parts):
        found = found.unionByName(one_pass(asked.where(part(parts) == n)))
    order = Window.partitionBy(key).orderBy(F.desc("hits"), doc)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, items: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches (d, ids) put together, until they have that many rows or ids; the first blocks are smaller, so that most documents come when queries have finds already."""
    some, n, held, share = [], 0, 0, 16
    for batch in batches:
        step = min(BLOCK_TEXTS, rows)
        for a in range(0, len(batch), step):
            own = batch.slice(a, step)
            if n and n + len(own) > max(1, rows // share):
                yield some
                some, n, held, share = [], 0, 0, max(1, share // 4)
            some.append(own)
            n, held = n + len(own), held + len(pc.list_flatten(own.column(1)))
            if held >= items // share:
                yield some
                some, n, held, share = [], 0, 0, max(1, share // 4)
    if n:
        yield some


class _Block:
    """Documents (batches of d, ids) by the terms that they hold: term t is held by counts[t] documents, whose numbers are at[starts[t]:starts[t + 1]], ascending. Frequent terms have a bitmap, too."""

    def __init__(self, batches: list[pa.RecordBatch], terms: int):
        flat = [pc.list_flatten(b.column(1)).to_numpy() for b in batches]
        self.n = sum(map(len, batches))
        self.counts = sum(np.bincount(ids, minlength=terms) for ids in flat)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.at, free, first = np.empty(self.starts[-1], np.uint16), self.starts[:-1].copy(), 0
        for batch, ids in zip(batches, flat, strict=True):
            pairs = ids.astype(np.int64) << 16 | np.repeat(np.arange(first, first + len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
            pairs.sort()
            here = np.bincount(ids, minlength=terms)
            self.at[np.repeat(free - np.cumsum(here) + here, here) + np.arange(len(pairs))] = pairs & 0xFFFF
            free += here
            first += len(batch)
        width = -(-self.n // 8)
        frequent = np.argsort(-self.counts, kind="stable")[: max(1, BITMAP_BYTES // width)]
        frequent = frequent[self.counts[frequent] > 0]
        self.slot = np.full(terms, -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        self.bits = np.empty((len(frequent), width), np.uint8)
        step = max(1, CELLS // self.n)
        for low in range(0, len(frequent), step):
            which, docs = self.documents(frequent[low : low + step])
            row = np.zeros((min(step, len(frequent) - low), width * 8), np.uint8)
            row[which, docs] = 1
            self.bits[low : low + step] = np.packbits(row, axis=1, bitorder="little")

    def documents(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of each of these terms: which of the terms, and the document."""
        n = self.counts[terms]
        to = np.arange(n.sum()) + np.repeat(self.starts[terms] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(terms)), n), self.at[to].astype(np.int64)

    def holds(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each document holds the term beside it."""
        slot = self.slot[terms]
        found = (self.bits[slot, docs >> 3] >> (docs & 7).astype(np.uint8) & 1).astype(bool)
        rare = np.flatnonzero(slot < 0)
        if len(rare):  # by bisection
            terms, docs = terms[rare], docs[rare]
            low, high, end = self.starts[terms], self.starts[terms + 1], self.starts[terms + 1]
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                less = open_ & (self.at[np.minimum(middle, len(self.at) - 1)] < docs)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            found[rare] = (low < end) & (self.at[np.minimum(low, len(self.at) - 1)] == docs)
        return found


def _meet(batches: list[pa.RecordBatch], ids: np.ndarray, ends: np.ndarray, best: Best, k: int) -> None:
    """Add the finds of a block of documents (d, ids) to the best of each query, whose terms are ids[ends[i]:ends[i + 1]].

    A query that has k finds already wants documents with more hits than the last of them, or as many and a smaller key. So it is enough to look at those that hold one of its rarest terms: a document
    without any of them has too few hits. Queries whose rarest terms are in many documents count the hits of all.
    """
    places = best.enter(pa.concat_arrays([b.column(0) for b in batches]))
    block = _Block(batches, int(ids.max(initial=0)) + 1)
    n, earliest = block.n, places.min()
    rank = np.empty(n, np.int64)
    rank[np.argsort(places, kind="stable")] = np.arange(n)
    width = int(np.diff(ends).max(initial=0))
    for low in range(0, len(ends) - 1, MERGED):
        cut = ends[low : low + MERGED + 1]
        lengths = np.diff(cut)
        terms = np.full((len(lengths), width), -1, np.int64)
        terms[np.arange(width) < lengths[:, None]] = ids[cut[0] : cut[-1]]
        df = np.where(terms >= 0, block.counts[terms], 0)
        order = np.argsort(np.where(df, df, n + 1), axis=1, kind="stable")  # the rarest first, those that no document holds last
        terms, df = np.take_along_axis(terms, order, 1), np.take_along_axis(df, order, 1)
        held = (df > 0).sum(axis=1)
        floor, last = best.score[low : low + MERGED, -1].astype(np.int64), best.at[low : low + MERGED, -1]
        least = np.where(floor > 0, floor + (earliest >= last), 1)
        rare = held - least + 1
        by_rare, by_all = np.where(np.arange(width) < rare[:, None], df, 0).sum(axis=1), df.sum(axis=1)
        count_all = (rare > 0) & (by_rare * 8 > by_all + n)  # whichever is less work
        found = []
        some = np.flatnonzero(count_all)
        for a in range(0, len(some), max(1, CELLS // n)):
            own = some[a : a + max(1, CELLS // n)]
            found.append(_by_count(block, own, terms[own], df[own], least[own], rank, k))
        some = np.flatnonzero((rare > 0) & ~count_all)
        for own in np.split(some, np.flatnonzero(np.diff(np.cumsum(by_rare[some]) // CELLS)) + 1):
            if len(own):
                found.append(_by_rarest(block, own, terms, held, least, rare, rank, k))
        if found:
            rows, docs, hits = (np.concatenate(c) for c in zip(*found, strict=True))
            best.add(rows + low, places[docs], hits.astype(np.uint8))


def _by_count(block: _Block, own: np.ndarray, terms: np.ndarray, df: np.ndarray, least: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (own), documents and hits: the k best of the documents with at least so many."""
    i, j = np.nonzero(df)
    which, docs = block.documents(terms[i, j])
    n = block.n
    hits = np.bincount(i[which] * n + docs, minlength=len(own) * n).reshape(len(own), n)
    top = np.argpartition((hits * n + (n - 1 - rank)).astype(np.int32), n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), hits.shape)
    hits = np.take_along_axis(hits, top, 1)
    i, j = np.nonzero(hits >= least[:, None])
    return own[i], top[i, j], hits[i, j]


def _by_rarest(block: _Block, own: np.ndarray, terms: np.ndarray, held: np.ndarray, least: np.ndarray, rare: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (own), documents and hits: the k best of the documents with at least so many, from those of each of the rarest terms, and held against the terms after it as long as these can be enough."""
    i, j = np.nonzero(np.arange(terms.shape[1]) < rare[own][:, None])
    which, docs = block.documents(terms[own[i], j])
    row, place = own[i][which], j[which]
    hits, left, done = np.ones(len(row), np.int64), held[row] - 1 - place, []
    while len(row):
        able = hits + left >= least[row]
        over = able & (left == 0)
        done.append((row[over], docs[over], hits[over]))
        able &= ~over
        row, docs, hits, left, place = row[able], docs[able], hits[able], left[able] - 1, place[able] + 1
        hits += block.holds(terms[row, place], docs)
    row, docs, hits = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (own[:0], own[:0], own[:0])
    order = np.lexsort((-hits, docs, row))  # a document may come by several terms, and from the first of them with all its hits
    row, docs, hits = row[order], docs[order], hits[order]
    first = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(docs) != 0)])[: len(row)]
    row, docs, hits = row[first], docs[first], hits[first]
    order = np.lexsort((rank[docs], -hits, row))
    row, docs, hits = row[order], docs[order], hits[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], docs[best], hits[best]


def held_terms(texts: DataFrame, packs: DataFrame, width: int) -> DataFrame:
    """d, ids: the terms that each text (d, t; lower-cased) is LIKE, where it is LIKE any. packs: pack, terms, at most `PASS_TERMS` or so together, which are shared with the tasks; the id of a term is pack * width + its place.

    A term of letters and digits lies within a run of them, so only distinct runs are sought through, by their substrings as long as terms are. Terms with _, a wildcard, are sought in the texts.
    """
    told = {t: r["pack"] * width + at for r in packs.collect() for at, t in enumerate(r["terms"])}
    shared = texts.sparkSession.sparkContext.broadcast(told)
    fields = T.StructType([T.StructField("d", texts.schema["d"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(fields)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        wild = [(re.compile(".".join(map(re.escape, t.split("_"))), re.S).search, i) for t, i in terms.items() if "_" in t]
        known = _Runs({t: i for t, i in terms.items() if "_" not in t})
        for batch in _cut(batches):
            doc, ids = known.held(batch.column(1))
            if wild:
                more = [(row, i) for row, t in enumerate(batch.column(1).to_pylist()) for seek, i in wild if seek(t)]
                doc, ids = (np.concatenate([one, np.array([m[at] for m in more], np.int64)]) for at, one in enumerate((doc, ids)))
                order = np.argsort(doc, kind="stable")
                doc, ids = doc[order], ids[order]
            n = np.bincount(doc, minlength=len(batch))
            rows = np.flatnonzero(n)
            if len(rows):
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n[rows]]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists.cast(schema.field("ids").type)], schema=schema)

    return texts.select("d", "t").mapInArrow(hold, fields)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a key and a text cut at `BLOCK_TEXTS` rows and about `BLOCK_CHARS` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        ends = [*np.flatnonzero(np.diff(size // BLOCK_CHARS)) + 1, len(batch)]
        for low, high in zip([0, *ends], ends, strict=False):
            for a in range(low, high, BLOCK_TEXTS):
                yield batch.slice(a, min(BLOCK_TEXTS, high - a))


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = high.astype(np.int64) << 32 | low
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
    return pairs >> 32, pairs & 0xFFFFFFFF


_PLAIN = np.array([b if chr(b).isascii() and (chr(b).isdigit() or chr(b).islower()) else 32 for b in range(256)], np.uint8)


def _plain(texts: pa.Array) -> pa.Array:
    """texts with a blank for each byte that is no letter a-z or digit."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = _PLAIN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(data))


class _Runs:
    """The terms (letters and digits; with their ids) inside runs of letters and digits, remembered for up to `KNOWN_RUNS` runs."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.runs = terms, {}
        self.lengths = {len(t) for t in terms}
        self.marks = np.zeros(1 << 24, bool)  # of hashes of terms: most pieces of runs are none, and only others are looked up
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        for length, _, marks in self._pieces(list(terms)):
            self.marks[marks[size[self.which] == length]] = True

    def _pieces(self, runs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of terms: the pieces so long of all runs, by their place in the run, and their hashes; `self.which` has their runs."""
        n = np.fromiter(map(len, runs), np.int64, len(runs))
        letters = np.frombuffer("".join(runs).encode(), np.uint8)
        which = np.repeat(np.arange(len(runs)), n)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(n) - n, n)
        left, start, mark = n[which] - place, np.arange(len(letters)), np.zeros(len(letters), np.uint64)
        for length in range(1, max(self.lengths, default=0) + 1):
            fits = left >= length
            left, start, mark = left[fits], start[fits], mark[fits]
            mark = (mark + letters[start + length - 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mark ^= mark >> np.uint64(29)
            if length in self.lengths:
                self.which = which[start]
                yield length, place[start], mark >> np.uint64(40)

    def _seek(self, runs: list[str]) -> None:
        found: list[set[int]] = [set() for _ in runs]
        for length, place, marks in self._pieces(runs):
            some = np.flatnonzero(self.marks[marks])
            for i, a in zip(self.which[some].tolist(), place[some].tolist(), strict=True):
                term = self.terms.get(runs[i][a : a + length])
                if term is not None:
                    found[i].add(term)
        self.runs.update(zip(runs, map(tuple, found), strict=True))

    def held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts and ids of the terms in them, each pair once, by text."""
        words = pc.ascii_split_whitespace(_plain(texts))
        coded = pc.list_flatten(words).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.runs) > KNOWN_RUNS:
            self.runs.clear()
        new = list(filterfalse(self.runs.__contains__, names))
        if new:
            self._seek(new)
        told = list(map(self.runs.__getitem__, names))
        n = np.fromiter(map(len, told), np.int64, len(told))
        ids, starts = np.fromiter(chain.from_iterable(told), np.int64, int(n.sum())), np.cumsum(n) - n
        doc, run = _distinct(np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False)), coded.indices.to_numpy())
        n = n[run]
        return _distinct(np.repeat(doc, n), ids[np.repeat(starts[run] - np.cumsum(n) + n, n) + np.arange(n.sum())])


def vector_topk(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", ties: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The k nearest by cosine of unit vectors; adds similarity. Null vectors are not found."""
    near = dot(F.col(vector), F.lit(query))
    return vectors.where(F.col(vector).isNotNull()).withColumn("similarity", F.round(near, 6)).orderBy(F.desc("similarity"), *ties).limit(k)


def fuse(rankings: list[DataFrame], key: str, limit: int, k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) tables: sum of 1 / (k + rank), the highest first, ties by key."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    scored = every.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(limit)


def ranked(top: DataFrame, *order: Column | str) -> DataFrame:
    """Add rank to a table that a limit has made small."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid_many(docs: DataFrame, index, queries: DataFrame, limit: int = 12, key: str = "query", doc: str = "doc_id") -> DataFrame:
    """key, doc, score, rank: hybrid retrieval for each row of queries (key, text, embedding): the top 2 * limit of either branch, fused by reciprocal rank. `index`: a vector
    index of the documents, under the same ids."""
    from .vector_index import search_many

    words = lexical_topk_many(docs, queries, 2 * limit, key, doc).select(key, F.col(doc).alias("__doc"), "rank")
    near = search_many(index, queries, 2 * limit, key).select(key, F.col(index.key).alias("__doc"), "rank")
    fused = words.unionByName(near).groupBy(key, "__doc").agg(F.round(F.sum(F.lit(1.0) / (rules.RRF_K + F.col("rank"))), 6).alias("score"))
    ranks = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "__doc"))
    return fused.withColumn("rank", ranks).where(F.col("rank") <= limit).select(key, F.col("__doc").alias(doc), "score", "rank")


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 12) -> DataFrame:
    """doc_id, score: the top 2 * limit of either branch, fused."""
    words = ranked(lexical_topk(docs.select("doc_id", "text"), query, 2 * limit), F.desc("hits"), "doc_id")
    near = ranked(vector_topk(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), query_vector, 2 * limit, ties=("doc_id",)), F.desc("similarity"), "doc_id")
    return fuse([near, words], "doc_id", limit)
