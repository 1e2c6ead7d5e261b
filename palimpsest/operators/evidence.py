"""Citations against stored ranges, verdict gates, greedy de-dup, rank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored
from .vector_index import near_nodes


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of equal keys whose closed ranges overlap: an equi-join (hash or sort-merge, Spark's choice) with the range as
    residual condition, so that a shuffle by key serves it and skewed keys can be split."""
    on = [left[k] == right[k] for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond & (left[span[0]] <= right[other[1]]) & (left[span[1]] >= right[other[0]]), how)


#: A key with more ranges than this is cut into bins of about so many.
BIN_ROWS = 10_000
#: Bins of a key, at most, before they are cut into parts.
MAX_BINS = 4096
#: Parts that a bin is cut into, at most: in a part every range of the left meets every one of the right.
PARTS = 64


def binned_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str], how: str = "inner", bin_rows: int = BIN_ROWS) -> DataFrame:
    """Rows of equal keys whose closed ranges overlap, where one key may hold a third of all rows: `overlap_join` for most keys, bins for the hot ones.

    A hot key's line of places is cut at quantiles of the starts on the right into bins, and those into parts (`bins_of`); a range is in every part that it meets, and rows join by key and part. Edges are
    shared with the tasks, not carried in rows, whose width would grow with the table. A pair is
    reported in the first bin that both are in, the one in which the later of them starts. Bins are tables' rows like keys, so a hot key
    is as many tasks as it has bins. The result has the columns of both sides (of the left alone where how is left_semi); the right's keys are left out.
    """
    own = [c for c in right.columns if c not in keys]

    def plainly(some: DataFrame) -> DataFrame:
        met = overlap_join(some, right, keys, span, other, how)
        return met if how == "left_semi" else met.select(*[some[c] for c in left.columns], *[right[c] for c in own])

    large = stored(right.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > bin_rows), "hot-keys")
    if large.isEmpty():
        return plainly(left)
    left_at, right_at = _places(left, span), _places(right, other)
    quantiles = F.percentile_approx(right_at[0], [(i + 1) / MAX_BINS for i in range(MAX_BINS - 1)], 4 * MAX_BINS)
    some = F.expr(f"filter(__q, (q, i) -> (i + 1) % greatest(1, cast({MAX_BINS * bin_rows}L div __n as int)) = 0)")
    width = lambda at: F.avg(F.greatest(at[1] - at[0], F.lit(0.0)))
    counted = right.join(large.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("__n"), quantiles.alias("__q"), width(right_at).alias("__wide"))
    found = stored(counted.select(*keys, "__wide", F.array_sort(F.array_distinct(some)).alias("__edges")), "hot-edges")
    wide = left.join(F.broadcast(found.select(*keys)), keys, "left_semi").groupBy(*keys).agg(width(left_at).alias("__wider"))
    hot = stored(found.join(wide, keys, "left").select(*keys, F.monotonically_increasing_id().alias("__hot"), "__edges", F.greatest("__wide", "__wider").alias("__wide")), "hot-keys")
    # At most one edge for each bin_rows of the right, and 4096 a key.
    edges = left.sparkSession.sparkContext.broadcast({r["__hot"]: (np.array(r["__edges"] or [], np.float64), r["__wide"] or 0.0) for r in hot.select("__hot", "__edges", "__wide").collect()})
    plain = plainly(left.join(hot.select(*keys), keys, "left_anti"))
    named = F.broadcast(hot.select(*keys, "__hot"))
    x, y = left.withColumns({"__low": left_at[0], "__high": left_at[1]}).join(named, keys).withColumn("__id", F.monotonically_increasing_id()), right.withColumns({"__low": right_at[0], "__high": right_at[1]}).join(named, keys)
    binned = lambda df: _binned(df, edges).withColumn("__bin", F.explode(F.sequence("__low", F.greatest("__low", "__high")))).drop("__hot", "__high")
    x, y = binned(x).withColumnRenamed("__low", "__from"), binned(y)
    on = [x[c] == y[c] for c in [*keys, "__bin"]] + [x[span[0]] <= y[other[1]], x[span[1]] >= y[other[0]]]
    if how == "left_semi":
        met = x.join(y, reduce(lambda a, b: a & b, on), "left_semi")
        return plain.unionByName(met.dropDuplicates(["__id"]).select(*left.columns))
    met = x.join(y, reduce(lambda a, b: a & b, [*on, x["__bin"] == F.greatest("__from", "__low")]))
    return plain.unionByName(met.select(*[x[c] for c in left.columns], *[y[c] for c in own]))


def _places(df: DataFrame, span: tuple[str, str]) -> list[Column]:
    """Both ends as doubles: what is rounded keeps its order, which is all that bins need."""
    asked = {"date": "cast(unix_date(`{}`) as double)", "timestamp": "cast(unix_micros(`{}`) as double)", "timestamp_ntz": "cast(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{}`) as double)"}
    return [F.expr(asked.get(dict(df.dtypes)[c], "cast(`{}` as double)").format(c)) for c in span]


def bins_of(at: np.ndarray, edges: np.ndarray, wide: float) -> np.ndarray:
    """The bins of places: how many edges are up to each, and between two edges as many equal parts, up to `PARTS`, as leave a part no narrower than
    the mean range. They rise with the places. NaN is behind all."""
    bins = np.searchsorted(edges, at, "right")
    mean = (edges[-1] - edges[0]) / (len(edges) - 1) if len(edges) > 1 else np.nan
    if not np.isfinite(mean):
        return bins
    parts = int(min(PARTS, max(1.0, mean // wide if wide > 0 else PARTS))) if wide < np.inf else 1
    inside = (bins > 0) & (bins < len(edges))
    part = np.zeros(len(at), np.int64)
    low, high = edges[bins[inside] - 1], edges[bins[inside]]
    part[inside] = np.minimum((at[inside] - low) / (high - low) * parts, parts - 1)
    return bins * parts + part


def _binned(df: DataFrame, edges: Broadcast) -> DataFrame:
    """df with __low and __high as the numbers of bins of its __hot key. A place that is null is in the first."""
    at, low, high = (df.columns.index(c) for c in ("__hot", "__low", "__high"))
    schema = T.StructType([T.StructField(f.name, T.IntegerType()) if f.name in ("__low", "__high") else f for f in df.schema.fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(hot, kind="stable")
            columns = list(batch.columns)
            for c in (low, high):
                places, bins = pc.fill_null(batch.column(c), -np.inf).to_numpy(zero_copy_only=False), np.zeros(len(hot), np.int32)
                for rows in np.split(order, np.flatnonzero(np.diff(hot[order])) + 1) if len(hot) else ():
                    bins[rows] = bins_of(places[rows], *edges.value[int(hot[rows[0]])])
                columns[c] = pa.array(bins)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(step, schema)


def _bin(at: str) -> Column:
    """How many edges are up to a place, by halving, where __edges are in the row; `bins_of` is the same for whole batches."""
    steps = ", ".join(str(1 << i) for i in reversed(range(MAX_BINS.bit_length())))
    return F.expr(f"aggregate(array({steps}), 0, (i, s) -> if(i + s <= size(__edges) AND get(__edges, i + s - 1) <= `{at}`, i + s, i))")


def resolve(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citation_id, start_line, end_line, content: the chunks that a citation's lines overlap, joined in order."""
    named = chunks.select("snapshot", "path", F.col("start_line").alias("__a"), F.col("end_line").alias("__b"), "content")
    met = binned_overlap_join(citations.select("citation_id", "snapshot", "path", "start_line", "end_line"), named, ["snapshot", "path"], ("start_line", "end_line"), ("__a", "__b"))
    parts = met.groupBy("citation_id").agg(F.array_sort(F.collect_list(F.struct(F.col("__a").alias("start_line"), F.col("__b").alias("end_line"), "content"))).alias("p"))
    return parts.select("citation_id", F.col("p")[0]["start_line"].alias("start_line"), F.element_at("p", -1)["end_line"].alias("end_line"), F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("content"))


def verdict(grounded: Column, supported: Column, corrected: Column, least: float = 0.5) -> Column:
    """kept or unsupported: dropped below the least groundedness, or if neither supported nor corrected."""
    return F.when((grounded < least) | (~supported & corrected.isNull()), F.lit("unsupported")).otherwise(F.lit("kept"))


def greedy_dedupe(items: DataFrame, key: str, vector: str, order: list[Column | str], threshold: float, within: list[str] | None = None) -> DataFrame:
    """Keep an item iff its cosine with every item kept before it is at most the threshold.

    Of items with equal vectors only the first can be kept (where the vector's own product is above the threshold), so one row stands for
    them. Pairs above the threshold are found first, in parallel (`near_nodes`), with the place of both in the order. Then rounds of joins over
    these pairs decide: an item whose earlier neighbours are all dropped is kept, one with a kept earlier neighbour is dropped. Each round
    decides at least the first open item of every chain, and is a table in the shared folder, so nothing is folded in
    one task. `order` is of values that rise; `within` names columns that cut the items into independent groups; keys must be unique.
    """
    keys = within or []
    at = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate([*order, key])))
    ranked = items.select(*keys, F.col(key).alias("__key"), F.col(vector).alias("__vector"), at.alias("__at"))
    own = F.aggregate("__vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    alike = ranked.where(own > threshold).groupBy(*keys, "__vector").agg(F.min(F.struct("__at", "__key")).alias("__first"))
    firsts = alike.select(*keys, F.col("__first.__key").alias("__key"), "__vector", F.col("__first.__at").alias("__at"))
    nodes = stored(ranked.where(F.coalesce(own <= threshold, F.lit(False))).unionByName(firsts), "nodes")
    found = near_nodes(nodes, "__key", "__vector", threshold, keys)
    places = nodes.select("__key", "__at")
    met = found.join(places.select(F.col("__key").alias("a"), F.col("__at").alias("__x")), "a").join(places.select(F.col("__key").alias("b"), F.col("__at").alias("__y")), "b")
    first = F.col("__x") < F.col("__y")
    open_pairs = stored(met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("after")))
    gone = stored(ranked.where(own > threshold).join(nodes, "__key", "left_anti").select(F.col("__key").alias("k")))
    while not open_pairs.isEmpty():
        # Kept: those that no open pair puts after another. Their later neighbours are dropped, and with them all pairs of either.
        kept = open_pairs.select(F.col("before").alias("k")).join(open_pairs.select(F.col("after").alias("k")), "k", "left_anti").distinct()
        lost = stored(open_pairs.join(kept, F.col("before") == F.col("k"), "left_semi").select(F.col("after").alias("k")).distinct())
        gone = gone.unionByName(lost)
        left = open_pairs.join(lost, F.col("after") == F.col("k"), "left_anti").join(lost, F.col("before") == F.col("k"), "left_anti")
        open_pairs = stored(left)
    return items.join(gone.select(F.col("k").alias(key)), key, "left_anti").select(*items.columns)


def rank_score(grounded: Column, hotspot: Column, churn: Column, level: Column, claims: Column, paths: Column) -> Column:
    """Groundedness + 0.30 on a hotspot + 0.12 on a file that changes much + level + claims + breadth, 4 decimals."""
    by_level = F.when(level == "L3", 0.18).when(level == "L2", 0.10).otherwise(0.0)
    score = grounded + F.when(hotspot, 0.30).otherwise(0.0) + F.when(churn, 0.12).otherwise(0.0) + by_level + F.least(F.lit(0.25), 0.05 * claims) + F.least(F.lit(0.08), 0.04 * (paths - 1))
    return F.round(score, 4)


def last_cited_lines(citations: DataFrame) -> DataFrame:
    """path, last: the greatest end line cited of each path."""
    return citations.groupBy("path").agg(F.max("end_line").alias("last"))


def verify(items: DataFrame, citations: DataFrame, chunks: DataFrame, verdicts: DataFrame, threshold: float, first: int = 6, least: float = 0.5) -> DataFrame:
    """id, status, grounded of every item: unresolved (none of its first citations meets a chunk), unsupported (the verdict on it), duplicate
    (too near a kept one, better grounded first), kept. An item without a verdict is "unchecked".

    items (id, vector), citations (id, n, path, start_line, end_line), chunks (path, start_line, end_line), verdicts (id, grounded, supported, corrected).
    """
    met = binned_overlap_join(citations.where(F.col("n") <= first), chunks, ["path"], ("start_line", "end_line"), ("start_line", "end_line"), "left_semi").select("id").distinct()
    found = items.join(met.withColumn("__met", F.lit(True)), "id", "left").join(verdicts, "id", "left")
    judged = F.when(F.col("__met").isNull(), "unresolved").when(F.col("grounded").isNull(), "unchecked").otherwise(verdict(F.col("grounded"), F.col("supported"), F.col("corrected"), least))
    judged = found.withColumn("status", judged)
    survivors = judged.where("status = 'kept'").select("id", "vector", "grounded")
    kept = greedy_dedupe(survivors, "id", "vector", [-F.col("grounded")], threshold).select("id", F.lit(True).alias("__kept"))
    status = F.when((F.col("status") == "kept") & F.col("__kept").isNull(), "duplicate").otherwise(F.col("status"))
    return judged.join(kept, "id", "left").select("id", status.alias("status"), "grounded")
