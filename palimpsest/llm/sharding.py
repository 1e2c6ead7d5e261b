"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is (rank - 1/2) / rows of its source. In
the order of fractional ranks every stretch holds the sources in the proportions of the whole, so that order, cut into
equal counts, gives shards that all match the mixture and differ by at most one row.

Both numberings are exact and without a task that grows with the input: rows are counted by (source, hash range), or
by range of fractional rank, the counts are summed up in order in two levels (blocks of `BLOCK_RANGES` ranges, and the ranges
of each block), and a numbering inside each range is added. A source with a third of all rows is spread over as
many ranges as it needs.

Null sources are a source of their own. Null and repeated document ids are rows of their own, in an order that depends
on the row's own values; equal rows are interchangeable, and where more of them than a range holds are equal in id and `ties`, each gets a draw of its own. An empty table gives no rows. Other columns are carried
through whatever their names; those named `shard` or `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, null_safe_key, pack_rest, split_copies, unpack_rest

#: Rows that a range holds on average.
RANGE_ROWS = 1_000
#: Ranges whose counts one task sums in order.
BLOCK_RANGES = 1_024
#: Fractional ranks are compared in this many steps.
STEPS = 1 << 52


def _numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the place (from 0) of each row in the order of `keys` (the last of them a range number) and `order`.

    Counts by key are summed in key order within all keys but the last, first over blocks of ranges, then over the ranges of
    each block; rows are numbered within their key.
    """
    above, last = keys[:-1], keys[-1]
    counts = materialise(df.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__block", F.expr(f"{last} div {BLOCK_RANGES}")), "range-counts")
    blocks = counts.groupBy(*above, "__block").agg(F.sum("__n").alias("__all"))
    sums = blocks.select(*above, "__block", (F.sum("__all").over(Window.partitionBy(*above).orderBy("__block")) - F.col("__all")).alias("__base"))
    inside = F.sum("__n").over(Window.partitionBy(*above, "__block").orderBy(last)) - F.col("__n")
    before = counts.withColumn("__inside", inside).join(sums, [*above, "__block"]).select(*keys, (F.col("__base") + F.col("__inside")).alias("__before"))
    placed = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return placed.join(before, keys).withColumn(name, F.col("__before") + F.col("__row")).drop("__row", "__before")


def shard_by_mixture(df: DataFrame, shards: int, source: str = "source", row_id: str = "doc_id", seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (from 0, gapless in each shard). `ties` name columns that tell rows with
    equal ids apart."""
    total = df.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    keep = list(dict.fromkeys((row_id, source, *ties)))
    df = df.drop(*(c for c in ("shard", "slot") if c not in keep))
    own = df.columns
    draw = F.xxhash64(F.lit(seed), F.col(row_id), *(F.col(c) for c in ties))
    named = split_copies(pack_rest(df, *keep).withColumns({"__source": null_safe_key(source), "__draw": draw}), "__draw", RANGE_ROWS)
    named = named.withColumn("__range", F.floor((F.col("__draw").cast("double") + 2.0**63) / 2.0**64 * ranges))
    sizes = materialise(named.groupBy("__source").agg(F.count("*").alias("__size")), "source-sizes")  # a stored table's size is known to the planner
    order = [F.col("__draw"), F.col(row_id), *(F.col(c) for c in ties)]
    ranked = _numbered(named, ["__source", "__range"], order, "__rank").join(sizes, "__source")
    part = (F.col("__rank") * 2 + 1) / (F.col("__size") * 2)
    mixed = ranked.withColumn("__part", F.floor(part * STEPS)).withColumn("__band", F.least(F.floor(part * ranges), F.lit(ranges - 1)))
    mixed = mixed.withColumn("__whole", F.lit(0)).drop("__rank", "__size", "__range")
    placed = _numbered(mixed, ["__whole", "__band"], [F.col("__part"), F.col("__source"), *order], "__place")
    # Whole-number division, exact at any size: place * shards div total, and the first place of a shard.
    shard = F.expr(f"__place * {shards} div {max(total, 1)}")
    first = F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")
    cut = placed.withColumn("__shard", shard)
    return cut.select(*unpack_rest([c for c in own if c not in ("shard", "slot")], *keep), F.col("__shard").cast("int").alias("shard"), (F.col("__place") - first).alias("slot"))
