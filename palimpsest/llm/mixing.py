"""Mixing sources to target weights by hash-threshold histograms.

Sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share the whole number of words by weight. A target stops
at `MAX_REPEATS` times its source's words; the excess goes to the others by weight, until no target is above its stop.
With r = target / source words, every document is taken floor(r) times, and once more if the hash of its id, text and source is
below its source's threshold; rows that are equal in all three are numbered, and have hashes of their own. The threshold comes from sums of words by source and hash bucket: the bucket in which the
running sum passes the budget is cut into 4096 finer ones, `LEVELS` times, and only its rows are summed again; at
the end the last, fine bucket is taken or left, whichever is nearer the budget. Nothing is sorted but sums.

A document's copies follow from its hash, the sums and nothing else, so reruns agree, and thresholds are nested: a source
with a larger target keeps every copy it had. Null and repeated ids are drawn row by row.
Null and empty texts have size 0 and are taken like others, with 0 words. An empty table gives no rows.
Other columns are carried through by `mix_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialise, null_safe_key, pack_rest, split_copies, unpack_rest

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS = 3
BITS = 12
SEED = 29


def count_words(text: Column) -> Column:
    """Number of runs of other characters than [\x20\x09-\x0D]; null has none."""
    plain = F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))
    return F.coalesce(F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of (__mix_source, __mix_total): filled by weight up to each source's stop.

    In the order of stop / weight, the first sources reach their stops; with the level at which the rest are
    filled, (all words - their stops) / (the others' weights), a source is below its stop if level * weight is. The table has one row
    a source, and only this table is ordered.
    """
    place = (F.row_number().over(Window.orderBy("__mix_source")) - 1) % len(weights)
    weighed = sizes.withColumn("__mix_w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("__mix_stop", F.col("__mix_total") * float(repeats)).withColumn("__mix_ratio", F.col("__mix_stop") / F.col("__mix_w"))
    upto = Window.orderBy("__mix_ratio", "__mix_source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__mix_ratio", "__mix_source").rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("__mix_ratio", "__mix_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("__mix_total").over(every) - F.coalesce(F.sum("__mix_stop").over(upto), F.lit(0.0))) / F.sum("__mix_w").over(after)
    levelled = weighed.withColumn("__mix_level", level)
    open_level = F.when(F.col("__mix_level") <= F.col("__mix_ratio"), F.col("__mix_level"))
    filled = levelled.withColumn("__mix_fill", F.coalesce(F.first(open_level, ignorenulls=True).over(every), F.lit(float("inf"))))
    target = F.least(F.col("__mix_stop"), F.col("__mix_fill") * F.col("__mix_w"))
    return filled.select("__mix_source", "__mix_total", target.alias("__mix_target"))


def _top(bits: int) -> Column:
    """The first bits of the hash, as a number from 0."""
    return F.shiftrightunsigned(F.col("__mix_hash"), 64 - bits)


def _thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """__mix_source, __mix_base (copies of every document) and __mix_below: hashes with a lower first part get one more."""
    budget = F.col("__mix_target") - F.col("__mix_base") * F.col("__mix_total")
    ratio = F.when(F.col("__mix_total") > 0, F.col("__mix_target") / F.col("__mix_total")).otherwise(F.lit(1.0))
    state = targets.withColumn("__mix_base", F.floor(ratio + 1e-12)).select("__mix_source", "__mix_base", budget.alias("__mix_left"), F.lit(0).cast("long").alias("__mix_edge"))
    for level in range(1, LEVELS + 1):
        inside = slim.join(state, "__mix_source").where(_top(BITS * (level - 1)) == F.col("__mix_edge")) if level > 1 else slim.join(state, "__mix_source")
        sums = inside.groupBy("__mix_source", _top(BITS * level).alias("__mix_bucket")).agg(F.sum("__mix_size").alias("__mix_sum"), F.first("__mix_left").alias("__mix_left"), F.first("__mix_base").alias("__mix_base"))
        order = Window.partitionBy("__mix_source").orderBy("__mix_bucket")
        run = sums.withColumn("__mix_run", F.sum("__mix_sum").over(order))
        # The first bucket with which the running sum passes the budget; the last one if none does.
        passes = F.struct((F.col("__mix_run") <= F.col("__mix_left")).alias("under"), F.when(F.col("__mix_run") <= F.col("__mix_left"), -F.col("__mix_bucket")).otherwise(F.col("__mix_bucket")).alias("at"), "__mix_bucket", "__mix_run", "__mix_sum")
        edge = run.groupBy("__mix_source").agg(F.min(passes).alias("e"), F.first("__mix_left").alias("__mix_left"), F.first("__mix_base").alias("__mix_base"))
        left = F.col("__mix_left") - (F.col("e.__mix_run") - F.col("e.__mix_sum"))
        state = edge.select("__mix_source", "__mix_base", left.alias("__mix_left"), F.col("e.__mix_bucket").alias("__mix_edge"), F.col("e.__mix_sum").alias("__mix_last"))
        state = materialise(state, f"mix-level{level}")  # one row a source; a stored table's size is known to the planner
    nearer = F.col("__mix_left") * 2 >= F.col("__mix_last")
    return state.select("__mix_source", "__mix_base", (F.col("__mix_edge") + F.when(nearer & (F.col("__mix_left") > 0), 1).otherwise(0)).alias("__mix_below"))


def with_copies(docs: DataFrame, size: Column | None = None, content: Column | None = None) -> DataFrame:
    """Add __mix_size, __mix_total and __mix_target (of the source) and __mix_copies (how often the mix takes the row).

    `size` is the number of words, counted here if not given; `content` stands for the text in the draw. Only hash, source and size are stored and summed; the other
    columns are read again for the result.
    """
    draw = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text") if content is None else content, F.col("source"))
    named = docs.withColumns({"__mix_size": count_words(F.col("text")) if size is None else size, "__mix_source": null_safe_key("source"), "__mix_hash": draw})
    named = split_copies(named, "__mix_hash", 1)
    slim = materialise(named.select("__mix_source", "__mix_hash", "__mix_size"), "mix-sizes")
    targets = materialise(source_targets(slim.groupBy("__mix_source").agg(F.sum("__mix_size").alias("__mix_total"))), "mix-targets")
    plan = materialise(targets.join(_thresholds(slim, targets), "__mix_source"), "mix-plan")
    copies = F.col("__mix_base") + F.when(_top(BITS * LEVELS) < F.col("__mix_below"), 1).otherwise(0)
    return named.join(plan, "__mix_source").withColumn("__mix_copies", F.least(copies, F.lit(MAX_REPEATS)).cast("int"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of `docs`."""
    keep = ("doc_id", "text", "source")
    taken = with_copies(pack_rest(docs, *keep)).where(F.col("__mix_copies") > 0)
    return taken.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*unpack_rest(docs.columns, *keep))
