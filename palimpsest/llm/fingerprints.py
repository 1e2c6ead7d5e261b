"""Order MinHash fingerprints: signatures that follow the edit distance of texts, not only their sets of words.

The k-mers of a text are its runs of `K` words (all of it, if it has fewer). A k-mer that occurs again is told apart by
its occurrence number. Each of `SLOTS` slots has an order of its own over all k-mers there can be; the first `TUPLE` of the text's in that order
are selected, put back into their order in the text and hashed together. Texts that share k-mers in another order therefore differ.

A slot's order: in round 0, 1, 2, ... every (k-mer, occurrence) has a hash, whose first bits deal it to one slot; a slot
has the k-mers of earlier rounds before those of later ones, by hash within a round, and a k-mer where it comes first.
So rounds beyond those that fill the slots of a text change nothing, and long texts need one round only. A text of n k-mers
goes through 1 + 511 div n rounds, some eight k-mers a slot; a slot that has fewer than two by then (one in 300) makes do
with what it has.

A fingerprint is the list of the filled slots, `slot number (2 hex digits) + hash (8 hex digits)`, by comma. The
likeness of two is the share of slots filled in either on which they agree.

All of it is SQL expressions on the row, none of it shuffles. Within a text, slot, round, hash and position share one long (6 bits, 1 or 10, 31 or
22, and 26), so that selecting is sorting longs; beyond 2^26 words positions saturate.

Null texts are empty; an empty text is one empty k-mer and has a fingerprint. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

K, SLOTS, TUPLE = 3, 64, 2
POSITION_BITS = 26
#: K-mers, over all rounds, that fill the slots of a text.
FILLED = 512
#: Documents of a range, on average, when neighbours are looked up; quantiles of the ids that set the ranges; ranges of a block.
RANGE_ROWS = 1000
CELLS = 4096
BLOCK_RANGES = 1024


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once for all uses of `name` in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fingerprint_sql(text: str) -> str:
    mask, rest = (1 << POSITION_BITS) - 1, 64 - POSITION_BITS
    parts = ", ".join(f"get(w, i + {j})" for j in range(K))
    packed = f"sort_array(transform(sequence(0, greatest(size(w) - {K}, 0)), i -> (xxhash64({parts}) & ~{mask}L) | least(i, {mask})))"
    starts = f"filter(sequence(0, size(s) - 1), j -> j = 0 OR shiftright(s[j], {POSITION_BITS}) != shiftright(s[greatest(j - 1, 0)], {POSITION_BITS}))"
    numbers = "if(size(r) = size(s), array(), flatten(transform(r, (a, n) -> sequence(0, coalesce(get(r, n + 1), size(s)) - a - 1))))"
    # Slot, a zero bit and the hash in the first round; slot, a one bit, round and hash in later ones.
    drawn = f"xxhash64(shiftright(s[i % size(s)], {POSITION_BITS}), coalesce(get(o, i % size(s)), 0), i div size(s))"
    first = f"{drawn} & {-(1 << 64 - 6) | (1 << 57) - 1 & ~mask}L"
    later = f"({drawn} & {-(1 << 64 - 6) | (1 << 48) - 1 & ~mask}L) | {1 << 57}L | shiftleft(i div size(s), 48)"
    again = f"transform(sequence(0, size(s) * (1 + {FILLED - 1} div size(s)) - 1), i -> if(i < size(s), {first}, {later}) | (s[i % size(s)] & {mask}L))"
    # Long texts have one round, without arithmetic on places.
    once = f"transform(s, (x, j) -> (xxhash64(shiftright(x, {POSITION_BITS}), coalesce(get(o, j), 0), 0L) & {-(1 << 64 - 6) | (1 << 57) - 1 & ~mask}L) | (x & {mask}L))"
    hashed = f"sort_array(if(size(s) >= {FILLED}, {once}, {again}))"
    slot = "shiftrightunsigned({}, 58)"
    edges = f"filter(sequence(0, size(v) - 1), j -> j = 0 OR {slot.format('v[j]')} != {slot.format('v[greatest(j - 1, 0)]')})"
    # The first k-mers of a slot, each where it comes first: equal positions are one k-mer in two rounds, and only short texts have those.
    others = f"filter(slice(v, e + 2, if(size(s) >= {FILLED}, {TUPLE - 1}, 64)), x -> {slot.format('x')} = {slot.format('v[e]')} AND x & {mask}L != v[e] & {mask}L)"
    mine = f"concat(array(v[e]), slice({others}, 1, {TUPLE - 1}))"
    in_order = f"sort_array(transform({mine}, x -> shiftleft(x & {mask}L, {rest}) | shiftrightunsigned(x, {POSITION_BITS})))"
    code = f"transform({in_order}, x -> x & {(1 << rest) - 1}L)"
    entry = f"concat(lpad(lower(hex({slot.format('v[e]')})), 2, '0'), lpad(lower(hex(xxhash64({code}) & 4294967295L)), 8, '0'))"
    body = f"array_join(array_sort(transform({edges}, e -> {entry})), ',')"
    return _let("w", f"split({text}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+')", _let("s", packed, _let("r", starts, _let("o", numbers, _let("v", hashed, body)))))


def fingerprint(text: str) -> Column:
    """The fingerprint of the text in a column of that name; it must not be null."""
    return F.expr(fingerprint_sql(text))


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots filled in either fingerprint on which both agree, 0 to 1; two alike are 1."""
    left, right = F.split(a, ","), F.split(b, ",")
    slots = F.size(F.array_union(F.transform(left, lambda x: F.substring(x, 1, 2)), F.transform(right, lambda x: F.substring(x, 1, 2))))
    return F.size(F.array_intersect(left, right)) / slots


def _place_sql(bounds: list[int], n: int, value: str, tie: str) -> str:
    """SQL of a row's place among n rows, from quantiles: it never falls as (value, tie) rises, and is off by at most a
    cell (n / CELLS rows) and what the quantiles are off.

    A value between two bounds is as far into the cell as it is between them; rows that share one value over several
    cells are spread over them by their tie.
    """
    table = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    steps = ", ".join(str(1 << i) for i in reversed(range(len(bounds).bit_length())))
    # The number of bounds below (or up to) the value, by halving.
    count = "aggregate(array({steps}), 0, (i, s) -> if(i + s <= {k} AND get(b, i + s - 1) {op} {value}, i + s, i))"
    below, upto = (count.format(steps=steps, k=len(bounds), op=op, value=value) for op in ("<", "<="))
    start = "cast(get(b, greatest(lo - 1, 0)) as double)"
    inside = f"coalesce((cast({value} as double) - {start}) / nullif(cast(get(b, lo) as double) - {start}, 0d), 0d)"
    cell = f"if(hi = lo, lo + least(greatest({inside}, 0d), 1d), lo + 1 + ({tie}) * (hi - lo - 1))"
    return _let("b", table, _let("lo", below, _let("hi", upto, f"{cell} * {n / len(bounds)!r}d")))


def _ranges(docs: DataFrame) -> Column:
    """A range number that never falls in the order of doc_id (null first) and __tie, with about RANGE_ROWS rows a range.

    Bounds are the ids' quantiles, so single far ids don't stretch a range, and all arithmetic on ids is of doubles. Null
    ids have the ranges below 0, by their ties.
    """
    shares = [(i + 1) / CELLS for i in range(CELLS)]
    found = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", shares, 4 * CELLS).alias("bounds")).first()
    tie = "(cast(__tie as double) + 9223372036854775808d) / 18446744073709551616d"
    cells = max(1, -(-found["nulls"] // RANGE_ROWS))
    null_range = F.expr(f"least(floor(({tie}) * {cells}), {cells - 1}) - {cells}")
    if not found["n"]:
        return null_range.cast("long")
    bounds = sorted(found["bounds"])
    some = bounds[:: max(1, CELLS // max(1, min(CELLS, found["n"] // 16)))] if found["n"] < 16 * CELLS else bounds
    some[-1] = bounds[-1]
    place = F.expr(_place_sql(some, found["n"], "doc_id", tie))
    return F.when(F.col("doc_id").isNull(), null_range).otherwise(F.floor(place / RANGE_ROWS)).cast("long")


def _heads(base: DataFrame) -> DataFrame:
    """The greatest (id, tie) of each range, and the range that its copy goes to: the next one above, and for the last
    range the first. Ranges are ordered in blocks, and blocks among each other, so no task orders all of them."""
    head = base.groupBy("__at").agg(F.max(F.struct("doc_id", "__tie")).alias("head")).withColumn("__block", F.floor(F.col("__at") / BLOCK_RANGES))
    head = materialise(head, "range-heads")
    blocks = head.groupBy("__block").agg(F.min("__at").alias("__first"))
    order = Window.orderBy("__block")
    following = F.coalesce(F.lead("__first").over(order), F.first("__first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = blocks.select("__block", following.alias("__after"))
    upper = F.coalesce(F.lead("__at").over(Window.partitionBy("__block").orderBy("__at")), F.col("__after"))
    told = head.join(after, "__block").select(upper.alias("__to"), F.col("__at").alias("__from"), F.col("head.doc_id").alias("__head_id"), F.col("head.__tie").alias("__head_tie"))
    return materialise(told, "range-neighbours")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and next_text: the text of the next document by descending doc_id; after the last comes the first.

    Rows with equal ids are ordered by a hash of their text; null ids come last. Texts are dealt out once, by ranges of
    (doc_id, hash); for the last document of a range, a copy of the next range's first is dealt to it as well.
    """
    base = docs.select("doc_id", text_of().alias("text")).withColumn("__tie", F.xxhash64("text"))
    base = base.withColumn("__at", _ranges(base.select("doc_id", "__tie")))
    heads = _heads(base)
    same = base["__at"].eqNullSafe(heads["__from"]) & base["doc_id"].eqNullSafe(heads["__head_id"]) & (base["__tie"] == heads["__head_tie"])
    copies = base.join(heads, same).select("doc_id", "text", "__tie", F.col("__to").alias("__at"), F.lit(1).alias("__copy"))
    rows = base.withColumn("__copy", F.lit(0)).unionByName(copies)
    window = Window.partitionBy("__at").orderBy("__copy", F.desc_nulls_last("doc_id"), F.desc("__tie"))
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(window), F.col("text")))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text (its last half replaced by the next document's
    beginning), and their likeness and that to the next document."""
    rows = with_next(docs)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(length(text) div 2 as int))"), F.expr("left(next_text, cast(length(text) div 2 as int))"))
    window = Window.partitionBy("__at").orderBy("__copy", F.desc_nulls_last("doc_id"), F.desc("__tie"))
    marked = rows.withColumns({"n_chars": n.cast("long"), "edited": edited, "fingerprint": fingerprint("text")}).drop("next_text", "text")
    beside = marked.withColumn("next_fingerprint", F.coalesce(F.lead("fingerprint").over(window), F.col("fingerprint"))).where("__copy = 0")
    both = beside.withColumn("edited_fingerprint", fingerprint("edited"))
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
