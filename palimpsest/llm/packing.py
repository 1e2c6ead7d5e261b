"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of at most `capacity` counts tells all that a packing
depends on, at any number of documents. The driver plans with that histogram; the documents stay distributed:

1. Large pieces (over a share of the capacity, see `PLANS`) are cut, longest first, into groups of equal cardinality, and
   each length is rounded up to its group's longest: few distinct sizes remain.
2. For these sizes the fractional configuration problem is solved by column generation; whole multiples are kept.
3. Actual lengths take the slots of their group, so a sequence's real free space is known.
4. What is left over, and every small piece, goes longest first into the tightest sequence that has room.

The plan is a list of runs (length, first rank, first sequence, pieces a sequence, offset), bounded by the capacity
and the number of groups. A piece finds its run by its length and its rank among pieces of that length; ranks come from
counts by (hash bucket, length) and a numbering inside each bucket, so no task sees more than its bucket's share even
where one length has a third of all pieces.

Null texts are empty; an empty text is one piece with its end id only (with `end_id` None it has no piece). Null and
repeated document ids are packed as rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_slices
from .common import materialise, split_copies, text_of
from .tokens import encoder

#: Plans that are tried, the one with the fewest sequences is taken: (pieces of at most this share of the capacity are
#: small and left to the best-fit step, number of groups of the large ones).
PLANS = ((1 / 4, 64), (1 / 3, 64), (1 / 2, 64))
#: Mean number of pieces of a ranking bucket.
BUCKET_ROWS = 20_000
#: Column generation ends when the fractional optimum is at most this share below.
GAP = 5e-4
MAX_PIVOTS = 600


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every text cut at multiples of the capacity."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in schema.names}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = coder.encode(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for k, v in zip(schema.names, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None), strict=False):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        coder.worded.rest()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(in_slices(cut, "text"), ddl)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity that is worth most, built up one piece a round."""
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more, took = best.copy(), np.full(capacity + 1, -1)
        for i, (size, value) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
            with_it = best[: capacity + 1 - size] + value
            better = with_it > more[size:] + 1e-12
            more[size:][better] = with_it[better]
            took[size:][better] = i
        if (took < 0).all():
            break
        best = more
        chosen.append(took)
    pattern, room = np.zeros(len(sizes)), capacity
    for took in reversed(chosen):
        if took[room] >= 0:
            pattern[took[room]] += 1
            room -= int(sizes[took[room]])
    return pattern


def optimise_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how many of each, fractional, that meet the demand in the fewest sequences."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand
    for pivot in range(MAX_PIVOTS):
        worth = np.maximum(inverse.sum(axis=0), 0)
        pattern = _best_pattern(sizes, worth, capacity)
        if worth @ pattern <= 1 + GAP:
            break
        change = inverse @ pattern
        up = change > 1e-9
        ratio = np.full(k, np.inf)
        ratio[up] = amount[up] / change[up]
        leaves = int(ratio.argmin())
        basis[:, leaves] = pattern
        inverse[leaves] /= change[leaves]
        others = np.arange(k) != leaves
        inverse[others] -= np.outer(change[others], inverse[leaves])
        if pivot % 50 == 49:
            inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ demand, 0)
    return basis, amount


def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, longest first, as groups of equal cardinality: [[length, count], ...] each."""
    total, k = sum(counts.values()), min(groups, len(counts))
    edges = [total * (i + 1) // k for i in range(k)]
    out: list[list[list[int]]] = [[] for _ in range(k)]
    seen = g = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while seen >= edges[g]:
                g += 1
            take = min(left, edges[g] - seen)
            out[g].append([length, take])
            seen, left = seen + take, left - take
    return [x for x in out if x]


def plan_packing(counts: dict[int, int], capacity: int, small_share: float, groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset) and the number of sequences."""
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by free space: [first sequence, number]
    used = 0

    def put(length: int, sequence: int, number: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], sequence, each, offset))
        rank[length] += number * each
        left[length] -= number * each

    if left.get(capacity):
        put(capacity, used, left[capacity], 1, 0)
        used += rank[capacity]
    large = {n: c for n, c in left.items() if c and n > capacity * small_share}
    if large:
        pools = _grouped(large, groups)
        sizes = np.array([p[0][0] for p in pools])
        patterns, amount = optimise_configurations(sizes, np.array([sum(c for _, c in p) for p in pools], float), capacity)
        for j in np.argsort(-amount, kind="stable"):
            number = int(amount[j] + 1e-6)
            if not number:
                continue
            spans = [(used, number, 0)]
            used += number
            for g in np.repeat(np.arange(len(sizes)), patterns[:, j].astype(int)):
                filled: list[tuple[int, int, int]] = []
                for sequence, count, at in spans:
                    while count and pools[g]:
                        length, have = pools[g][0]
                        take = min(count, have)
                        put(length, sequence, take, 1, at)
                        filled.append((sequence, take, at + length))
                        sequence, count = sequence + take, count - take
                        pools[g][0][1] -= take
                        if not pools[g][0][1]:
                            pools[g].pop(0)
                    if count:
                        filled.append((sequence, count, at))
                spans = filled
            for sequence, count, at in spans:
                free[capacity - at].append([sequence, count])
    for length in sorted((n for n, c in left.items() if c), reverse=True):
        for room in range(length, capacity + 1):
            while free[room] and left[length]:
                sequence, number = free[room].pop()
                each = room // length
                whole = min(number, left[length] // each)
                if whole:
                    put(length, sequence, whole, each, capacity - room)
                    free[room - each * length].append([sequence, whole])
                if whole < number and (some := min(left[length], each)):
                    put(length, sequence + whole, 1, some, capacity - room)
                    free[room - some * length].append([sequence + whole, 1])
                    whole += 1
                if whole < number:
                    free[room].append([sequence + whole, number - whole])
            if not left[length]:
                break
        each = capacity // length
        for number, some in ((left[length] // each, each), (1, left[length] % each)):
            if number and some:
                put(length, used, number, some, 0)
                free[capacity - some * length].append([used, number])
                used += number
    return runs, used


def assign_sequences(pieces: DataFrame, capacity: int, plans: tuple[tuple[float, int], ...] = PLANS) -> DataFrame:
    """Add sequence_id and offset to stored pieces with a `length` between 1 and the capacity.

    `pieces` is read several times, so it should be a table. Every piece is placed, whatever its other columns hold; ranks come from counts by length and
    bucket of a hash, in which many equal pieces (null or repeated ids) get hashes of their own.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = min((plan_packing(counts, capacity, *plan) for plan in plans), key=lambda p: p[1])
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = spark.sparkContext.broadcast((table[:, 0] << 42 | table[:, 1], table))  # bounded by capacity and groups, not by rows
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    named = split_copies(pieces.withColumn("__draw", F.xxhash64("doc_id", "start", "length", "ids_crc32")), "__draw", BUCKET_ROWS)
    named = named.withColumn("__bucket", F.pmod("__draw", F.lit(buckets)))
    sums = named.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = sums.select("length", "__bucket", (F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    order = Window.partitionBy("length", "__bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = named.withColumn("__row", F.row_number().over(order) - 1).join(before, ["length", "__bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("__before") + F.col("__row")).alias("__rank"))
    at, names = [ranked.columns.index(c) for c in ("length", "__rank")], pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = keys.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in at)
            run = table[np.searchsorted(key, length << 42 | rank, side="right") - 1].reshape(-1, 5)
            sequence, turn = np.divmod(rank - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(run[:, 2] + sequence), pa.array(run[:, 4] + turn * length)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset"))])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut what is longer than the capacity, and pack: one row a piece, in as few sequences as found."""
    pieces = materialise(tokenize_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    return assign_sequences(pieces, capacity)
