"""N-gram Jaccard join by chosen paths, with exact counts of links and classes.

A text's set holds the hashes of its runs of five words (lower case, cut at white space); a text of fewer words is one
run. Texts with equal sets are one node. The join finds all pairs of nodes with a Jaccard similarity of at least 0.8:

1. Chosen paths: in each run, a set picks about 1 / 0.8 of its tokens by a hash that is the same for all sets, and
   these are its buckets; sets that share a picked token meet. From each picked token the choice is repeated with a new
   hash, giving paths of two and three tokens. Buckets of at most `LEAF_SETS` sets are compared as they are; larger ones are
   left for the buckets of the longer paths, which split sets that share only a passage. Runs are repeated until a pair at
   the threshold meets with the target probability (`runs_for`).
2. A small bucket is compared by brute force: every set with every other, by 64-value sketches that have to look at least
   `LOOSE` similar (a pair at 0.8 falls below that once in 10^10). Sets that are linked already count as one, so a bucket
   gives fewer links than it has sets; pairs are never listed. In a larger bucket a set is compared with leaders, and
   becomes one if none looks `TIGHT`: near copies leave few leaders. Buckets of more than `BLOCK_SETS` sets are cut into
   blocks, whose leaders meet in a second pass. If they are more than `BLOCK_SETS`, the bucket's sets are not alike: all
   of them go on to paths of three tokens more, each chosen `AGAIN` times, up to `ROUNDS` times over; after that the
   leaders meet in pairs of blocks. No task has more than a block, or two, of a bucket.
3. Components of these loose links are families. Inside a family every pair is compared exactly, on whole sets, in blocks of
   bounded size by products of token matrices; a block gives back per set the number of links and one root, never
   the pairs. Components of the exact links are the classes.

Result, one row per document: class_id (smallest doc_id of the class), n_links (other documents, copies included, at 0.8 or
more) and n_copies (documents with an equal set).

Null and empty texts, and those of white space only, have no set: they are a class of their own without links. Rows
with a null doc_id have no class and no links. Rows that share a doc_id but not a text are compared on their own; the
output has one row for every input row. An empty table gives no rows. Columns other than doc_id and text are ignored, or
carried through by `drop_near_duplicates` whatever their names. Sets are told apart by 64-bit
hashes: among n sets, n^2 / 2^65 pairs are expected to be taken for equal by chance.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import in_slices
from .common import materialise, pack_rest, text_of, unpack_rest
from .components import connected_components

WORDS = 5
#: Similarity 4/5, as whole numbers: shared * 9 >= 4 * (sum of sizes).
SIMILARITY = 0.8
TARGET_RECALL = 0.997
DEPTH = 3
#: Larger buckets are split by longer paths.
LEAF_SETS = 1024
#: Rounds of `DEPTH` tokens each, and choices from each path that goes on. A pair at the threshold that meets in none but
#: such buckets is found with probability 0.996 (1 - 0.57^4 for each of the paths that it shares).
ROUNDS, AGAIN = 4, 4
BLOCK_SETS = 4096
SKETCH = 64
LOOSE, TIGHT = 0.45, 0.8
#: Sets and tokens of a block of exact comparisons.
EXACT_SETS, EXACT_TOKENS = 1024, 1_000_000
COLUMNS = 2048
#: Word hashes that a Python worker keeps.
CACHE_WORDS = 50_000
_U = np.uint64
_ODD = np.array([int.from_bytes(hashlib.blake2b(f"odd {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(256)], dtype=np.uint64)
_STEP = _ODD[200]


def runs_for(recall: float = TARGET_RECALL, depth: int = DEPTH, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the threshold has met in a bucket of the longest paths with probability `recall`."""
    mean = 2 / (1 + similarity)  # shared tokens of equal-sized sets, over their size, times 1 / similarity
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-mean * meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _ODD[201]
    x = (x ^ (x >> _U(29))) * _ODD[202]
    return x ^ (x >> _U(32))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def token_set(text: str) -> np.ndarray:
    """Sorted hashes of the text's five-word runs; empty if it has no words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(w))):
        h = h * _STEP + w[j : j + n]
    return np.unique(_mixed(h))


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(tokens: np.ndarray) -> bytes:
    """16 bits of each of 64 minima."""
    low = np.full(SKETCH, ~_U(0))
    for at in range(0, len(tokens), 8192):
        low = np.minimum(low, (tokens[None, at : at + 8192] * _ODD[:SKETCH, None]).min(axis=1))
    return ((low * _STEP) >> _U(48)).astype("<u2").tobytes()


def roots_of(runs: int) -> np.ndarray:
    """Where the paths of each run begin."""
    return _mixed(np.arange(1, runs + 1, dtype=np.uint64) * _ODD[203])


def chosen_paths(tokens: np.ndarray, roots: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: (parents, paths). A path picks each token with probability 1 / (0.8 * tokens)."""
    limit = _U(min(2**64 - 1, int(2**64 / (SIMILARITY * len(tokens)))))
    nodes, out = roots, []
    for level in range(depth):
        parents, paths = [], []
        for part in np.array_split(nodes, max(1, len(nodes) * len(tokens) // 4_000_000)):
            draw = (tokens[None, :] ^ part[:, None]) * _ODD[210 + level]
            draw ^= draw >> _U(31)
            draw *= _ODD[220 + level]
            at, token = np.nonzero(draw <= limit)
            parents.append(part[at])
            paths.append(_mixed(part[at] * _ODD[230 + level] + tokens[token]))
        out.append((np.concatenate(parents), np.concatenate(paths)))
        nodes = out[-1][1]
    return out


_SIGNED = ["parent2", "path2", "parent3", "path3"]
_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sid", pa.int64()), ("n_tokens", pa.int64()), ("sketch", pa.binary()), ("path1", pa.list_(pa.int64())), *((k, pa.list_(pa.int64())) for k in _SIGNED)])


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    roots = roots_of(runs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _SIGNATURES.names}
            for doc, own, text in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tokens = token_set(text) if doc is not None else ()
                if not len(tokens):
                    for k in _SIGNATURES.names:
                        out[k].append(doc if k == "doc_id" else own if k == "row" else None)
                else:
                    (_, one), (up2, two), (up3, three) = chosen_paths(tokens, roots)
                    row = (doc, own, set_id(tokens), len(tokens), sketch(tokens), one.view("i8"), up2.view("i8"), two.view("i8"), up3.view("i8"), three.view("i8"))
                    for k, v in zip(_SIGNATURES.names, row, strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_SIGNATURES)

    ddl = "doc_id long, row long, sid long, n_tokens long, sketch binary, path1 array<long>, parent2 array<long>, path2 array<long>, parent3 array<long>, path3 array<long>"
    return docs.select("doc_id", F.xxhash64(text_of()).alias("row"), text_of().alias("text")).mapInArrow(in_slices(sign, "text"), ddl)


_DEEPER = pa.schema([("sid", pa.int64()), ("path1", pa.list_(pa.int64())), *((k, pa.list_(pa.int64())) for k in _SIGNED)])


def _deeper(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """sid and longer paths, as in `_signatures`, for members (path, sid): their paths go on, each `AGAIN` times."""

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _DEEPER.names}
            for sid, text, paths in zip(*(batch[k].to_pylist() for k in ("sid", "text", "paths")), strict=True):
                tokens = token_set(text)
                if len(tokens) and set_id(tokens) == sid:  # rows may share a doc_id
                    starts = np.array(paths, np.int64).view(np.uint64)
                    (_, one), (up2, two), (up3, three) = chosen_paths(tokens, _mixed((starts[:, None] + _ODD[None, :AGAIN]).ravel()))
                    for k, v in zip(_DEEPER.names, (sid, one.view("i8"), up2.view("i8"), two.view("i8"), up3.view("i8"), three.view("i8")), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_DEEPER)

    wanted = members.groupBy("sid").agg(F.collect_set("path").alias("paths")).join(nodes.select("sid", F.col("rep").alias("doc_id")), "sid")
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("text")).join(wanted.hint("merge"), "doc_id")
    ddl = "sid long, path1 array<long>, parent2 array<long>, path2 array<long>, parent3 array<long>, path3 array<long>"
    return texts.select("sid", "text", "paths").mapInArrow(in_slices(go_on, "text"), ddl)


def _buckets(signatures: DataFrame) -> DataFrame:
    """path, n, block, sid: the members of every bucket that is compared, and how many there are."""
    kept, open_paths = [], None
    for level in range(1, DEPTH + 1):
        if level == 1:
            entries = signatures.select("sid", F.explode("path1").alias("path"))
        else:
            zipped = signatures.select("sid", F.explode(F.arrays_zip(F.col(f"parent{level}").alias("a"), F.col(f"path{level}").alias("b"))).alias("z"))
            entries = zipped.select("sid", F.col("z.a").alias("parent"), F.col("z.b").alias("path")).join(open_paths, "parent", "left_semi").select("sid", "path")
        entries = materialise(entries.distinct(), f"paths{level}")
        sizes = materialise(entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"path-sizes{level}")
        small = sizes.where(F.col("n") <= LEAF_SETS) if level < DEPTH else sizes
        kept.append(entries.join(small, "path").select("path", "n", _block("n", BLOCK_SETS).alias("block"), "sid"))
        open_paths = sizes.where(F.col("n") > LEAF_SETS).select(F.col("path").alias("parent"))
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def _block(n: str, most: int) -> Column:
    """The block of a set where n of them are cut into blocks of about `most`."""
    return F.pmod(F.xxhash64("sid"), F.ceil(F.col(n) / most)).cast("int")


def _compare(buckets: DataFrame, sketches: DataFrame, keys: list[str], second: bool) -> DataFrame:
    """src, dst, path: links between the sets of each bucket (its members and leaders, if it is large), and src = dst with the
    path for the leaders of cut buckets in the first pass."""
    loose = LOOSE - 0.1 if second else LOOSE

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, leaders, group = None, [], np.zeros((0, SKETCH), np.uint16), np.zeros(0, np.int64)
        count = 0
        for batch in batches:
            src, dst, path = [], [], []
            columns = [batch.column(k).to_pylist() for k in keys]
            rows = np.frombuffer(b"".join(batch["sketch"].to_pylist()), "<u2").reshape(-1, SKETCH)
            for i, (n, sid) in enumerate(zip(batch["n"].to_pylist(), batch["sid"].to_pylist(), strict=True)):
                now = tuple(c[i] for c in columns)
                if now != key:
                    key, names, count = now, [], 0
                alike = np.count_nonzero(leaders[:count] == rows[i], axis=1) / SKETCH if count else np.zeros(0)
                near = np.nonzero(alike >= loose)[0]
                groups, at = np.unique(group[near], return_index=True)
                for j in near[at]:  # one link for each group of sets that are linked already
                    src.append(sid)
                    dst.append(names[j])
                    path.append(None)
                if len(groups) > 1:
                    group[:count][np.isin(group[:count], groups)] = groups[0]
                if n <= LEAF_SETS or not (alike >= TIGHT).any():
                    if count == len(leaders):
                        leaders = np.concatenate([leaders, np.zeros((max(16, count), SKETCH), np.uint16)])
                        group = np.concatenate([group, np.zeros(max(16, count), np.int64)])
                    leaders[count] = rows[i]
                    group[count] = groups[0] if len(groups) else count
                    count += 1
                    names.append(sid)
                    if n > BLOCK_SETS and not second:
                        src.append(sid)
                        dst.append(sid)
                        path.append(now[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst, path)], names=["src", "dst", "path"])

    members = buckets.join(sketches, "sid").select(*keys, "n", "sid", "sketch")
    return members.repartition(*keys).sortWithinPartitions(*keys, "sid").mapInArrow(in_slices(compare, "sketch"), "src long, dst long, path long")


def _leaders_meet(leaders: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links between the leaders (path, n, sid) of each cut bucket, in pairs of blocks (one, if they are a block)."""
    cut = leaders.select("path", "n", "sid", _block("n", BLOCK_SETS).alias("block"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK_SETS) - 1).cast("int"))))
    paired = other.select("path", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "n", "sid")
    return _compare(paired, sketches, ["path", "a", "b"], True).select("src", "dst")


def _families(docs: DataFrame, nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    """sid, family for sets that have a loose link."""
    sketches = materialise(signatures.groupBy("sid").agg(F.first("sketch").alias("sketch")), "sketches")
    links = []
    for left in reversed(range(ROUNDS)):
        buckets = _buckets(signatures)
        first = materialise(_compare(buckets, sketches, ["path", "block"], False), "loose-links")
        links.append(first.where("path is null").select("src", "dst"))
        leaders = first.where("path is not null").select("path", F.col("src").alias("sid"))
        sizes = materialise(leaders.groupBy("path").agg(F.count("*").alias("n")), "leaders")
        wide = sizes.where(F.col("n") > BLOCK_SETS).select("path")
        last = not left or wide.isEmpty()
        links.append(_leaders_meet(leaders.join(sizes if last else sizes.where(F.col("n") <= BLOCK_SETS), "path"), sketches))
        if last:
            break
        signatures = materialise(_deeper(docs, nodes, buckets.join(wide, "path", "left_semi").select("path", "sid")), "deeper-paths")
    found = connected_components(reduce(DataFrame.unionByName, links).where("src != dst"))
    return found.select(F.col("node").alias("sid"), F.col("label").alias("family"))


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Which sets are at least 0.8 similar: (left, left) without the diagonal, or (left, right)."""
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.append(True, tokens[1:] != tokens[:-1])
    column = np.cumsum(start) - 1
    shared = np.bincount(column)[column] > 1  # a token of one set only is in no intersection
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    n, m = len(left), len(sets)
    common = np.zeros((n, m if right is None else m - n), np.float32)
    ends = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        dense = np.zeros((m, COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] % COLUMNS] = 1
        common += dense[:n] @ (dense if right is None else dense[n:]).T
    total = sizes[:n, None] + (sizes if right is None else sizes[n:])[None, :]
    linked = common.astype(np.int64) * 9 >= 4 * total
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


_COUNTED = pa.schema([("sid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _family_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """sid, root, links: exact links inside families, one row for each set of each pair of blocks."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [token_set(t) for t in batch["text"].to_pylist()]
            right = pa.array([len(t) > 0 and set_id(t) == s for t, s in zip(found, batch["sid"].to_pylist(), strict=True)])
            made = pa.RecordBatch.from_arrays([batch[k] for k in ("sid", "n_copies", "family", "block", "blocks")] + [pa.array([t.tobytes() for t in found], pa.binary())], names=["sid", "n_copies", "family", "block", "blocks", "tokens"])
            yield made.filter(right)  # rows may share a doc_id

    sized = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    blocks = F.greatest(F.ceil(F.col("n") / EXACT_SETS), F.ceil(F.col("t") / EXACT_TOKENS)).cast("int")
    cut = members.join(sized, "family").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "sid"), "blocks").cast("int"))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("text"))
    wanted = materialise(cut.select(F.col("rep").alias("doc_id"), "sid", "n_copies", "family", "block", "blocks"), "family-members")
    # Both sides are dealt out by doc_id whatever the number of members is: the table grows with the input.
    whole = texts.join(wanted.hint("merge"), "doc_id").select("text", "sid", "n_copies", "family", "block", "blocks").mapInArrow(in_slices(sets, "text"), "sid long, n_copies long, family long, block int, blocks int, tokens binary")
    other = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.select("family", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "sid", "n_copies", "tokens")

    def solve(rows: dict[int, tuple[int, int, np.ndarray]], a: int, b: int) -> pa.RecordBatch:
        sids = sorted(rows, key=lambda s: (rows[s][0] != a, s))
        n = sum(rows[s][0] == a for s in sids)
        copies = np.array([rows[s][1] for s in sids])
        sets_ = [rows[s][2] for s in sids]
        linked = exact_links(sets_, None) if a == b else exact_links(sets_[:n], sets_[n:]) if 0 < n < len(sids) else np.zeros((n, len(sids) - n), bool)
        if a == b:
            links, whole_ = linked @ copies, linked
        else:
            links = np.concatenate([linked @ copies[n:], linked.T @ copies[:n]])
            whole_ = np.zeros((len(sids), len(sids)), bool)
            whole_[:n, n:], whole_[n:, :n] = linked, linked.T
        root = np.arange(len(sids))
        for i in range(len(sids)):
            if root[i] == i:
                todo = [i]
                while todo:
                    near = np.nonzero(whole_[todo.pop()] & (root > i))[0]
                    near = near[root[near] == near]
                    root[near] = i
                    todo.extend(near.tolist())
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([sids[r] for r in root], pa.int64()), pa.array(links, pa.int64())], schema=_COUNTED)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            for family, a, b, block, sid, copies, tokens in zip(*(batch[k].to_pylist() for k in ("family", "a", "b", "block", "sid", "n_copies", "tokens")), strict=True):
                if (family, a, b) != key:
                    if rows:
                        yield solve(rows, *key[1:])
                    key, rows = (family, a, b), {}
                rows[sid] = (block, copies, np.frombuffer(tokens, np.uint64))
        if rows:
            yield solve(rows, *key[1:])

    return paired.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b").mapInArrow(in_slices(exact, "tokens"), "sid long, root long, links long")


def _judged(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """One row for every row of docs: doc_id, row (hash of the text), class_id, n_links, n_copies, and head: is this the row with the
    smallest (doc_id, row) of its class (null without a class)."""
    rows = materialise(_signatures(docs, runs_for(recall)), "signatures")
    signatures = rows.where("sid is not null")
    nodes = materialise(signatures.groupBy("sid").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("n_tokens").alias("n_tokens")), "sets")
    members = nodes.join(_families(docs, nodes, signatures), "sid")
    exact = materialise(_family_links(docs, members), "exact-links")
    classes = connected_components(exact.select(F.col("sid").alias("src"), F.col("root").alias("dst")))
    counted = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    known = nodes.join(classes.select(F.col("node").alias("sid"), "label"), "sid", "left").join(counted, "sid", "left")
    known = known.select("sid", "head", "n_copies", F.coalesce("label", "sid").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    known = materialise(known, "linked-sets")
    least = known.groupBy("label").agg(F.min("head").alias("first"))
    found = known.join(least, "label").select("sid", "first", "n_links", "n_copies")
    whole = rows.select("doc_id", "row", "sid").join(found, "sid", "left")
    head = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    return whole.select("doc_id", "row", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), head.alias("head"))


def jaccard_join(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row for every row of docs."""
    return _judged(docs, recall).select("doc_id", "class_id", "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, the one with the smallest doc_id and text hash; of repeated ones one stays. Rows
    without a class, that is with a null doc_id or without words, all stay."""
    keys = ["doc_id", "__row"]
    judged = materialise(_judged(docs.select("doc_id", "text")).select("doc_id", F.col("row").alias("__row"), "head"), "judged")
    own = pack_rest(docs, "doc_id", "text").withColumn("__row", F.xxhash64(text_of()))
    kept = own.join(judged.where("not head").select(*keys).distinct(), keys, "left_anti")
    repeated = materialise(judged.where("head").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-heads")
    if not repeated.isEmpty():
        kept = kept.join(repeated, keys, "left_anti").unionByName(kept.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*unpack_rest(docs.columns, "doc_id", "text"))
