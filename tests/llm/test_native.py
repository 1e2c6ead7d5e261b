"""The native operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm.fingerprints import SLOTS, fingerprint, fingerprint_pairs, likeness
from palimpsest.llm.lines import dedup_lines, with_kept_text
from palimpsest.llm.mixing import count_words, mix_documents, with_copies
from palimpsest.llm.sharding import shard_by_mixture

COMMON = "This line is in many documents."


@pytest.fixture(scope="module")
def rows():
    out = [(i, "\n".join([COMMON] * (i % 3 == 0) + [f"  Line number {i} of its own\t", f"shared by two {i // 2} docs", "short"] + ["Twice in here it is"] * (2 * (i % 50 == 7))), "hot" if i % 3 else f"s{i % 7}", "x") for i in range(400)]
    out += [(1000, None, None, "x"), (1001, "", "s1", "x"), (1001, "", "s1", "x"), (1002, COMMON.upper() + " \n\n" + COMMON, "s1", "x"), (None, COMMON, "s2", "x"), (3, "shared by two 1 docs\nanother text of three", "s1", "x"), (1003, "word " * 60_000, None, "x"), (1004, "一行のテキスト、同じ行です\n" * 3, "zz", "x"), (1005, "一行のテキスト、同じ行です\x85", "zz", "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, line string").repartition(5)


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def test_lines(docs, rows):
    first = {}
    for doc, text, _, _ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    want = Counter()
    for doc, text, _, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or first.get(key(x), doc) == doc]
        want[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter((r.doc_id, r.n, r.d, r.k) for r in with_kept_text(docs).selectExpr("doc_id", "__line_n n", "__line_dropped d", "__line_kept k").collect())
    assert got == want
    out = dedup_lines(docs)
    assert out.columns == docs.columns and out.where("doc_id = 1000").first().text is None
    assert dedup_lines(docs.limit(0)).count() == 0


def test_many_lines(spark):
    text = "\n".join(f"line number {i} is long enough" for i in range(5000))
    docs = spark.createDataFrame([(1, "\n".join(f"line number {i} is long enough" for i in range(0, 5000, 3))), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in with_kept_text(docs).collect()}
    assert got[2]["__line_kept"] == "\n".join(f"line number {i} is long enough" for i in range(5000) if i % 3)


def test_shards(docs, rows):
    got = shard_by_mixture(docs, 8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    whole = Counter(r.source for r in got)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        mix = Counter(r.source for r in shard)
        assert all(abs(mix[s] - n / 8) <= 2 for s, n in whole.items())
    again = {(r.doc_id, r.text, r.shard, r.slot) for r in shard_by_mixture(docs.repartition(3), 8).collect() if r.doc_id not in (1001, 3)}
    assert again == {(r.doc_id, r.text, r.shard, r.slot) for r in got if r.doc_id not in (1001, 3)}
    assert shard_by_mixture(docs.limit(0), 8).count() == 0
    assert shard_by_mixture(docs.where("doc_id < 3"), 8).count() == 3


def targets(sizes):
    names, weight = sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1)
    weights = {s: weight[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        if not full:
            return out | {s: level * weights[s] for s in open_}
        open_ -= full
    return out


def test_mix(spark):
    rows = [(i, "w " * (i % 40), "a" if i % 2 else "b" if i % 3 else f"c{i % 5}") for i in range(6000)] + [(7000 + i, "x y\tz", None) for i in range(20)] + [(8000, None, "b"), (8001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = targets(size)
    got = with_copies(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r["__mix_size"] * r["__mix_copies"]
        assert abs(r["__mix_target"] - want[r.source]) < 1e-6 * max(1, want[r.source]) and r["__mix_total"] == size[r.source] and 0 <= r["__mix_copies"] <= 3
    for s in want:
        assert abs(taken[s] - want[s]) <= 40, (s, taken[s], want[s])
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["__mix_copies"] for r in got)
    assert mix_documents(docs.limit(0)).count() == 0


def test_mix_with_null_repeated_and_equal_rows(spark):
    """A third of the ids null, one id for many rows, and one row many times over: each source within one document of its target."""
    rows = [(None if i % 3 == 0 else 77 if i % 5 == 0 else i, "w " * (1 + i % 40) + str(i), "a" if i % 2 else f"c{i % 4}") for i in range(3000)]
    rows += [(None, "the same words again", "a")] * 900 + [(5, "other words", "c0")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    got, taken = with_copies(docs).collect(), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r["__mix_size"] * r["__mix_copies"]
    assert all(abs(taken[s] - n) <= 41 for s, n in targets(size).items())
    columns = ["doc_id", "text", "source", "__mix_copies"]
    again = Counter(tuple(r) for r in with_copies(docs.repartition(3)).select(columns).collect())
    assert again == Counter(tuple(r[c] for c in columns) for r in got)


def test_split_copies(spark):
    from palimpsest.llm.common import split_copies

    rows = [(5, i % 3) for i in range(100)] + [(6, 0)] * 4 + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v int").repartition(7)
    got = split_copies(df, "k", 4).collect()
    assert Counter(r.v for r in got) == Counter(v for _, v in rows)
    assert max(Counter(r.k for r in got if r.k not in (6, None)).values()) == 1 and sum(r.k == 6 for r in got) == 4
    assert sorted(r.k or 0 for r in split_copies(df.repartition(2), "k", 4).collect()) == sorted(r.k or 0 for r in got)
    assert split_copies(df.limit(0), "k", 4).count() == 0


def test_shards_of_equal_rows(spark, monkeypatch):
    from palimpsest.llm import sharding

    monkeypatch.setattr(sharding, "RANGE_ROWS", 40)
    docs = spark.createDataFrame([(None, f"t{i}", "a", 1) for i in range(300)] + [(None, "same", "b", 2)] * 500, "doc_id long, text string, source string, size int").repartition(5)
    got = shard_by_mixture(docs, 7, ties=("text",)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 800 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {114, 115}


def test_count_words(spark):
    import re

    texts = ["", " ", "a", " a\tb\n", "a b c", None, "x\x0by\x0cz\r", "\x1c a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", count_words(F.col("t")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}


def test_pairs(docs, rows):
    got = fingerprint_pairs(docs).collect()
    assert len(got) == len(rows)
    order = sorted(({"id": d, "t": t or ""} for d, t, _, _ in rows), key=lambda r: (r["id"] is not None, r["id"] or 0), reverse=True)
    ids = Counter(r["id"] for r in order)
    sha = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint) for r in got}
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        if ids[r["id"]] == 1 and ids[after["id"]] == 1:
            half = len(r["t"]) // 2
            edited = r["t"][: len(r["t"]) - half] + after["t"][:half]
            assert sha[r["id"]][:2] == (len(r["t"]), hashlib.sha256(edited.encode()).hexdigest()), r
    assert fingerprint_pairs(docs.limit(0)).count() == 0
    one = fingerprint_pairs(docs.where("doc_id = 1002")).first()
    assert one.near_next == 1.0


def test_fingerprint_follows_order(spark):
    import random

    random.seed(5)
    words = [f"w{random.randrange(4000)}" for _ in range(600)]
    close = words[:300] + ["new"] + words[300:]
    swapped = words[400:] + words[200:400] + words[:200]
    other = [f"v{i}" for i in range(600)]
    repeated = ["la la la"] * 50
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, close, swapped, other)] + [(" ".join(repeated), " ".join(repeated[:30])), ("", "")], "a string, b string")
    got = [r.n for r in df.select(fingerprint("a").alias("x"), fingerprint("b").alias("y")).select(likeness(F.col("x"), F.col("y")).alias("n")).collect()]
    assert got[0] == 1.0 and got[1] > 0.85 and 0.15 < got[2] < got[1] and got[3] == 0 and 0 < got[4] < 1 and got[5] == 1.0


@pytest.mark.parametrize("text", ["a b c a b c a b c d e f a b c " * 3 + "z y x " * 20 + "one two three four five six seven eight nine ten", "one two", "a b c d", "x y z w " * 2, " ".join(f"w{i * i % 331}" for i in range(900))])
def test_fingerprint_by_hand(spark, text):
    """The SQL against a plain selection: each slot's order over occurrence-numbered k-mers, its first two in text order."""
    words = text.split()
    kmers = [tuple(words[i : i + 3] + [None] * (3 - len(words[i : i + 3]))) for i in range(max(1, len(words) - 2))]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(kmers)], "i int, a string, b string, c string")
    mask = (1 << 26) - 1
    hashes = [r.h & ~mask for r in df.select("i", F.xxhash64("a", "b", "c").alias("h")).orderBy("i").collect()]
    seen, numbered = Counter(), []
    for i, h in enumerate(hashes):
        numbered.append((i, h >> 26, seen[h]))
        seen[h] += 1
    rounds = 1 + 511 // len(kmers)
    keyed = spark.createDataFrame([(*x, r) for x in numbered for r in range(rounds)], "i int, h long, o int, r long").select("i", "r", F.xxhash64("h", "o", "r").alias("g")).collect()
    slots = defaultdict(list)
    for x in keyed:
        g = x.g % 2**64
        slots[g >> 58].append((x.r, (g >> 26) % 2**31 if x.r == 0 else (g >> 26) % 2**22, x.i))
    want = []
    for slot, found in slots.items():
        firsts = {}
        for x in sorted(found):
            firsts.setdefault(x[2], x)
        two = sorted(list(firsts.values())[:2], key=lambda x: x[2])
        want.append((slot, [slot << 32 | (h if r == 0 else 1 << 31 | r << 22 | h) for r, h, _ in two]))
    table = spark.createDataFrame(want, "s int, c array<long>").select("s", (F.xxhash64("c").bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")).collect()
    expected = ",".join(sorted(f"{r.s:02x}{r.h:08x}" for r in table))
    assert len(want) <= SLOTS
    assert spark.createDataFrame([(text.strip(),)], "t string").select(fingerprint("t").alias("f")).first().f == expected


def independent_minima(a, b, functions=200):
    """Likeness under Order MinHash with a hash function of its own for each of many tuples."""
    import random

    def numbered(text):
        words, seen, out = text.split(), Counter(), []
        for i in range(len(words) - 2):
            k = tuple(words[i : i + 3])
            out.append((*k, seen[k]))
            seen[k] += 1
        return out

    x, y = numbered(a), numbered(b)
    rng, same = random.Random(11), 0
    universe = sorted({*x, *y})
    for _ in range(functions):
        order = dict(zip(universe, rng.sample(range(len(universe)), len(universe)), strict=True))
        picked = []
        for k in (x, y):
            two = sorted(range(len(k)), key=lambda i: order[k[i]])[:2]
            picked.append([k[i] for i in sorted(two)])
        same += picked[0] == picked[1]
    return same / functions


def test_order_counts_in_texts_of_any_length(spark):
    """Blocks of ten words shuffled, and halves swapped: as far apart as under independent hash functions, from 40 words on."""
    import random

    rng, pairs = random.Random(7), []
    for n in (40, 80, 160, 400, 1500):
        for _ in range(20):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            blocks = [words[i : i + 10] for i in range(0, n, 10)]
            rng.shuffle(blocks)
            pairs += [(n, "blocks", " ".join(words), " ".join(w for b in blocks for w in b)), (n, "halves", " ".join(words), " ".join(words[n // 2 :] + words[: n // 2]))]
    df = spark.createDataFrame(pairs, "n int, kind string, a string, b string").select("n", "kind", "a", "b", fingerprint("a").alias("x"), fingerprint("b").alias("y"))
    rows, got, want = df.select("n", "kind", "a", "b", likeness(F.col("x"), F.col("y")).alias("l")).collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.n, r.kind].append(r.l)
        want[r.n, r.kind].append(independent_minima(r.a, r.b, 100 if r.n < 1500 else 30))
    mean = lambda x: sum(x) / len(x)
    table = {k: (round(mean(got[k]), 2), round(mean(want[k]), 2)) for k in got}
    assert all(abs(a - b) <= 0.1 for a, b in table.values()), table


def test_clashing_names(spark):
    """Extra columns with names that the operators use inside, or give out, are carried through or replaced, as said there."""
    names = ["__line_row", "__line_drop", "__line_h1", "__mix_size", "__mix_hash", "__source", "__draw", "__range", "__place", "__rest", "shard", "slot", "a.b"]
    docs = spark.createDataFrame([(i, f"a shared line of text\nown line number {i} here", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)], ["doc_id", "text", "source", *names])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    want = {r.doc_id: tuple(r)[3:] for r in docs.collect()}
    lines = dedup_lines(docs)
    assert lines.columns == docs.columns and {r.doc_id: tuple(r)[3:] for r in lines.collect()} == want
    assert sum("shared" in r.text for r in lines.collect()) == 1
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns and all(tuple(r)[3:] == want[r.doc_id] for r in mixed.collect())
    sharded = shard_by_mixture(docs, 4)
    assert sharded.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert all(tuple(r)[3:-2] == tuple(x for x, n in zip(want[r.doc_id], names, strict=True) if n not in ("shard", "slot")) for r in sharded.collect())
    assert {r.shard for r in sharded.collect()} == {0, 1, 2, 3}


def test_common_line_is_cut_into_runs(spark, monkeypatch):
    """A line that most documents hold is many runs; the least document of all keeps it, and late words have their place."""
    from palimpsest.llm import lines

    monkeypatch.setattr(lines, "RUN_ROWS", 50)
    rows = [(i, "\n".join([f"own line {i} {j} of its kind" for j in range(i % 200)] + ["the very common line"])) for i in range(5, 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bitmaps = {r.doc_id: r["__line_drop"] for r in lines.keep_bitmaps(docs).collect()}
    assert 5 not in bitmaps and len(bitmaps) == len(rows) - 1
    for i, _ in rows[1:]:
        at = i % 200
        assert len(bitmaps[i]) == at // 64 + 1 and [b % 2**64 for b in bitmaps[i]] == [0] * (at // 64) + [1 << at % 64]
    kept = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert all(kept[i] == (t if i == 5 else t.removesuffix("the very common line").removesuffix("\n")) for i, t in rows)


@pytest.mark.parametrize("ids", [list(range(2000)), list(range(2000)) + [2**60], [-(2**63), 2**63 - 1, 0] + [int(6.9e18), -int(6.9e18)] * 2 + list(range(500)), [None] * 900 + list(range(400)), [7] * 900 + list(range(400)), [2**i for i in range(62)] * 20, [5], [None]])
def test_ranges_of_ids(spark, monkeypatch, ids):
    """Far, wide, null and repeated ids: ranges follow the order of ids and stay near their size."""
    from palimpsest.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 50)
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string").withColumn("__tie", F.xxhash64("text"))
    got = sorted(docs.withColumn("at", fingerprints._ranges(docs)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r["__tie"]))
    assert all(a["at"] <= b["at"] for a, b in zip(got, got[1:]))
    assert max(Counter(r["at"] for r in got).values()) <= 80


def test_next_over_far_ids(spark, monkeypatch):
    from palimpsest.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    monkeypatch.setattr(fingerprints, "BLOCK_RANGES", 3)
    ids = sorted([*range(200), 2**60, -(2**63), 2**63 - 1, int(6.9e18), -int(6.9e18)], reverse=True)
    docs = spark.createDataFrame([(d, f"text of {d}") for d in ids], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs).where("__copy = 0").collect()}
    assert got == {d: f"text of {n}" for d, n in zip(ids, ids[1:] + ids[:1])}
