"""The boundary to models: any callable over a batch of texts, run in Spark tasks, failures kept as rows.

No model is called from here; `HASHED` and `stub_answer` are deterministic stand-ins.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name -> callable over a list of texts that returns a list of vectors; new ones are added here or passed in.
EMBEDDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
BATCH = 96
WIDTH = 1536
_TOKEN = re.compile(r"[a-z_][a-z0-9_]+|\d+")


_PRIME, _MASK = np.uint64(16777619), np.uint64(0xFFFFFFFF)
#: Longer words are folded on their own.
LONG_WORD = 48


def _fold(words: list[str], start: np.ndarray) -> np.ndarray:
    """FNV-1a of each word, from a state of its own, character column by column."""
    out = start.astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero(sizes <= LONG_WORD)
    width = int(sizes[short].max(initial=0))
    letters = np.frombuffer("".join(words[i].ljust(width) for i in short.tolist()).encode("ascii"), np.uint8).reshape(len(short), width).astype(np.uint64)
    state, left = out[short], sizes[short]
    for i in range(width):
        on = left > i
        state[on] = (state[on] ^ letters[on, i]) * _PRIME & _MASK
    out[short] = state
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h = int(out[i])
        for c in words[i]:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        out[i] = h
    return out


def hashed_sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Dimensions and values of lower-cased texts: words weigh 1, pairs of words 0.6; each goes to the dimension and sign its hash says; logarithm, then unit length.

    Every distinct word and pair of the batch is hashed once; a pair goes on from the state of its first word."""
    vocabulary: dict[str, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in _TOKEN.findall(t)), np.int64) for t in texts]
    words = list(vocabulary)
    hashes = _fold(words, np.full(len(words), 2166136261, np.uint64))
    codes = [a[:-1] * max(1, len(words)) + a[1:] for a in ids]
    pairs, where = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
    first, second = np.divmod(pairs, max(1, len(words)))
    tails = _fold([words[i] for i in second.tolist()], (hashes[first] ^ np.uint64(ord("~"))) * _PRIME & _MASK)
    out, at = [], 0
    for own, code in zip(ids, codes, strict=True):
        h = np.concatenate([hashes[own], tails[where[at : at + len(code)]]])
        at += len(code)
        weight = np.concatenate([np.ones(len(own)), np.full(len(code), 0.6)]) * np.where(h >> np.uint64(16) & np.uint64(1), -1.0, 1.0)
        x = np.bincount((h % np.uint64(WIDTH)).astype(np.int64), weights=weight, minlength=WIDTH)
        dims = np.flatnonzero(np.abs(x) > 1e-9)
        v = np.sign(x[dims]) * np.log1p(np.abs(x[dims]))
        out.append((dims, v / (np.sqrt((v * v).sum()) or 1.0)))
    return out


def hashed(texts: list[str]) -> list[list[float]]:
    """`hashed_sparse` as vectors of `WIDTH` numbers."""
    out = []
    for dims, values in hashed_sparse([t.lower() for t in texts]):
        x = np.zeros(WIDTH)
        x[dims] = values
        out.append(x.tolist())
    return out


EMBEDDERS["hashed"] = hashed


def stub_answer(prompts: list[str]) -> list[str]:
    """A JSON verdict that depends on the prompt's hash only."""
    return [json.dumps({"supported": h % 4 != 0, "groundedness": h % 101 / 100}) for h in (int(hashlib.sha256(p.encode()).hexdigest()[:8], 16) for p in prompts)]


def apply_model(df: DataFrame, text: str, out: str, kind: T.DataType, call: Callable[[list[str]], list], batch: int = BATCH) -> DataFrame:
    """Add `out` and `out`_error: the callable's results by batch. A batch that fails is tried again row by row, once, and
    rows that fail then have a null result and the error's text; the job goes on. Null texts have null results."""
    at, names = df.columns.index(text), [*df.columns, out, f"{out}_error"]
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind), T.StructField(f"{out}_error", T.StringType())])
    arrow = pa.list_(pa.float64()) if isinstance(kind, T.ArrayType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(at).to_pylist()
            values: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            there = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(there), batch):
                some = there[k : k + batch]
                try:
                    for i, v in zip(some, call([texts[i] for i in some]), strict=True):
                        values[i] = v
                except Exception:
                    for i in some:
                        try:
                            values[i] = call([texts[i]])[0]
                        except Exception as e:
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow), pa.array(errors, pa.string())], names=names)

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: str = "hashed") -> DataFrame:
    return apply_model(df, text, out, T.ArrayType(T.DoubleType()), EMBEDDERS[embedder])


def sparse_embedding(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, dim, x of the hashed embedding of every whole text, without a shuffle. Null texts, and those without words, have no rows."""
    kind = df.schema[key]
    arrow = pa.schema([("dim", pa.int32()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # as many texts at once as hold some millions of characters
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size < 2_000_000):
                    size += len(texts[upto])
                    upto += 1
                found = hashed_sparse(texts[at:upto])
                rows = np.repeat(np.arange(at, upto), [len(d) for d, _ in found])
                dims, values = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(dims.astype(np.int32)), pa.array(values.astype(np.float64))], names=[key, *arrow.names])
                at = upto

    schema = T.StructType([kind, T.StructField("dim", T.IntegerType()), T.StructField("x", T.DoubleType())])
    return df.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("text")).mapInArrow(run, schema)


def apply_structured(df: DataFrame, text: str, out: str, call: Callable[[list[str]], list], schema: str, rules: dict[str, Column], repairs: int = 1) -> DataFrame:
    """Add `out` (a struct of the schema), `out`_tries and `out`_problems: a model's JSON answers held against a schema and named rules (on `parsed`).

    An answer that breaks them is asked for again with what was wrong in the prompt, at most `repairs` times, and only those rows are asked again; then its struct is null and its problems
    stay. A call that fails is a problem too.
    """
    answer, problems = f"__{out}_answer", f"{out}_problems"
    tries = f"{out}_tries"
    kind = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    state = df.withColumns({"__ask": F.col(text), out: F.lit(None).cast(kind), tries: F.lit(0), problems: F.lit(None).cast("array<string>")})
    for _ in range(repairs + 1):
        waits = F.col(text).isNotNull() & F.col(out).isNull()
        asked = apply_model(state.withColumn("__prompt", F.when(waits, F.col("__ask"))), "__prompt", answer, T.StringType(), call)
        parsed = asked.withColumn("parsed", F.from_json(answer, kind, {"mode": "PERMISSIVE"}))
        readable = F.coalesce(F.try_parse_json(answer).isNotNull(), F.lit(False)) & F.col("parsed").isNotNull()
        broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
        found = F.when(F.col(f"{answer}_error").isNotNull(), F.array(F.col(f"{answer}_error"))).when(~readable, F.array(F.lit("unreadable"))).otherwise(broken)
        told = parsed.withColumns({"__found": found}).withColumns({
            out: F.when(waits & (F.size("__found") == 0), F.col("parsed")).otherwise(F.col(out)), problems: F.when(waits, F.col("__found")).otherwise(F.col(problems)), tries: F.when(waits, F.col(tries) + 1).otherwise(F.col(tries)),
            "__ask": F.when(waits, F.concat(F.col(text), F.lit("\n\nYour last answer was:\n"), F.coalesce(F.col(answer), F.lit("")), F.lit("\nIt does not hold: "), F.array_join("__found", ", "))).otherwise(F.col("__ask")),
        })
        state = told.select(*df.columns, "__ask", out, tries, problems)
    return state.select(*df.columns, out, tries, F.when(F.size(problems) > 0, F.col(problems)).alias(problems))
