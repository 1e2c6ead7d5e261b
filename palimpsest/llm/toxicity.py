"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) are the training data; no text counts as known to be clean. With the
class prior p, a linear score g and the logistic loss l, the risk is

    p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g)),

and where the second part falls below zero, the step goes back up (non-negative correction). Inputs are the distinct
lower-case words of a text, nothing else. Features of the model are the words whose share of the P texts is well above
their share of the U texts that are not in P, by the score for two proportions under one common rate.

The class prior is the share of toxic texts in the population that U is drawn from: the share among labelled rows, or less
where features chosen on one half of the texts cover a smaller part of U than that share of their part of P in the other
half (`class_prior`). The correction leaves the bias where it stops, so at the end the bias is set to make the mean score
of U the prior, as it is where the uncorrected risk is least; a text without feature words then scores below the prior.

Training runs with numpy on the driver over at most `MAX_POSITIVE` P and `MAX_UNLABELLED` U texts, chosen by the smallest
hash of the document id, as the contract allows; the texts are taken whole. Scoring takes every whole text, inside Spark
tasks, with the weights as a broadcast of at most `MAX_FEATURES` words.

A null or empty text scores the model's bias. Labels that are null, or whose document is missing, teach nothing. With no
confirmed toxic text every score is the class prior's floor, 0. Repeated and null document ids are scored row by row
(a null id is never held out and never in training). An empty table gives no rows. Columns other than doc_id and text are
carried through untouched, whatever their names; `score_documents` replaces one that has the score's own name, `keep_below` adds none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_slices

#: Bounds of the training sample and of the model.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3000, 9000, 3000
THRESHOLD = 0.3
STEPS, RATE, L2 = 600, 0.05, 1e-6
#: A word is a feature if this many P texts hold it and its share of them is so many deviations above that of the other U texts.
#: Chosen by threefold cross-validation on rows that are not held out.
LEAST_TEXTS, LEAST_Z = 4, 6.0
#: P texts that must be covered before their coverage says anything about the prior.
LEAST_COVERED = 10
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that may not teach: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: np.ndarray
    bias: float
    floor: bool = False

    def words(self) -> dict[str, float]:
        return {w: float(v) for w, v in zip(self.names, self.weights, strict=True)}

    def score(self, texts: list[str], words: dict[str, float]) -> np.ndarray:
        """Scores between 0 and 1."""
        if self.floor:
            return np.zeros(len(texts))
        margin = np.array([self.bias + math.fsum(words[w] for w in words.keys() & set(WORD.findall(t.lower()))) for t in texts])
        return np.round(1 / (1 + np.exp(-np.clip(margin, -40, 40))), 9)


def _numbers(words: Iterable[str], vocabulary: dict[str, int]) -> np.ndarray:
    """The words' numbers in the vocabulary, in order, each once; new words get the next numbers."""
    return np.unique(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32))


def _texts(docs: DataFrame, ids: DataFrame, vocabulary: dict[str, int]) -> list[np.ndarray]:
    """The word numbers of the chosen documents, by doc_id; ids is at most a few thousand rows. The driver holds numbers
    and one copy of each word."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(WORD.findall((t or "").lower()))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.string()))], names=["doc_id", "words"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rows = chosen.mapInArrow(in_slices(words, "text"), "doc_id long, words array<string>").toLocalIterator()
    found = [(r["doc_id"], zlib.crc32(" ".join(r["words"]).encode()), _numbers(r["words"], vocabulary)) for r in rows]
    return [numbers for _, _, numbers in sorted(found, key=lambda x: x[:2])]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on confirmed toxic documents and unlabelled text, outside the held-out rows."""
    part = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    shares = part.agg(F.avg("toxic").alias("p")).first()
    positive = part.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(MAX_POSITIVE)
    known = [r[0] for r in positive.collect()]
    if not known:
        return Model((), np.zeros(0), 0.0, floor=True)
    free = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().orderBy(*order).limit(MAX_UNLABELLED)
    spark = docs.sparkSession
    vocabulary: dict[str, int] = {}
    p_texts = _texts(docs, spark.createDataFrame([(i,) for i in known], "doc_id long"), vocabulary)
    u_texts = _texts(docs, spark.createDataFrame([(r[0],) for r in free.collect()], "doc_id long"), vocabulary)
    if not p_texts or not u_texts:
        return Model((), np.zeros(0), 0.0, floor=True)
    return _minimise(vocabulary, p_texts, u_texts, float(shares["p"]))


def train(p_sets: Iterable[set[str]], u_sets: Iterable[set[str]], share: float) -> Model:
    """A model from word sets and the share of toxic texts among labelled ones."""
    vocabulary: dict[str, int] = {}
    p_texts, u_texts = ([_numbers(sorted(words), vocabulary) for words in sets] for sets in (p_sets, u_sets))
    return _minimise(vocabulary, p_texts, u_texts, share)


def _distinct(texts: list[np.ndarray]) -> dict[bytes, np.ndarray]:
    """A copied text counts once."""
    return {t.tobytes(): t for t in texts}


def _features(p_by: dict[bytes, np.ndarray], u_by: dict[bytes, np.ndarray], n_words: int) -> np.ndarray:
    """Numbers of the words that are features, the most telling ones first."""
    others = [t for key, t in u_by.items() if key not in p_by]
    n_p, n_u, n_o = max(1, len(p_by)), len(u_by), max(1, len(others))
    in_p, in_o = (np.bincount(np.concatenate([np.zeros(0, np.int32), *texts]), minlength=n_words) for texts in (p_by.values(), others))
    rate = (in_p + in_o) / (n_p + n_u)
    z = (in_p / n_p - in_o / n_o) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_o) + 1e-12)
    found = np.nonzero((z >= LEAST_Z) & (in_p >= LEAST_TEXTS))[0]
    return found[np.argsort(-z[found], kind="stable")][:MAX_FEATURES]


def class_prior(share: float, p_texts: list[np.ndarray], u_texts: list[np.ndarray], n_words: int) -> float:
    """The share of toxic texts in U: that of the labelled rows, or (part of U covered) / (part of P covered), if less.

    Features of one half of the texts are what covers the other half, so words that only fit their own half count for nothing.
    """
    covered, size = np.zeros(2), np.zeros(2)
    for half in (0, 1):
        is_feature = np.zeros(n_words, bool)
        is_feature[_features(_distinct(p_texts[half::2]), _distinct(u_texts[half::2]), n_words)] = True
        for i, texts in enumerate((p_texts[1 - half :: 2], u_texts[1 - half :: 2])):
            covered[i] += sum(is_feature[t].any() for t in texts)
            size[i] += len(texts)
    if covered[0] >= LEAST_COVERED:
        share = min(share, (covered[1] / size[1]) / (covered[0] / size[0]))
    return float(min(max(share, 0.005), 0.5))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def corrected_risk(theta: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The two parts of the risk (see the module's docstring) and the direction that a step goes against: the gradient of
    their sum, or, where the second part is below zero, the opposite of that part's."""
    s_p, s_u = _sigmoid(x_p @ theta.astype(x_p.dtype)), _sigmoid(x_u @ theta.astype(x_u.dtype))
    positive = prior * float(np.mean(-np.log(s_p + 1e-12)))
    negative = float(np.mean(-np.log(1 - s_u + 1e-12)) - prior * np.mean(-np.log(1 - s_p + 1e-12)))
    down = (x_u.T @ s_u) / len(x_u) - prior * (x_p.T @ s_p) / len(x_p)
    return positive, negative, -prior * (x_p.T @ (1 - s_p)) / len(x_p) + down if negative >= 0 else -down


def _bias(margin: np.ndarray, prior: float) -> float:
    """The bias with which the mean score of these margins is the prior."""
    low, high = -40.0 - float(margin.max(initial=0)), 40.0 - float(margin.min(initial=0))
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if _sigmoid(margin + middle).mean() > prior else (middle, high)
    return low


def _minimise(vocabulary: dict[str, int], p_texts: list[np.ndarray], u_texts: list[np.ndarray], share: float) -> Model:
    """The non-negative risk over distinct word sets, minimised over all of both samples at each step by Adam."""
    prior = class_prior(share, p_texts, u_texts, len(vocabulary))
    p_by, u_by, words = _distinct(p_texts), _distinct(u_texts), list(vocabulary)
    chosen = _features(p_by, u_by, len(words))
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(texts: Iterable[np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, len(chosen) + 1), dtype=np.float32)
        out[:, -1] = 1
        for i, numbers in enumerate(texts):
            at = place[numbers]
            out[i, at[at >= 0]] = 1
        return out

    x_p, x_u = matrix(p_by.values(), len(p_by)), matrix(u_by.values(), len(u_by))
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = corrected_risk(theta, x_p, x_u, prior)[2].astype(float)
        grad[:-1] += L2 * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(tuple(words[i] for i in chosen), theta[:-1], _bias(x_u[:, :-1] @ theta[:-1], prior))


def score_documents(docs: DataFrame, model: Model, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score of every whole text as a column. All other columns are carried through, or those in `keep`."""
    kept = [i for i, c in enumerate(docs.columns) if c != column and (keep is None or c in keep)]
    names = [*(docs.columns[i] for i in kept), column]

    def add(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores, pa.float64())], names=names)

    return _with_scores(docs, model, add, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(column, T.DoubleType())]))


def keep_below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose whole text scores below the threshold, as they are."""
    return _with_scores(docs, model, lambda batch, scores: batch.filter(pa.array(scores < threshold)), docs.schema)


def _with_scores(docs: DataFrame, model: Model, make: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """`make` of each slice and its scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES words
    at = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = model.words()
        for batch in batches:
            yield make(batch, model.score([t or "" for t in batch.column(at).to_pylist()], words))

    return docs.mapInArrow(in_slices(step, at), schema)
