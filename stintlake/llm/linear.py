"""Sparse logistic regression on hashed features, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintlake.llm.common import released

BITS = 20
U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str] | list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))


def ngrams(h: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Hashes of the n-grams of a hash sequence; kinds do not meet."""
    if len(h) < n:
        return np.empty(0, U64)
    out = np.full(len(h) - n + 1, U64(2 * kind + 1))
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * STEP
    return out ^ (out >> U64(29))


def slots(h: np.ndarray) -> np.ndarray:
    """The feature number of each hash."""
    return ((h * STEP) >> U64(64 - BITS)).astype(np.int64)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def base_rate(labels: list[int]) -> float:
    """The log-odds of label 1, as the bias of a model."""
    ones = sum(labels)
    return float(np.log((ones + 1) / (len(labels) - ones + 1)))


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 for sparse weights, L2."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """One update of the (distinct) coordinates ``at``, which have the weights w."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, label`` of at most ``rows`` labelled documents: those whose ids have the smallest hashes.

    The bound keeps the picked labels (an id and a number each) small enough to broadcast; a repeated id counts once.
    """
    picked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text")


def fit(sample: DataFrame, train: Callable[[list[str], list[int]], np.ndarray]) -> np.ndarray:
    """The weights (float32) that ``train`` finds on the bounded sample, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((xxhash.xxh64_intdigest(str(i)), i, y, t or "") for b in released(batches) for i, y, t in zip(*(c.to_pylist() for c in b.columns)))
        w = train([r[3] for r in rows], [r[2] for r in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].astype(np.float32).tobytes()])], names=["at", "w"])

    found = sample.coalesce(1).mapInArrow(run, "at binary, w binary").collect()
    w = np.zeros(1 << BITS, np.float32)
    for row in found:
        w[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["w"], np.float32)
    return w


def scored(rows: DataFrame, weights: np.ndarray, scorer: Callable[[np.ndarray], Callable[[str], float]]) -> DataFrame:
    """``row, score`` from ``row, text``, of every whole text; ``row`` is any struct and passes through.

    scorer makes, in each task, the function from a text to its log-odds; what that function remembers goes with the task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = scorer(shared.value)
        for batch in released(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = np.array([logit(text or "") for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(z))], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, weights: np.ndarray, scorer: Callable[[np.ndarray], Callable[[str], float]], held_out: Column, cut: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of docs; its other columns aren't looked at."""
    rows = docs.select(F.struct(docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out")).alias("row"), docs["text"].cast("string").alias("text"))
    return scored(rows, weights, scorer).select("row.doc_id", "row.held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, weights: np.ndarray, scorer: Callable[[np.ndarray], Callable[[str], float]], cut: float, predicted: int) -> DataFrame:
    """The rows of docs with the prediction ``predicted``, with all their columns whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    return scored(rows, weights, scorer).filter((F.col("score") >= cut).cast("int") == predicted).select("row.*")
