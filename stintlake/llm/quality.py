"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL updates.

Features of a text: its words and word pairs, and the same of its words' shapes (runs of letters and digits become one
sign each, other characters stay), with a mark for a word that repeats the one before. A feature's value is the root of
its share of the text's words. A score is the sigmoid of a sparse dot product.

The model is fitted on a bounded sample of the labelled rows (``train_rows``); every document is scored from its whole
text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of the bias alone; rows with null or repeated ids are scored as they
are; without labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import table
from stintlake.llm.kept import Kept, held
from stintlake.llm.linear import Ftrl, base_rate, fit, labelled, ngrams, score, sigmoid, slots, word_hashes

TRAIN_ROWS, CUT = 4000, 0.7
LOWER, UPPER, DIGITS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
SAME = np.uint64(0xA5A5A5A5A5A5A5A5)


def shape_of(word: str) -> int:
    """The hash of a word's shape."""
    return xxhash.xxh64_intdigest(DIGITS.sub("0", UPPER.sub("A", LOWER.sub("a", word))))


def features(text: str, shapes: Kept) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and values; number 0 is left for the bias. shapes: word to the hash of its shape."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    h = word_hashes(words)
    shape = np.fromiter(map(shapes.__getitem__, words), np.uint64, len(words))
    shape[1:][h[1:] == h[:-1]] = SAME
    both = np.concatenate([ngrams(h, 1, 1), ngrams(h, 2, 2), ngrams(shape, 1, 3), ngrams(shape, 2, 4), ngrams(shape, 3, 5)])
    at, counts = np.unique(slots(both), return_counts=True)
    return np.maximum(at, 1), np.sqrt(counts / len(words))


def scorer(w: np.ndarray) -> Callable[[str], float]:
    """A task's function from a text to its log-odds."""
    shapes = held("shapes", lambda: Kept(shape_of))

    def logit(text: str) -> float:
        at, x = features(text, shapes)
        return float(w[0] + w[at] @ x)

    return logit


def train(texts: list[str], labels: list[int], epochs: int = 4, alpha: float = 0.3, l1: float = 0.3, l2: float = 0.1) -> np.ndarray:
    model = Ftrl(alpha, 1.0, l1, l2)
    shapes, bias = Kept(shape_of), base_rate(labels)
    rows = [(*features(t, shapes), y) for t, y in zip(texts, labels)]
    for _ in range(epochs):
        for at, x, y in rows:
            w = model.weights(at)
            model.step(at, (sigmoid(bias + w @ x) - y) * x, w)
    out = model.weights(slice(None))
    out[0] = bias
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most train_rows labelled documents outside the held-out fold."""
    return fit(labelled(docs, labels.filter(~held_out()), "quality", train_rows), train)


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, model(docs, table(spark, sf_dir, "labels")), scorer, held_out(), CUT)
