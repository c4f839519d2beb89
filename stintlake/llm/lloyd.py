"""What the exact Lloyd operators share: integer vectors, and means of clusters from sums that tasks have added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "slot int, n long, sums array<long>"
SUMS_ARROW = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def finite(col: str) -> Column:
    """Whether an array column is not null and holds finite numbers only."""
    return F.coalesce(~F.exists(F.col(col), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error where squared distances would not fit a long."""
    v = np.floor(np.asarray(x, "f8") * scale)
    limit = 2**30 / x.shape[1] ** 0.5
    if len(v) and np.abs(v).max() > limit:
        raise ValueError(f"components past {limit / scale:g} have squared distances that don't fit a long")
    return v.astype("i8")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers, row by row or broadcast."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def seeds(rows: DataFrame, order: list[Column], k: int, scale: int) -> np.ndarray:
    """The integer vectors of the k rows (vec_id, x) that come first; rows without an id come last, ties by the vector."""
    found = rows.orderBy(F.col("vec_id").isNull(), *order, "x").limit(k).select("x").collect()  # k rows
    return integers(np.array([r["x"] for r in found], "f8").reshape(len(found), -1), scale) if found else np.empty((0, 0), "i8")


class Sums:
    """Counts and component sums by slot, of one task."""

    def __init__(self, slots: int, dims: int):
        self.n, self.sums = np.zeros(slots, "i8"), np.zeros((slots, dims), "i8")

    def add(self, slot: np.ndarray, x: np.ndarray, weight: np.ndarray | None = None) -> None:
        np.add.at(self.n, slot, 1 if weight is None else weight)
        np.add.at(self.sums, slot, x)

    def rows(self) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(self.n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(self.n[used]), pa.array(list(self.sums[used]), pa.list_(pa.int64()))], schema=SUMS_ARROW)


def floor_means(parts: DataFrame, old: np.ndarray) -> np.ndarray:
    """The centres after a round: floor(sum / count) of each slot that has rows, the old ones elsewhere.

    parts: slot, n, sums of each task. What reaches the driver is a number for each component of each centre.
    """
    wide = parts.select("slot", "n", F.posexplode("sums").alias("i", "s"))
    sums = wide.groupBy("slot", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect()
    new = old.copy()
    for r in sums:
        new[r["slot"], r["i"]] = int(r["s"]) // r["n"]
    return new
