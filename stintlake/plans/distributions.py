"""Distributions as arrays: position k holds the chance of k."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHANCES = T.ArrayType(T.DoubleType())
#: Lengths from which two distributions are multiplied by their transforms, and the parts that a key's terms are dealt into.
LONG, PARTS = 512, (4096, 64, 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distribution of the sum of two independent counts; long ones by fast Fourier transforms, exact to about 1e-16."""
    n = len(a) + len(b) - 1
    if min(len(a), len(b)) < LONG:
        return np.convolve(a, b)
    size = 1 << (n - 1).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0)


def product_of(parts: list[np.ndarray]) -> np.ndarray:
    """The distribution of a sum of many, in a tree, so that lengths stay alike."""
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.ones(1)


def binomial(p: float, n: int) -> np.ndarray:
    """The distribution of n equal chances, by its ratio from one count to the next, from the likeliest outwards."""
    if p <= 0 or p >= 1:
        out = np.zeros(n + 1)
        out[n if p >= 1 else 0] = 1.0
        return out
    top = min(int((n + 1) * p), n)
    k = np.arange(n)
    steps = np.log(n - k) - np.log(k + 1) + math.log(p) - math.log1p(-p)  # ln of chance(k + 1) / chance(k)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    out = np.exp(logs - logs[top])
    return out / out.sum()


@F.pandas_udf(CHANCES)
def equal_chances(p: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial(a, b) for a, b in zip(p, n)])


@F.pandas_udf(CHANCES)
def multiplied(parts: pd.Series) -> pd.Series:
    return pd.Series([product_of([np.asarray(x) for x in group]) for group in parts])


@F.pandas_udf(CHANCES)
def powered(d: pd.Series, n: pd.Series) -> pd.Series:
    """The distribution of the sum of n counts of one distribution, by squaring."""

    def power(x: np.ndarray, n: int) -> np.ndarray:
        out = np.ones(1)
        while n:
            out = product(out, x) if n & 1 else out
            n >>= 1
            x = product(x, x) if n else x
        return out

    return pd.Series([power(np.asarray(x), int(k)) for x, k in zip(d, n)])


def success_distributions(rows: DataFrame, keys: list[str], chance: str) -> DataFrame:
    """``keys, d``: the distribution of how many of a key's independent chances come true.

    Equal chances are counted first; the distributions of different ones are multiplied in parts of a key, then parts of parts, so a
    key that has most rows is many tasks' work until the last products, which are as long as its distribution.
    """
    d = rows.groupBy(*keys, chance).agg(F.count("*").cast("int").alias("_n"))
    d = d.select(*keys, F.pmod(F.xxhash64(chance), F.lit(PARTS[0])).alias("_part"), equal_chances(F.col(chance), F.col("_n")).alias("d"))
    for parts in PARTS:
        d = d.groupBy(*keys, F.pmod("_part", F.lit(parts)).alias("_part")).agg(F.collect_list("d").alias("d")).select(*keys, "_part", multiplied("d").alias("d"))
    return d.drop("_part")


def mean_of(d: Column) -> Column:
    return F.aggregate(F.transform(d, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)


def total(d: Column) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x)


def poisson_chance(k: Column, mean: Column) -> Column:
    """The Poisson chance of k, for any k and mean > 0; from 16 on by Stirling's series about k, so that no large terms cancel."""
    small = F.exp(k * F.ln(mean) - mean - F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), k))
    x = k.cast("double")
    rest = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k < 16, small).otherwise(F.exp(x * F.ln(mean / x) + (x - mean) - rest) / F.sqrt(2 * math.pi * x))


def poisson_duel(a: Column, b: Column) -> Column:
    """``win, tie``: the chances that a Poisson count of mean a is above or equal to one of mean b.

    One pass over all counts that either reaches: from 12 roots of its mean below the smaller mean to 12 above the larger,
    and 30 more, so what lies outside is below 1e-30 at any mean.
    """
    small, large = F.least(a, b), F.greatest(a, b)
    low = F.greatest(F.floor(small - 12 * F.sqrt(small) - 30), F.lit(0)).cast("int")
    high = F.ceil(large + 12 * F.sqrt(large) + 30).cast("int")
    zero = F.lit(0.0)

    def step(s: Column, p: Column) -> Column:
        return F.struct((s["below"] + p["b"]).alias("below"), (s["win"] + p["a"] * s["below"]).alias("win"), (s["tie"] + p["a"] * p["b"]).alias("tie"))

    chances = F.transform(F.sequence(low, high), lambda k: F.struct(poisson_chance(k, a).alias("a"), poisson_chance(k, b).alias("b")))
    return F.aggregate(chances, F.struct(zero.alias("below"), zero.alias("win"), zero.alias("tie")), step)
