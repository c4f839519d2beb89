"""Many logistic regressions with Firth's correction in the same passes: subsets of the columns, and fits without one row each.

A pass sums, for every fit that is still open, the score, the information and the products of three columns from which Firth's
correction of the score follows, so a step needs one pass over rows that stay where they are, and a row of sums a fit reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.functions import special as S

#: Fits that go through the rows together; the longest change of a term in a step, and what counts as none.
FITS, LONGEST, NONE = 1024, 5.0, 1e-9


@dataclass
class FirthFit:
    """A fit of some of the columns (``used``) to all rows but that whose key is ``out``, if any. ``covariance`` is of these columns."""

    used: tuple[int, ...]
    out: object = None
    beta: np.ndarray | None = None
    covariance: np.ndarray | None = None
    open: bool = True

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))

    @property
    def p(self) -> np.ndarray:
        return np.array([S.normal_two_sided(float(b / s)) if s > 0 else np.nan for b, s in zip(self.beta, self.se)])

    def step(self, score: np.ndarray, information: np.ndarray, cubes: np.ndarray) -> None:
        u = np.array(self.used)
        h = information[np.ix_(u, u)]
        if np.linalg.matrix_rank(h) < len(u):
            self.beta = self.covariance = None
            self.open = False
            return
        self.covariance = np.linalg.inv(h)
        change = self.covariance @ (score[u] + np.einsum("ab,abr->r", self.covariance, cubes[np.ix_(u, u, u)]))
        change *= min(1.0, LONGEST / max(np.abs(change).max(), 1e-300))
        self.beta = self.beta + change
        self.open = np.abs(change).max() >= NONE


def _summing(used: np.ndarray, beta: np.ndarray, out: list, x: list[str], y: str, key: str) -> Callable:
    k = len(x)
    pairs, triples = (np.array(list(combinations_with_replacement(range(k), n))) for n in (2, 3))
    names = ["n", *[f"s{i}" for i in range(k + len(pairs) + len(triples))]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, at = np.zeros((len(beta), len(names) - 1)), {}
        for n, o in enumerate(out):
            if o is not None:
                at.setdefault(o, []).append(n)
        for pdf in batches:
            z = pdf[x].to_numpy(float)
            lacks = np.isnan(z)
            z = np.where(lacks, 0.0, z)
            there = (lacks @ used.T == 0).astype(float)
            for row, value in enumerate(pdf[key]):
                there[row, at.get(value, [])] = 0.0
            p = 1 / (1 + np.exp(-np.clip(z @ beta.T, -500, 500)))
            w = p * (1 - p) * there
            total[:, :k] += ((pdf[y].to_numpy(float)[:, None] - p) * there).T @ z
            total[:, k : k + len(pairs)] += w.T @ z[:, pairs].prod(axis=2)
            total[:, k + len(pairs) :] += (w * (0.5 - p)).T @ z[:, triples].prod(axis=2)
        yield pd.DataFrame(np.c_[np.arange(len(beta)), total], columns=names).astype({"n": int})

    return run


def _pass(rows: DataFrame, x: list[str], y: str, key: str, fits: list[FirthFit]) -> None:
    k = len(x)
    used, beta = np.zeros((len(fits), k)), np.zeros((len(fits), k))
    for n, f in enumerate(fits):
        used[n, list(f.used)], beta[n, list(f.used)] = 1, f.beta
    width = k + k * (k + 1) // 2 + k * (k + 1) * (k + 2) // 6
    schema = "n long, " + ", ".join(f"s{i} double" for i in range(width))
    sums = rows.mapInPandas(_summing(used, beta, [f.out for f in fits], x, y, key), schema).groupBy("n").agg(*[F.sum(f"s{i}") for i in range(width)])
    for n, *s in sums.collect():
        h, c, left = np.zeros((k, k)), np.zeros((k, k, k)), iter(s[k:])
        for i, j in combinations_with_replacement(range(k), 2):
            h[i, j] = h[j, i] = next(left)
        for a, b, d in combinations_with_replacement(range(k), 3):
            v = next(left)
            for at in {(a, b, d), (a, d, b), (b, a, d), (b, d, a), (d, a, b), (d, b, a)}:
                c[at] = v
        fits[n].step(np.array(s[:k]), h, c)


def run_fits(rows: DataFrame, x: list[str], y: str, key: str, fits: list[FirthFit], steps: int = 100) -> None:
    """Fit all of them, FITS at a time. rows: key, doubles x (1.0 for an intercept) and y (0 or 1), none of these null but x. A row with
    a null in a fit's columns takes no part in it. ``beta`` is None where a fit's columns depend on each other or no row is left."""
    for f in fits:
        f.beta = np.zeros(len(f.used)) if f.beta is None else f.beta
    for start in range(0, len(fits), FITS):
        for _ in range(steps):
            going = [f for f in fits[start : start + FITS] if f.open]
            if not going:
                break
            _pass(rows, x, y, key, going)
            for f in going:
                if f.covariance is None:
                    f.beta, f.open = None, False


def leave_one_out(rows: DataFrame, x: list[str], y: str, key: str) -> tuple[int, int]:
    """How many rows the fit of all others puts on the right side of a half, and of how many. Keys are unique; rows as in ``run_fits``,
    those with a null in x left out. A row without which nothing can be fitted counts as wrong.

    The rows are the questions, FITS at a time. Each fit starts where one step away from the fit of all rows leads: the information
    without a row is a rank-one change of the whole one.
    """
    rows = rows.dropna(subset=x)
    whole = FirthFit(tuple(range(len(x))))
    run_fits(rows, x, y, key, [whole])
    asked, right, n = rows.select(key, *x, y).toLocalIterator(), 0, 0
    while block := list(islice(asked, FITS)):
        points, fits = np.array([r[1:-1] for r in block], float), []
        for r, z in zip(block, points):
            start = None
            if whole.beta is not None:
                p = 1 / (1 + np.exp(-z @ whole.beta))
                reach = whole.covariance @ z
                start = whole.beta - reach * (r[-1] - p) / max(1 - p * (1 - p) * (z @ reach), 0.1)
            fits.append(FirthFit(whole.used, r[0], start))
        run_fits(rows, x, y, key, fits)
        right += sum(f.beta is not None and (z @ f.beta > 0) == (r[-1] > 0.5) for f, z, r in zip(fits, points, block))
        n += len(block)
    return int(right), n
