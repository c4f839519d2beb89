"""Regressions fitted from sums: every step is one aggregate over the rows, and only k x k sums reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    beta: np.ndarray
    covariance: np.ndarray
    loglik: float
    deviance: float
    steps: int

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))


def _dot(beta: np.ndarray, x: list[Column]) -> Column:
    return sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))


def _sums(df: DataFrame, columns: list[Column]) -> np.ndarray:
    row = df.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return np.array([0.0 if v is None else float(v) for v in row])


def gram(df: DataFrame, x: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'X, X'y, y'y and the number of rows."""
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = _sums(df, [x[i] * x[j] for i, j in pairs] + [c * y for c in x] + [y * y, F.lit(1.0)])
    g = np.zeros((k, k))
    for (i, j), v in zip(pairs, s):
        g[i, j] = g[j, i] = v
    return g, s[len(pairs) : len(pairs) + k], s[-2], s[-1]


def ols(df: DataFrame, x: list[Column], y: Column) -> dict:
    """Least squares with an intercept: coefficients, errors, t, R2, adjusted R2 and F; None unless rows exceed terms."""
    g, xy, yy, n = gram(df, [F.lit(1.0), *x], y)
    k = len(x) + 1
    if n <= k or np.linalg.matrix_rank(g) < k:
        return None
    beta = np.linalg.solve(g, xy)
    rss, tss = yy - beta @ xy, yy - xy[0] ** 2 / n
    se = np.sqrt(np.diag(np.linalg.inv(g)) * rss / (n - k))
    r2 = 1 - rss / tss if tss > 0 else math.nan
    return {"beta": beta, "se": se, "t": beta / se, "r2": r2, "adjusted": 1 - (1 - r2) * (n - 1) / (n - k), "f": (tss - rss) / (k - 1) / (rss / (n - k)), "df": n - k}


def ridge(df: DataFrame, x: list[Column], y: Column, penalty: float) -> np.ndarray:
    """Intercept and slopes of a ridge whose intercept is not penalised."""
    g, xy, _, n = gram(df, [F.lit(1.0), *x], y)
    mean, m = xy[0] / n, g[0, 1:] / n
    centred = g[1:, 1:] - n * np.outer(m, m)
    slopes = np.linalg.solve(centred + penalty * np.eye(len(x)), xy[1:] - n * m * mean)
    return np.concatenate([[mean - m @ slopes], slopes])


def glm(df: DataFrame, x: list[Column], y: Column, family: str, offset: Column | None = None, penalty: np.ndarray | None = None, steps: int = 60, tol: float = 1e-10) -> Fit:
    """Poisson or logistic regression by damped Newton steps; penalty: half of it times beta squared is subtracted."""
    k, off = len(x), F.lit(0.0) if offset is None else offset
    lam = np.zeros(k) if penalty is None else np.asarray(penalty, float)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], y.cast("double").alias("y"), off.cast("double").alias("o"))
    xs = [F.col(f"x{i}") for i in range(k)]

    def look(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = F.greatest(F.least(_dot(beta, xs) + F.col("o"), F.lit(50.0)), F.lit(-50.0))
        d = rows.withColumn("eta", eta)
        if family == "poisson":
            mu, w, ll = F.exp("eta"), F.exp("eta"), F.col("y") * F.col("eta") - F.exp("eta")
        else:
            mu = 1 / (1 + F.exp(-F.col("eta")))
            w, ll = mu * (1 - mu), F.col("y") * F.col("eta") - F.log1p(F.exp("eta"))
        s = _sums(d.withColumn("mu", mu).withColumn("w", w), [ll, *[(F.col("y") - F.col("mu")) * c for c in xs], *[F.col("w") * xs[i] * xs[j] for i, j in pairs]])
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, s[1 + k :]):
            h[i, j] = h[j, i] = v
        return s[0] - 0.5 * lam @ beta**2, s[1 : 1 + k] - lam * beta, h + np.diag(lam)

    beta = np.zeros(k)
    value, gradient, hessian = look(beta)
    done = 0
    for done in range(1, steps + 1):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        for _ in range(40):
            new = look(beta + step)
            if new[0] >= value - 1e-12:
                break
            step = step / 2
        gain, beta = new[0] - value, beta + step
        value, gradient, hessian = new
        if np.abs(step).max() < 1e-9 or abs(gain) < tol * (1 + abs(value)) and np.abs(gradient).max() < 1e-7:
            break
    loglik = value + 0.5 * lam @ beta**2
    saturated = _sums(rows, [F.when(F.col("y") > 0, F.col("y") * F.ln("y") - F.col("y")).otherwise(0.0) if family == "poisson" else F.lit(0.0)])[0]
    return Fit(beta, np.linalg.pinv(hessian), loglik, 2 * (saturated - loglik), done)


def firth(df: DataFrame, x: list[Column], y: Column, steps: int = 100, tol: float = 1e-9) -> Fit:
    """Logistic regression with Firth's bias correction; finite on separated data. Two aggregates a step."""
    k = len(x)
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], y.cast("double").alias("y"))
    xs, pairs = [F.col(f"x{i}") for i in range(k)], [(i, j) for i in range(k) for j in range(i, k)]
    beta, inverse, done = np.zeros(k), np.eye(k), 0
    for done in range(1, steps + 1):
        mu = 1 / (1 + F.exp(-_dot(beta, xs)))
        d = rows.withColumn("mu", mu)
        w = F.col("mu") * (1 - F.col("mu"))
        s = _sums(d, [w * xs[i] * xs[j] for i, j in pairs])
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, s):
            h[i, j] = h[j, i] = v
        inverse = np.linalg.inv(h)
        lever = w * sum((float(inverse[i, j]) * xs[i] * xs[j] for i in range(k) for j in range(k)), F.lit(0.0))
        score = _sums(d, [(F.col("y") - F.col("mu") + lever * (0.5 - F.col("mu"))) * c for c in xs])
        step = inverse @ score
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    eta = _dot(beta, xs)
    return Fit(beta, inverse, float(_sums(rows, [F.col("y") * eta - F.log1p(F.exp(eta))])[0]), math.nan, done)
