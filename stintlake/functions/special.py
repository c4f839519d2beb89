"""Distribution functions and exact tests in plain Python, and as vectorised columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 + t * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + t / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def ln_gammas(x: np.ndarray) -> np.ndarray:
    """ln of gamma(x), x > 0, for arrays: Stirling's series, small numbers raised to 16 first."""
    y, down = np.array(x, dtype=float), np.zeros(np.shape(x))
    while (small := y < 16).any():
        down[small] += np.log(y[small])
        y[small] += 1
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y - down


def beta_incs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``beta_inc`` for arrays: the same continued fraction, from which numbers that have settled leave."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out, inside = np.where(x > 0, 1.0, 0.0), (x > 0) & (x < 1)
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a)[inside], np.where(turned, a, b)[inside], np.where(turned, 1 - x, x)[inside]
    front = np.exp(ln_gammas(a + b) - ln_gammas(a) - ln_gammas(b) + a * np.log(x) + b * np.log1p(-x)) / a
    found, at, tiny = np.empty(len(x)), np.arange(len(x)), 1e-300
    c, d, f, i = np.ones(len(x)), np.zeros(len(x)), np.ones(len(x)), 0
    while len(at):
        m = i // 2
        if i == 0:
            t = np.ones(len(at))
        elif i % 2:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 + t * d
        d = 1 / np.where(np.abs(d) > tiny, d, tiny)
        c = 1 + t / c
        c = np.where(np.abs(c) > tiny, c, tiny)
        f, i = f * c * d, i + 1
        done = (np.abs(1 - c * d) < 1e-15) | (i == 20_000)
        if done.any():
            found[at[done]] = f[done]
            a, b, x, c, d, f, at = (v[~done] for v in (a, b, x, c, d, f, at))
    part = front * (found - 1)
    out[inside] = np.where(turned[inside], 1 - part, part)
    return out


def t_two_sideds(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_incs(df / 2, 0.5, df / (df + t * t))


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - s
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 500):
        t = -i * (i - s)
        b += 2
        d = 1 / (t * d + b if abs(t * d + b) > tiny else tiny)
        c = b + t / c
        c = c if abs(c) > tiny else tiny
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, max(x, 0.0) / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(x, 0.0)))


def bisect(f: Callable[[float], float], target: float, low: float, high: float) -> float:
    """Where a growing function reaches the target."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def beta_quantile(q: float, a: float, b: float) -> float:
    return bisect(lambda x: beta_inc(a, b, x), q, 0.0, 1.0)


def t_quantile(q: float, df: float) -> float:
    return bisect(lambda t: 1 - t_two_sided(t, df) / 2 if t > 0 else t_two_sided(t, df) / 2, q, -1e4, 1e4)


def ln_poisson(k: int, mu: float) -> float:
    return k * math.log(mu) - mu - math.lgamma(k + 1) if mu > 0 else (0.0 if k == 0 else -math.inf)


@lru_cache(maxsize=8)
def _ln_factorials(top: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])


def ln_factorials(n: int) -> np.ndarray:
    """ln(0!) to ln(n!) at least."""
    return _ln_factorials(1 << max(10, n.bit_length()))


def poisson_two_sided(k: int, mu: float) -> float:
    """Sum of all outcomes no likelier than k."""
    if mu <= 0:
        return 1.0 if k == 0 else 0.0
    i = np.arange(math.ceil(mu + 12 * math.sqrt(mu) + 20) + k + 1)
    ln = i * math.log(mu) - mu - ln_factorials(len(i))[: len(i)]
    return min(1.0, float(np.exp(ln[ln <= ln[k] + 1e-7]).sum()))


def ln_binomials(n: int, p: float) -> np.ndarray:
    """The log chances of 0 to n successes."""
    i, f = np.arange(n + 1), ln_factorials(n)
    if p <= 0 or p >= 1:
        return np.where(i == (0 if p <= 0 else n), 0.0, -np.inf)
    return f[n] - f[i] - f[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of all outcomes no likelier than k."""
    ln = ln_binomials(n, p)
    return min(1.0, float(np.exp(ln[ln <= ln[k] + math.log1p(1e-7)]).sum()))


def binomial_two_sideds(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``binomial_two_sided`` for arrays, 0 < p < 1: outcomes grow likelier up to the likeliest and less likely after it, so those no
    likelier than k are two tails; their ends are searched for, and each is an incomplete beta function."""
    k, n, p = np.asarray(k, dtype=float), np.asarray(n, dtype=float), np.asarray(p, dtype=float)
    lp, lq, whole_n = np.log(p), np.log1p(-p), ln_gammas(n + 1)
    ln = lambda x: whole_n - ln_gammas(x + 1) - ln_gammas(n - x + 1) + x * lp + (n - x) * lq
    if len(n) and n.max() < 1_000_000:  # of the sizes in hand, read off a list
        table = ln_gammas(np.arange(n.max() + 1) + 1)
        ln = lambda x: whole_n - table[x.astype(int)] - table[(n - x).astype(int)] + x * lp + (n - x) * lq
    most, top = ln(k) + math.log1p(1e-7), np.clip(np.floor((n + 1) * p), 0, n)

    def last(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        """The outcome next to ``no`` that is no likelier than k, on the way there from ``yes``, which lies outside."""
        while (np.abs(no - yes) > 1).any():
            mid = np.clip(np.floor((yes + no) / 2), 0, n)
            low = ln(mid) <= most
            wide = np.abs(no - yes) > 1
            yes, no = np.where(wide & low, mid, yes), np.where(wide & ~low, mid, no)
        return yes

    low, high = last(np.full(len(n), -1.0), top), last(n + 1, top)
    left = np.where(low >= 0, beta_incs(np.maximum(n - low, 0.5), np.maximum(low + 1, 0.5), 1 - p), 0.0)
    right = np.where(high <= n, beta_incs(np.maximum(high, 0.5), np.maximum(n - high + 1, 0.5), p), 0.0)
    return np.where(ln(top) <= most, 1.0, np.minimum(left + right, 1.0))


def binomial_rejected(n: int, p: float, level: float = 0.05) -> np.ndarray:
    """For 0 to n successes, whether the two-sided exact test rejects p at the level."""
    ln = ln_binomials(n, p)
    order = np.argsort(ln)
    sums = np.cumsum(np.exp(ln[order]))
    upto = np.searchsorted(ln[order], ln + math.log1p(1e-7), side="right")  # all no likelier
    return sums[upto - 1] < level


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2 x 2 table: all tables of its margins no likelier than it."""
    r, s, n = a + b, a + c, a + b + c + d

    def ln(x: int) -> float:
        return math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(s - x + 1) - math.lgamma(n - r - s + x + 1)

    at = ln(a) + 1e-7
    every = [ln(x) for x in range(max(0, r + s - n), min(r, s) + 1)]
    top = max(every)
    return min(1.0, sum(math.exp(v - top) for v in every if v <= at) / sum(math.exp(v - top) for v in every))


def wilcoxon(differences: list[float]) -> tuple[float, float, int]:
    """Signed-rank test: sum of positive ranks, two-sided p, pairs used. Exact up to 50 pairs without zeros."""
    d = [x for x in differences if x]
    n, zeros = len(d), len(d) != len(differences)
    if not n:
        return 0.0, 1.0, 0
    order = sorted(range(n), key=lambda i: abs(d[i]))
    ranks, i, ties = [0.0] * n, 0, 0.0
    while i < n:
        j = i
        while j + 1 < n and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    w = sum(r for r, x in zip(ranks, d) if x > 0)
    if n <= 50 and not zeros:
        ways = {0: 1}
        for r in (round(2 * r) for r in ranks):
            more: dict[int, int] = dict(ways)
            for s, m in ways.items():
                more[s + r] = more.get(s + r, 0) + m
            ways = more
        low = sum(m for s, m in ways.items() if s <= 2 * w)
        high = sum(m for s, m in ways.items() if s >= 2 * w)
        return w, min(1.0, 2 * min(low, high) / 2**n), n
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return w, normal_two_sided((w - mean) / math.sqrt(var)) if var > 0 else 1.0, n


def column(f: Callable[..., float], *args: Column) -> Column:
    """A function of numbers as a column, computed once for each distinct set of arguments of a batch; null where one is null."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        rows = pd.concat(series, axis=1, keys=range(len(series)))
        group = rows.groupby(list(rows.columns), sort=False, dropna=False).ngroup()
        first = rows[~group.duplicated()]
        values = np.array([np.nan if any(pd.isna(v) for v in row) else f(*row) for row in first.itertuples(index=False)], dtype=float)
        out = values[group.to_numpy()] if len(rows) else values
        return pd.Series(out).astype(object).where(~np.isnan(out), None) if len(rows) else pd.Series([], dtype="float64")

    return run(*args)


def columns(f: Callable[..., np.ndarray], *args: Column) -> Column:
    """A function of arrays as a column; null where an argument is null."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        known = ~np.any([s.isna() for s in series], axis=0)
        out = pd.Series(np.nan, index=series[0].index, dtype="Float64")
        if known.any():
            out[known] = f(*[s[known].to_numpy(dtype=float) for s in series])
        return out.mask(~known)

    return run(*args)


def whole(f: Callable[..., float], n: int) -> Callable[..., float]:
    """f with its first n arguments made integers."""
    return lambda *a: f(*[int(v) for v in a[:n]], *a[n:])


def normal_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def normal_quantile(q: float) -> float:
    return bisect(normal_cdf, q, -40.0, 40.0)


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation of n pairs by Student's t; 0 for a perfect one."""
    if n < 3:
        return math.nan
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
