"""Logistic models of single rows that are fitted to the totals of groups of rows, for all rows and without each fold in turn.

All fits of a block go through the rows together: a look at them is one aggregate by fit and group and one by fit, whatever
the number of rows in a group, and a row of sums a fit reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.session import written

#: What is added to a group's total before it is inverted to a weight, and the ridge of the slopes.
WEIGHT_FLOOR, SLOPE_RIDGE = 0.05, 1e-3
#: Fits that look at the rows together, and the fewest folds that can be left out.
FITS, FEWEST_FOLDS = 64, 2


def chance(beta: list, x: list[Column]) -> Column:
    """The model's chance of a row; beta holds numbers or columns, the intercept first."""
    as_column = [b if isinstance(b, Column) else F.lit(float(b)) for b in beta]
    eta = sum((b * c for b, c in zip(as_column[1:], x)), as_column[0])
    return 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(40.0)), F.lit(-40.0))))


@dataclass
class _Fit:
    fold: object
    beta: np.ndarray
    value: float = math.inf
    gradient: np.ndarray | None = None
    normal: np.ndarray | None = None
    damping: float = 1e-3
    tries: int = 0
    open: bool = True

    def proposal(self) -> np.ndarray:
        if self.gradient is None:
            return self.beta
        return self.beta + np.linalg.solve(self.normal + self.damping * np.diag(np.maximum(np.diag(self.normal), 1e-9)), self.gradient)

    def judge(self, beta: np.ndarray, value: float, gradient: np.ndarray, normal: np.ndarray, tol: float) -> None:
        first, moved = self.gradient is None, np.abs(beta - self.beta).max()
        if not first and value >= self.value:
            self.damping, self.tries = self.damping * 4, self.tries + 1
            self.open = self.tries < 30 and moved > 1e-8
            return
        gained = self.value - value
        self.beta, self.value, self.gradient, self.normal, self.tries = beta, value, gradient, normal, 0
        if not first:
            self.damping = max(self.damping / 3, 1e-9)
            self.open = gained >= tol * (1 + value)


def _look(base: DataFrame, group: list[str], fits: list[_Fit], betas: list[np.ndarray]) -> dict[int, tuple]:
    """Of each fit its loss, half the descent and the normal matrix at a beta."""
    k = len(betas[0])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sent = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f.fold).cast(base.schema["_fold"].dataType).alias("out"), F.array(*[F.lit(float(v)) for v in b]).alias("b")) for n, (f, b) in enumerate(zip(fits, betas))])
    d = base.withColumn("_f", F.explode(sent)).filter(F.col("_f.out").isNull() | (F.col("_f.out") != F.col("_fold")))
    d = d.withColumn("_p", chance([F.col("_f.b")[i] for i in range(k)], [F.col(f"_x{i}") for i in range(1, k)])).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
    by = d.groupBy(F.col("_f.n").alias("n"), *group).agg(F.max("_t").alias("t"), F.sum("_p").alias("p"), *[F.sum(F.col("_w") * F.col(f"_x{i}") if i else F.col("_w")).alias(f"j{i}") for i in range(k)])
    w, miss = 1 / (F.col("t") + WEIGHT_FLOOR), F.col("t") - F.col("p")
    sums = by.groupBy("n").agg(F.sum(w * miss * miss), *[F.sum(w * miss * F.col(f"j{i}")) for i in range(k)], *[F.sum(w * F.col(f"j{i}") * F.col(f"j{j}")) for i, j in pairs])
    ridge, out = np.r_[0.0, np.full(k - 1, SLOPE_RIDGE)], {}
    for n, *s in sums.collect():
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, s[1 + k :]):
            h[i, j] = h[j, i] = v
        out[n] = s[0] + float(ridge @ betas[n] ** 2), np.array(s[1 : 1 + k], float) - ridge * betas[n], h + np.diag(ridge)
    return out


def _run(base: DataFrame, group: list[str], fits: list[_Fit], steps: int, tol: float) -> None:
    for _ in range(steps):
        going = [f for f in fits if f.open]
        if not going:
            return
        betas = [f.proposal() for f in going]
        for n, seen in _look(base, group, going, betas).items():
            going[n].judge(betas[n], *seen, tol)


def _base(rows: DataFrame, x: list[str], group: list[str], total: str, fold: str | None) -> DataFrame:
    b = rows.select(*group, F.col(total).cast("double").alias("_t"), (F.col(fold) if fold else F.lit(0)).alias("_fold"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x, 1)])
    return b.dropna(subset=[c for c in b.columns if c.startswith("_")])


def _sizes(base: DataFrame, group: list[str]) -> list[tuple]:
    """``fold, rows, total, groups``, a row a fold."""
    g = base.groupBy("_fold", *group).agg(F.count("*").alias("n"), F.max("_t").alias("t"))
    return [tuple(r) for r in g.groupBy("_fold").agg(F.sum("n"), F.sum("t"), F.count("*")).orderBy("_fold").collect()]


def _fit_whole(base: DataFrame, group: list[str], k: int, sizes: list[tuple], steps: int, tol: float) -> np.ndarray | None:
    n, t, groups = (sum(s[i] for s in sizes) for i in (1, 2, 3))
    if not n or not t or groups < k:
        return None
    rate = min(max(t / n, 1e-4), 1 - 1e-4)
    whole = _Fit(None, np.r_[math.log(rate / (1 - rate)), np.zeros(k - 1)])
    _run(base, group, [whole], steps, tol)
    return whole.beta


def logistic_to_totals(rows: DataFrame, x: list[str], group: list[str], total: str, steps: int = 200, tol: float = 1e-13) -> np.ndarray | None:
    """Intercept and slopes of a logistic model whose chances add up to each group's total as nearly as can be (weights 1 / (total +
    0.05)), by damped least squares. Rows with a null total or feature take no part; no rows, only zero totals, or fewer groups than
    terms give None.
    """
    base = _base(rows, x, group, total, None)
    return _fit_whole(base, group, len(x) + 1, _sizes(base, group), steps, tol)


def without_each_fold(rows: DataFrame, x: list[str], group: list[str], total: str, fold: str, steps: int = 200, tol: float = 1e-13) -> tuple[np.ndarray | None, list[tuple]]:
    """The fit of all rows, and for every value of ``fold`` (fold, mean total a row of the others, beta of the others or None).

    A group lies in one fold. The fits without a fold start from that of all rows and go through the rows FITS at a time. A null fold
    takes no part.
    """
    base = written(_base(rows, x, group, total, fold), "totals")
    k, sizes = len(x) + 1, _sizes(base, group)
    whole = _fit_whole(base, group, k, sizes, steps, tol)
    if whole is None:
        return None, [(s[0], None, None) for s in sizes]
    n, t, groups = (sum(s[i] for s in sizes) for i in (1, 2, 3))
    out = []
    for at in range(0, len(sizes), FITS):
        block = sizes[at : at + FITS]
        fits = {f: _Fit(f, whole.copy(), damping=1e-6) for f, fn, ft, fg in block if n - fn and t - ft > 0 and groups - fg >= k}
        _run(base, group, list(fits.values()), steps, tol)
        out += [(f, (t - ft) / (n - fn) if n > fn else None, fits[f].beta if f in fits else None) for f, fn, ft, _ in block]
    return whole, out


def holdout(rows: DataFrame, x: list[str], group: list[str], total: str, fold: str, left_out: list[tuple]) -> DataFrame:
    """``folds, model_error, flat_error``, one row: how far each group's total lies from what the fit without its fold gives, and from as
    many times the mean total a row of the other folds, both as mean absolute errors over the groups. Fewer than two folds, or one
    without which nothing can be fitted, give nulls.
    """
    spark, k = rows.sparkSession, len(x) + 1
    ready = len(left_out) >= FEWEST_FOLDS and all(b is not None for _, _, b in left_out)
    if not ready:
        return spark.createDataFrame([(len(left_out), None, None)], "folds long, model_error double, flat_error double")
    base = _base(rows, x, group, total, fold)
    kind = base.schema["_fold"].dataType.simpleString()
    fits = spark.createDataFrame([(f, float(flat), [float(v) for v in b]) for f, flat, b in left_out], f"_fold {kind}, _flat double, _b array<double>")
    d = base.join(fits, "_fold").withColumn("_p", chance([F.col("_b")[i] for i in range(k)], [F.col(f"_x{i}") for i in range(1, k)]))
    g = d.groupBy("_fold", *group).agg(F.max("_t").alias("t"), F.sum("_p").alias("p"), F.sum("_flat").alias("flat"))
    return g.agg(F.lit(len(left_out)).cast("long").alias("folds"), F.avg(F.abs(F.col("p") - F.col("t"))).alias("model_error"), F.avg(F.abs(F.col("flat") - F.col("t"))).alias("flat_error"))


def explained(rows: DataFrame, x: list[str], group: list[str], total: str, beta: np.ndarray) -> DataFrame:
    """``r2``, one row: the share of the spread of the groups' totals that the model's sums explain (null without spread)."""
    g = _base(rows, x, group, total, None).withColumn("_p", chance(list(beta), [F.col(f"_x{i}") for i in range(1, len(x) + 1)]))
    g = g.groupBy(*group).agg(F.max("_t").alias("t"), F.sum("_p").alias("p"))
    return g.agg((1 - F.sum((F.col("t") - F.col("p")) ** 2) / F.nullif(F.var_pop("t") * F.count("t"), F.lit(0.0))).alias("r2"))
