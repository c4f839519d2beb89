"""Poisson models with a few fixed terms and a level for every group, of which there may be any number.

The normal equations are an arrowhead: a level shares rows with the fixed terms alone. So each group is a row of sums, a Newton
step is worked out from what the groups add to the few fixed terms' equations, and each level's own step follows from its sums.
Several penalties are fitted side by side in the same passes. Only numbers of the fixed terms reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.session import written


@dataclass
class Levels:
    """One fit: fixed terms with their errors, the log likelihood, Laplace's marginal one, and the levels (group, level, se)."""

    penalty: float
    beta: np.ndarray
    se: np.ndarray
    loglik: float
    marginal: float
    levels: DataFrame


def fit_levels(obs: DataFrame, x: list[Column], y: Column, offset: Column, group: str, penalties: list[float], fixed: list[float], rounds: int = 60, tol: float = 1e-9) -> list[Levels]:
    """A fit for each penalty on the levels. x: fixed terms, the intercept first; fixed: their penalties; offset: ln of exposure.

    Steps are limited to 2 in a level and a term, so that a first step from afar can't run away. Rows without a group are left out.
    """
    k, n = len(x), len(penalties)
    rows = written(obs.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], y.cast("double").alias("y"), offset.cast("double").alias("o")), "rows")
    start = rows.agg(F.sum("y"), F.sum(F.exp("o"))).first()
    if start[0] is None:
        return []
    beta = np.zeros((n, k))
    beta[:, 0] = np.log(max(start[0], 1e-9) / start[1])
    of = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("fit"))
    lam, pen, xs = of(penalties), np.array(fixed), [F.col(f"x{i}") for i in range(k)]
    state = written(rows.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fit"), F.lit(0.0).alias("u"), F.lit(0.0).alias("step")), "levels")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        eta = F.col("o") + F.col("u") + sum((of(beta[:, i]) * xs[i] for i in range(k)), F.lit(0.0))
        each = rows.join(state, "g").withColumn("eta", F.greatest(F.least(eta, F.lit(50.0)), F.lit(-50.0))).withColumn("mu", F.exp("eta")).withColumn("r", F.col("y") - F.col("mu"))
        sums = [F.sum("mu").alias("a"), F.sum("r").alias("r"), F.sum(F.col("y") * F.col("eta") - F.col("mu")).alias("ll")]
        sums += [F.sum(F.col("mu") * xs[i]).alias(f"b{i}") for i in range(k)] + [F.sum(F.col("r") * xs[i]).alias(f"g{i}") for i in range(k)] + [F.sum(F.col("mu") * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in pairs]
        groups = written(each.groupBy("fit", "g", "u", "step").agg(*sums).withColumn("d", F.col("a") + lam).withColumn("q", F.col("r") - lam * F.col("u")), "sums")
        left = [F.sum(F.col(f"h{i}_{j}") - F.col(f"b{i}") * F.col(f"b{j}") / F.col("d")).alias(f"s{i}_{j}") for i, j in pairs]
        side = [F.sum(F.col(f"g{i}") - F.col(f"b{i}") * F.col("q") / F.col("d")).alias(f"t{i}") for i in range(k)]
        rest = [F.sum("ll").alias("ll"), F.sum(F.col("u") ** 2).alias("uu"), F.sum(F.log1p(F.col("a") / lam)).alias("ld"), F.max(F.abs("step")).alias("step")]
        found = {r["fit"]: r for r in groups.groupBy("fit").agg(*left, *side, *rest).collect()}  # a row a penalty
        inverse, move = np.zeros((n, k, k)), np.zeros((n, k))
        for f, r in found.items():
            s = np.diag(pen)
            for i, j in pairs:
                s[i, j] += r[f"s{i}_{j}"]
                s[j, i] = s[i, j]
            inverse[f] = np.linalg.inv(s)
            move[f] = np.clip(inverse[f] @ (np.array([r[f"t{i}"] for i in range(k)]) - pen * beta[f]), -2, 2)
        if max(np.abs(move).max(), max(r["step"] for r in found.values())) < tol and _:
            break
        step = (F.col("q") - sum((F.col(f"b{i}") * of(move[:, i]) for i in range(k)), F.lit(0.0))) / F.col("d")
        step = F.greatest(F.least(step, F.lit(2.0)), F.lit(-2.0))
        state = groups.select("g", "fit", (F.col("u") + step).alias("u"), step.alias("step"))
        beta = beta + move
    out = []
    for f, r in sorted(found.items()):
        spread = sum((F.col(f"b{i}") * F.col(f"b{j}") * float(inverse[f][i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
        se = F.sqrt(1 / F.col("d") + spread / F.col("d") ** 2)
        levels = groups.filter(F.col("fit") == f).select(F.col("g").alias(group), F.col("u").alias("level"), se.alias("se"))
        marginal = r["ll"] - penalties[f] * r["uu"] / 2 - r["ld"] / 2
        out.append(Levels(penalties[f], beta[f], np.sqrt(np.diag(inverse[f])), r["ll"], marginal, levels))
    return out
