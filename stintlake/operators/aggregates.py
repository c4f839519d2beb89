"""Aggregates: rates, shrinkage, multiplicity, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole; null where whole is not positive."""
    return F.when(whole > 0, scale * part / whole)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean over rows with a value and a positive weight; null without any."""
    use = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.sum(F.when(use, F.col(value) * F.col(weight))) / F.sum(F.when(use, F.col(weight)))


def position_rank(value: Column) -> Column:
    """Which of equally frequent positions wins: goalkeepers before defence before forwards."""
    return F.when(value == "Goalie", 3).when(value == "Defence", 2).when(value == "Forward", 1).otherwise(0)


def mode_with_trust(df: DataFrame, key: str, value: str, trust: str, tie: Column | None = None) -> DataFrame:
    """``key, value, trust, votes``: the commonest value of each key among those of the highest trust (ties: larger ``tie``, then value)."""
    counts = df.groupBy(key, trust, value).agg(F.count("*").alias("votes"))
    best = F.max(F.struct(trust, "votes", *([tie.alias("_t")] if tie is not None else []), value)).alias("_b")
    return counts.groupBy(key).agg(best).select(key, f"_b.{value}", f"_b.{trust}", "_b.votes")


def beta_prior(df: DataFrame, keys: list[str], success: str, total: str, low: float = 4.0, high: float = 400.0) -> DataFrame:
    """``keys, units, mean, strength``: an empirical-Bayes beta prior from the units' successes out of totals."""
    rate = F.col(success) / F.col(total)
    g = df.filter(F.col(total) > 0).groupBy(*keys) if keys else df.filter(F.col(total) > 0).groupBy()
    a = g.agg(F.count("*").alias("units"), (F.sum(success) / F.sum(total)).alias("mean"), F.var_samp(rate).alias("_var"), F.avg(1 / F.col(total)).alias("_inv"))
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("_var") - spread * F.col("_inv")
    strength = F.when((F.col("units") < 3) | (spread <= 0) | (between <= 0), F.lit(high)).otherwise(F.least(F.greatest(spread / F.when(between > 0, between) - 1, F.lit(low)), F.lit(high)))
    return a.select(*keys, "units", "mean", strength.alias("strength"))


def wilson(success: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson score interval of a share, within 0 and 1; null without trials."""
    p, n = success / total, total
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(centre - half, F.lit(0.0))), F.when(n > 0, F.least(centre + half, F.lit(1.0)))


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """df with ``adjusted``: p-values corrected within each family."""
    up = Window.partitionBy(*family).orderBy(p, *order)
    back = Window.partitionBy(*family).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.count("*").over(Window.partitionBy(*family))
    ranked = df.withColumn("_i", F.row_number().over(up)).withColumn("_raw", F.col(p) * m / F.col("_i"))
    return ranked.withColumn("adjusted", F.least(F.min("_raw").over(back), F.lit(1.0))).drop("_i", "_raw")
