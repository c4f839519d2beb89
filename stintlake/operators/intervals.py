"""Interval operators: union, splitting at boundaries, overlap, points in intervals.

All take and return DataFrames and name their columns by parameters. Times are integers (microseconds, say), so that
equality and order are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_union(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us", gap: int = 0) -> DataFrame:
    """``keys, start, end, parts``: intervals that touch, or lie less than ``gap`` apart, merged into one.

    With gap 0 intervals that touch merge; with a positive gap the distance must be smaller than it.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - before
    fresh = F.when(before.isNull() | (apart > 0 if gap == 0 else apart >= gap), 1).otherwise(0)
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        df.withColumn("_fresh", fresh).withColumn("_island", island)
        .groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"))
        .drop("_island")
    )


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The length that [a, b) and [c, d) share."""
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0))


def boundary_split(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us", shortest: int = 1) -> DataFrame:
    """``keys, start, end``: each key's time cut at every start and end; pieces under ``shortest`` are left out."""
    cuts = df.select(*keys, F.explode(F.array(start, end)).alias(start)).distinct()
    order = Window.partitionBy(*keys).orderBy(start)
    return cuts.withColumn(end, F.lead(start).over(order)).filter(F.col(end) - F.col(start) >= shortest)


def in_buckets(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket of ``width`` that an interval touches, as ``_bucket``."""
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return intervals.withColumn("_bucket", F.explode(F.sequence(low, F.greatest(low, high))))


def point_in_interval(
    points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at_us", start: str = "start_us", end: str = "end_us",
    width: int = 3_600_000_000, closed: str = "left", how: str = "inner",
) -> DataFrame:
    """Points joined with the intervals of the same keys that hold them.

    An equi-join on keys and a time bucket, then the exact test: the work grows with the intervals' total length over
    ``width``, and not with the product of both sides. closed: left, right, both or neither.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    i = in_buckets(intervals, start, end, width)
    low = F.col(at) >= F.col(start) if closed in ("left", "both") else F.col(at) > F.col(start)
    high = F.col(at) <= F.col(end) if closed in ("right", "both") else F.col(at) < F.col(end)
    i = i.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_bucket"]})
    same = [F.col(k) == F.col(f"_r_{k}") for k in [*keys, "_bucket"]]
    return p.join(i, [*same, low & high], how).drop("_bucket", *[f"_r_{k}" for k in [*keys, "_bucket"]])


def holding(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, name: str = "holding") -> DataFrame:
    """Points with ``name``: how many of the intervals of the same keys hold them (start excluded, end included), by a running count over
    one order of points, starts and ends, however many intervals lie over one another."""
    extra = [c for c in points.columns if c not in keys]
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_step"), F.struct(*extra).alias("_row"))
    mark = lambda c, step: F.struct(F.col(c).alias("_t"), F.lit(step).alias("_step"))
    m = intervals.filter(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(mark(start, 1), mark(end, -1))).alias("_m"))
    m = m.select(*keys, "_m._t", "_m._step", F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_t", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.unionByName(m).withColumn(name, F.sum("_step").over(order)).filter("_row is not null").select(*keys, "_row.*", name)


def run_clock(points: DataFrame, stretches: DataFrame, keys: list[str], at: str = "at_us", start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Points with ``clock``: how much of the stretches (disjoint, of the same keys) lies before them.

    Both sides are merged into one ordered stream, so the prefix of whole stretches and the last start are running
    aggregates: no range join.
    """
    extra = [c for c in points.columns if c not in keys]
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*extra).alias("_row"), F.lit(None).cast("long").alias("_start"), F.lit(None).cast("long").alias("_end"))
    s = stretches.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = p.unionByName(s).select("*", F.sum(F.col("_end") - F.col("_start")).over(order).alias("_sum"), F.last("_end", True).over(order).alias("_last"))
    clock = F.coalesce(F.col("_sum") - F.greatest(F.col("_last") - F.col("_t"), F.lit(0)), F.lit(0))
    return run.filter("_kind = 1").select(*keys, "_row.*", clock.alias("clock"))
