"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.session import written


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(e: DataFrame) -> DataFrame:
    """Each a's smallest neighbour or itself; the minimum is combined before the shuffle, so large stars cost little."""
    return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of each node that is in a link (a, b); root is the smallest node of its component.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones; the rounds needed grow
    with the logarithm of the size. Every round is written, so a lost executor repeats one round at most.
    """
    e = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = _both(e)
        large = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        least = _least(down)
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        e = written(small.filter("a <> b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
