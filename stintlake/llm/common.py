"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches one by one; what Arrow has freed goes back to the system after each, so that a process which is used again
    doesn't hold the largest batch of every stage before."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def usable_vector(col: str) -> Column:
    """Whether an array column is not null, not empty and holds finite numbers only, not all of them zero."""
    x = F.col(col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def common_length(df: DataFrame, col: str) -> DataFrame:
    """The rows whose array has the commonest length (ties: the longer)."""
    sizes = df.groupBy(F.size(col).alias("_len")).count()
    best = sizes.agg(F.max(F.struct("count", "_len"))["_len"].alias("_len"))
    return df.join(F.broadcast(best), F.size(col) == F.col("_len")).drop("_len")


def smallest_ids(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """At most the n rows with the smallest ids of each key, numbered ``rn``.

    Spark cuts the groups before the shuffle too, so a key that holds a third of all rows costs no more than others.
    """
    order = Window.partitionBy(key).orderBy(id_col)
    return df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def blocks(count: Column, rows: int) -> Column:
    """How many blocks of about ``rows`` rows a group of ``count`` rows is dealt into."""
    return F.greatest(F.ceil(count / F.lit(rows)), F.lit(1)).cast("int")


def spread(key: str, n: Column) -> Column:
    """The block of a row, by the hash of its key."""
    return F.pmod(F.xxhash64(F.lit("block"), F.col(key)), n).cast("int")


def block_pairs(members: DataFrame, probes: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a bucket search dealt into blocks of bounded size.

    A bucket with many members or many probes is cut on both sides, and every block of members meets every block of
    probes once: the two frames that return share ``keys`` and ``mb`` and ``pb`` for a cogroup. Buckets that lack
    members or probes are dropped.

    Spark takes exploded rows for as few as the file that they come from, and would broadcast either side whole through the
    driver: the hints keep all three joins to shuffles, where only the sizes of a partition's buckets are held.
    """
    sizes = (
        members.groupBy(*keys).agg(F.count("*").alias("_m")).hint("merge")
        .join(probes.groupBy(*keys).agg(F.count("*").alias("_p")), keys)
        .select(*keys, blocks(F.col("_m"), rows).alias("_mn"), blocks(F.col("_p"), rows).alias("_pn"))
        .hint("shuffle_hash")
    )
    left = (
        members.join(sizes, keys)
        .withColumn("mb", spread("ckey", F.col("_mn")))
        .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("_pn") - 1)))
    )
    right = (
        probes.join(sizes, keys)
        .withColumn("pb", spread("qkey", F.col("_pn")))
        .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("_mn") - 1)))
    )
    return left.drop("_mn", "_pn"), right.drop("_mn", "_pn")


def best_per_query(found: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best distinct candidates of each query: ``qkey, ckey, first_id, score`` (ties: smaller first_id)."""
    order = Window.partitionBy("qkey").orderBy(score, "first_id")
    return (
        found.groupBy("qkey", "ckey").agg(F.max("score").alias("score"), F.min("first_id").alias("first_id"))
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")
    )


def ranked_ids(queries: DataFrame, best: DataFrame, ids: DataFrame, score: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k first ids other than the query's own.

    queries: query_id, qkey; best: qkey, ckey, score with k + 1 candidates a query; ids: key, vec_id with the k + 1
    smallest ids of each key. Queries with equal vectors share one search.
    """
    lists = best.join(ids.select(F.col("key").alias("ckey"), "vec_id"), "ckey").select("qkey", "vec_id", "score")
    few = Window.partitionBy("qkey").orderBy(score, "vec_id")
    lists = lists.withColumn("rn", F.row_number().over(few)).filter(F.col("rn") <= 2 * k + 2).drop("rn")
    out = Window.partitionBy("query_id", "qkey").orderBy(score, "vec_id")
    return (
        queries.join(lists, "qkey").filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(out)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
