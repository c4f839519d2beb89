"""Exact top-k search in binary codes: incremental multi-index hashing.

A code is cut into segments, each with its own index. In round r the probes of a query are the values at Hamming distance
exactly r from its segments. After that round every code within ``segments * (r + 1) - 1`` bits has been met, since one
of its segments differs by r bits at most; a query is done once its kth verified distance lies within this, and only the
others go on to the next radius.

Defined results: rows with a null id or code take no part. Equal codes are searched once. A row never answers its own
query (rows with one id count as one). Ties go to the smaller id; a query with fewer than k candidates gets all of them.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import best_per_query, block_pairs, ranked_ids, smallest_ids, table
from stintlake.session import written


def sign_code(vec: str, bits: int = 64) -> Column:
    """A code of the signs of the first ``bits`` components (positive: 1), the first in the lowest bit."""
    x = F.col(vec)
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(x, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def cuts(bits: int, width: int) -> list[tuple[int, int]]:
    """Offset and width of the segments, as even as can be."""
    m = math.ceil(bits / width)
    ends = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def segments(code: str, parts: list[tuple[int, int]]) -> Column:
    """An array of the code's segment values."""
    return F.array(*[F.shiftrightunsigned(F.col(code), at).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for at, width in parts])


def verify(keep: int):
    """For a cogroup: the nearest members of a block for each of its queries, by full Hamming distance."""

    def run(members: pa.Table, probes: pa.Table) -> pa.Table:
        schema = pa.schema([("qkey", pa.int64()), ("ckey", pa.int64()), ("first_id", pa.int64()), ("score", pa.int32())])
        if not members.num_rows or not probes.num_rows:
            return schema.empty_table()
        c, q = members["ckey"].to_numpy().view(np.uint64), probes["qkey"].to_numpy()
        first = members["first_id"].to_numpy()
        rows, cols, far = [], [], []
        for j, code in enumerate(q.view(np.uint64)):
            d = np.bitwise_count(c ^ code).astype(np.int64)
            best = np.arange(len(d))
            if len(d) > keep:  # with all ties at the kth distance
                best = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
            best = best[np.lexsort((first[best], d[best]))][:keep]
            rows.append(np.full(len(best), j))
            cols.append(best)
            far.append(d[best])
        at = np.concatenate(cols)
        return pa.table([pa.array(q[np.concatenate(rows)]), pa.array(c[at].view(np.int64)), pa.array(first[at]), pa.array(np.concatenate(far).astype(np.int32))], schema=schema)

    return run


def hamming_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, width: int | None = None, block_rows: int = 65536) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the k codes nearest to each query, exactly.

    Both frames: vec_id, code (long, the lowest ``bits`` bits count). width: bits of a segment; by default it grows with
    the logarithm of the number of distinct codes, so that index buckets stay of a size.
    """
    mask = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long"), F.col("code").cast("long").bitwiseAND(mask).alias("key")).dropna().dropDuplicates()

    ids = written(smallest_ids(shaped(rows), "key", "vec_id", k + 1), "ids")
    codes = ids.filter("rn = 1").select(F.col("key").alias("ckey"), F.col("vec_id").alias("first_id"))
    asked = written(shaped(queries).select(F.col("vec_id").alias("query_id"), F.col("key").alias("qkey")), "asked")
    width = width or min(16, max(8, int(math.log2(max(codes.count(), 2))) - 6))
    parts = cuts(bits, min(width, bits))
    spark = rows.sparkSession
    index = codes.select("ckey", "first_id", F.posexplode(segments("ckey", parts)).alias("segment", "value"))
    widths = F.array(*[F.lit(w) for _, w in parts])
    open_, best = asked.select("qkey").distinct(), spark.createDataFrame([], "qkey long, ckey long, first_id long, score int")
    for r in range(max(w for _, w in parts) + 1):
        flips = F.expr(f"array({','.join(str(v) for v in range(1 << max(w for _, w in parts)) if v.bit_count() == r)})")
        probes = (
            open_.select("qkey", F.posexplode(segments("qkey", parts)).alias("segment", "at"))
            .select("qkey", "segment", "at", F.explode(flips).alias("flip"))
            .filter(F.col("flip") < F.pow(F.lit(2), F.get(widths, F.col("segment"))))
            .select("qkey", "segment", F.col("at").bitwiseXOR(F.col("flip")).alias("value"))
        )
        left, right = block_pairs(index, probes, ["segment", "value"], block_rows)
        by = ["segment", "value", "mb", "pb"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(verify(k + 1), "qkey long, ckey long, first_id long, score int")
        best = written(best_per_query(best.unionByName(found), F.asc("score"), k + 1), "best")
        covered = len(parts) * (r + 1) - 1
        done = best.groupBy("qkey").agg(F.count("*").alias("n"), F.max("score").alias("kth")).filter((F.col("n") > k) & (F.col("kth") <= covered))
        open_ = written(open_.join(done, "qkey", "left_anti"), "open")
        if open_.isEmpty():
            break
    out = ranked_ids(asked, best, ids.select("key", "vec_id"), F.asc("score"), k)
    return out.withColumnRenamed("score", "distance")


def op1_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 sign codes nearest to that of every embedding whose id is divisible by 100, against all rows.

    Vectors that are null, have fewer than 64 components or hold a null one take no part; of longer ones the first 64 count.
    """
    usable = F.size("embedding") >= 64
    rows = table(spark, sf_dir, "embeddings").filter(usable & ~F.exists("embedding", lambda v: v.isNull())).select("vec_id", sign_code("embedding").alias("code"))
    return hamming_top_k(rows, rows.filter("vec_id % 100 = 0"))


ORACLE = """
WITH r AS (SELECT vec_id, list_transform(embedding[1:64], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS code FROM embeddings
  WHERE len(embedding) >= 64 AND len(list_filter(embedding, lambda v: v IS NULL)) = 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.code[i] - c.code[i]))) AS INTEGER) AS distance
  FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS n FROM d) WHERE n <= 10
"""
