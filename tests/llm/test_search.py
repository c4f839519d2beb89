import numpy as np
from pyspark.sql import functions as F

from stintlake.llm import hamming_search, rp_forest
from stintlake.llm.common import block_pairs

SCHEMA = "vec_id long, embedding array<float>, label int, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k") for i, v in rows], SCHEMA).repartition(3)


def test_forest_is_exact_when_it_visits_all(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16)).astype("f4")
    x[100:180] = x[100]  # a hot vector
    nan, inf = float("nan"), float("inf")
    odd = [(None, x[0].tolist()), (900, None), (902, [0.0] * 16), (904, [nan] + [1.0] * 15), (906, [inf] + [1.0] * 15), (908, [None] + [1.0] * 15), (910, []), (912, [1.0, 2.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = vectors(spark, rows + odd + rows[:5])
    got = rp_forest.nearest(df, df.filter("vec_id % 10 = 0"), 5, leaf_rows=16, sample_rows=64, search_leaves=10_000).collect()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    for q in range(0, 300, 10):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = u @ u[q]
        s[100:180] = s[100]
        want = sorted((-round(float(s[i]), 9), i) for i in range(300) if i != q)[:5]
        assert [r["vec_id"] for r in mine] == [i for _, i in want]
        assert np.allclose([r["score"] for r in mine], [-v for v, _ in want], atol=1e-8)
    assert {r["query_id"] for r in got} == set(range(0, 300, 10))


def test_forest_recall_and_small_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype("f4")
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = rp_forest.nearest(df, df.filter("vec_id % 100 = 0"), 5, leaf_rows=64, sample_rows=1024).collect()
    u = x.astype("f8") / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        s = u @ u[q]
        s[q] = -2
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert hits / 150 >= 0.9
    assert rp_forest.nearest(vectors(spark, []), vectors(spark, [])).count() == 0
    two = vectors(spark, [(0, [1.0, 0.0]), (50, [0.0, 1.0])])
    assert [tuple(r) for r in rp_forest.nearest(two, two).orderBy("query_id").collect()] == [(0, 1, 50, 0.0), (50, 1, 0, 0.0)]


def test_forest_keeps_ties_of_scaled_vectors(spark):
    rng = np.random.default_rng(3)
    v, q = rng.integers(-9, 10, (2, 16))
    for trial in range(20):
        ids, by = rng.permutation(40), rng.permutation(np.arange(1, 41))
        c = np.concatenate([v * by[:, None], np.tile(-q, (30, 1))]).astype("f8")  # 40 multiples of v, then worse ones
        rows, cols, scores = rp_forest.best_members(c, np.concatenate([ids, np.arange(100, 130)]), q[None].astype("f8"), 6)
        assert np.concatenate([ids, np.arange(100, 130)])[cols].tolist() == [0, 1, 2, 3, 4, 5] and len(set(scores)) == 1
    df = vectors(spark, [(i, (v * (i + 1.0)).tolist()) for i in range(60)])
    got = rp_forest.nearest(df, df.filter("vec_id = 50"), 5, leaf_rows=8, sample_rows=16, search_leaves=1000).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4] and {r["score"] for r in got} == {1.0}


def test_forest_leaves_are_bounded_and_queues_agree(spark):
    """Leaves stay small while the table outgrows the samples, and the queue run level by level finds what one queue does."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 8))
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x.astype("f4"))]).select(F.unhex(F.md5(F.col("vec_id").cast("string"))).alias("ckey"), F.col("vec_id").alias("first_id"), "embedding").cache()
    forest = rp_forest.Forest(rows, 8, 3000, 3, 4, 32, 5, "array<float>")
    leaves = forest.table.filter("leaf is not null").select(F.size("keys").alias("n"), "tree").collect()
    assert max(r["n"] for r in leaves) <= 8 and len(forest.levels) >= 1
    assert all(sum(r["n"] for r in leaves if r["tree"] == t) == 3000 for t in range(3))
    probes = rows.filter("first_id < 5").select(F.col("ckey").alias("qkey"), "embedding").cache()
    everything = forest.visits(probes, 10**6).groupBy("qkey").agg(F.sort_array(F.collect_list("far")).alias("far")).collect()
    few = {bytes(r["qkey"]): r["far"] for r in forest.visits(probes, 50).groupBy("qkey").agg(F.sort_array(F.collect_list("far")).alias("far")).collect()}
    for r in everything:
        assert len(r["far"]) == len(leaves) and np.allclose(r["far"][:50], few[bytes(r["qkey"])])


def test_hamming_search_is_exact(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    codes[50:150] = codes[50]  # equal codes
    codes[150:200] = codes[150] ^ (1 << rng.integers(0, 63, 50))  # near ones
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(None, 5), (1000, None), (3, int(codes[3]))]
    df = spark.createDataFrame(rows, "vec_id long, code long").repartition(3)
    got = hamming_search.hamming_top_k(df, df.filter("vec_id % 20 = 0"), 7, block_rows=64).collect()
    for q in range(0, 400, 20):
        d = [(int(np.bitwise_count(np.uint64(int(codes[q] ^ c) & (2**64 - 1)))), i) for i, c in enumerate(codes) if i != q]
        assert [(r["distance"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == sorted(d)[:7]
    few = df.filter("vec_id < 3")
    assert hamming_search.hamming_top_k(few, few, 7, width=8).groupBy("query_id").count().filter("count = 2").count() == 3
    assert hamming_search.hamming_top_k(df.limit(0), df.limit(0), 7).count() == 0


def test_exploded_probes_are_not_broadcast(spark, tmp_path):
    """A small file whose rows explode looks small to Spark: neither side of a bucket search may go to the driver whole."""
    spark.range(200).select(F.xxhash64("id").alias("ckey"), F.col("id").alias("first_id")).write.parquet(f"{tmp_path}/codes")
    codes = spark.read.parquet(f"{tmp_path}/codes")
    members = codes.withColumn("value", F.explode(F.sequence(F.lit(0), F.lit(7))))
    probes = codes.filter("first_id < 20").select(F.col("ckey").alias("qkey"), F.explode(F.sequence(F.lit(4), F.lit(50))).alias("value"))
    left, right = block_pairs(members, probes, ["value"], 64)
    for side in (left, right):
        assert "Broadcast" not in side._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 200 * 4 and right.count() == 20 * 4 * left.select("mb").distinct().count()


def test_sign_code(spark):
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(64)]
    df = spark.createDataFrame([(v,)], "embedding array<float>").select(hamming_search.sign_code("embedding").alias("c"))
    want = sum(1 << i for i in range(0, 64, 3))
    assert df.first()["c"] == (want - (1 << 64) if want >> 63 else want)
    assert df.select(F.lit(1)).count() == 1


def test_codes_of_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 64)).astype("f4").tolist()
    rows = [(i, v, 0, "k", "c", 1) for i, v in enumerate(x)] + [(100, None, 0, "k", "c", 1), (200, [1.0] * 63, 0, "k", "c", 1), (300, [None] + [1.0] * 63, 0, "k", "c", 1), (400, x[3] + [5.0], 0, "k", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", code string, distance int").repartition(3)  # names that the operator uses too
    usable = df.filter("size(embedding) >= 64").filter(~F.exists("embedding", lambda v: v.isNull()))
    codes = usable.select("vec_id", hamming_search.sign_code("embedding").alias("code"))
    got = hamming_search.hamming_top_k(codes, codes.filter("vec_id % 100 = 0"), k=5).collect()
    bits = {i: np.array(v[:64]) > 0 for i, v, *_ in rows if v and len(v) >= 64 and None not in v}
    for q in (0, 400):
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:5]
        assert [(r["distance"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert {r["query_id"] for r in got} == {0, 400}
