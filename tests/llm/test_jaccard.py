import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stintlake.llm import ngram_jaccard

from .helpers import ODD, docs

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows):
    """(n, class) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").encode().translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows, base = [], [word() for _ in range(60)]
    for i in range(40):  # near copies of one text, in chains
        at = rnd.randrange(len(base))
        base = base[:at] + [word()] + base[at + 1 :]
        rows.append((i, " ".join(base)))
    for i in range(40, 80):  # a shared passage among own words
        rows.append((i, " ".join([word() for _ in range(rnd.randint(3, 60))] + passage + [word() for _ in range(rnd.randint(0, 12))])))
    for i in range(80, 100):  # about the threshold
        own = [word() for _ in range(50)]
        rows.append((i, " ".join(own)))
        rows.append((i + 100, " ".join(own[: 50 - i % 10]).upper()))
    rows += [(300 + i, "the same short text here and there") for i in range(30)]
    rows += [(400 + i, "too few words") for i in range(3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed) + (ODD if seed == 1 else [])
    df = docs(spark, rows)
    got = ngram_jaccard.classes(df, broadcast_rows=0 if seed == 2 else 1000).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))


def test_numbers_that_clash(spark, monkeypatch):
    """Sets that share their first hash are told apart by the second."""
    rows = corpus(1)
    df = docs(spark, rows)
    profiles = ngram_jaccard.profile(df, 5)
    assert ngram_jaccard.clashes(profiles) == frozenset()
    nodes = sorted({r["node"] for r in profiles.filter("n > 0").collect()})
    some = frozenset(nodes[::3])
    monkeypatch.setattr(ngram_jaccard, "clashes", lambda profiles: some)  # these go by their second hash
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ngram_jaccard.classes(df).collect())) == sorted(map(key, brute(rows)))
    monkeypatch.undo()
    same = spark.createDataFrame([(5, 1, 10), (5, 2, 10), (6, 3, 4), (6, 3, 4)], "node long, other long, n long")
    assert ngram_jaccard.clashes(same) == {5}


def template(rnd, n, own, shared=80):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(shared)]
    return [(i, " ".join(common + [word() for _ in range(own)])) for i in range(n)]


def test_near_misses_of_one_template_are_not_paired(spark):
    """2000 documents that share four fifths: too little to link, and no pair of them is formed."""
    df = docs(spark, template(random.Random(9), 2000, 22))
    got = ngram_jaccard.classes(df).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got)
    post = spark.createDataFrame([(1, i, 100, 79, i) for i in range(2000)], "token long, node long, n long, left long, root long")
    assert ngram_jaccard.across(post, 80).count() == 0
    post = spark.createDataFrame([(1, i, 100, 95, i) for i in range(90)], "token long, node long, n long, left long, root long")
    assert ngram_jaccard.across(post, 80).count() == 90 * 89 // 2


@pytest.mark.parametrize("rows", [1, 4096])
def test_frequent_tokens_are_dealt_to_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", rows)
    data = template(random.Random(3), 25, 12, 90) + [(100 + i, t) for i, t in template(random.Random(4), 25, 24, 90)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ngram_jaccard.classes(docs(spark, data)).collect())) == sorted(map(key, brute(data)))


def test_no_documents(spark):
    assert ngram_jaccard.classes(docs(spark, [])).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    rows = corpus(3) + ODD
    df = docs(spark, rows)
    left = corpus_pipeline.jaccard_stage(spark, df, "")
    assert left.columns == df.columns
    want = {c for _, n, c in brute(rows) if n and c is not None}
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    with_words = [(i, t) for i, t in kept if t and t.split()]
    assert {i for i, _ in with_words if i is not None} == want and len(with_words) == len(want) + 2  # id 5 has two texts, and one text has no id
    assert sum(1 for _, t in kept if not t or not t.split()) == 4


def test_sets_and_postings_are_not_broadcast(spark, tmp_path):
    """Near copies take little room in files, by which Spark judges: no join of sets or postings may send a side to the driver whole."""
    rows = [(i, 40, [*range(40 - i % 5), *(1000 * i + j for j in range(1, i % 5 + 1))]) for i in range(60)]
    spark.createDataFrame(rows, "node long, n long, tokens array<long>").write.parquet(f"{tmp_path}/sets")
    sets = spark.read.parquet(f"{tmp_path}/sets")
    ngram_jaccard.orders(sets, 80, 10).write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")
    pairs = sets.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    post = known.select("node", "n", F.posexplode("first").alias("i", "token"), (F.col("n") - F.col("at")).alias("all")).select("token", "node", "n", (F.col("all") - F.col("i") - 1).alias("left"), (F.col("node") % 3).alias("root"))
    frames = [ngram_jaccard.orders(sets, 80, 10), ngram_jaccard.across(post, 80), ngram_jaccard.filtered(pairs, known), ngram_jaccard.verified(pairs, sets, 80)]
    for frame in frames:
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    want = {(i, i + 1) for i in range(59) if 100 * (m := len({*rows[i][2]} & {*rows[i + 1][2]})) >= 80 * (80 - m)}
    assert {(r["a"], r["b"]) for r in frames[3].collect()} == want
