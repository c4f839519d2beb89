import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from stintlake.llm import linear, quality, toxicity

from .helpers import ODD, docs

RND = random.Random(4)
VOCABULARY = ["".join(RND.choice("abcdeinorst") for _ in range(RND.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def rows(n=400):
    out = []
    for i in range(n):
        text, good, toxic = prose(RND.randint(5, 120)), 1, 0
        if i % 5 == 0:
            text, good = " | ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 7 == 0:
            text, toxic = text + " You stupid clown. " + prose(8), 1
        elif i % 3 == 0:
            text += " The muslim women sang. "
        out.append((i, text, good, toxic))
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


def tables(spark, data):
    return docs(spark, [r[:2] for r in data]), spark.createDataFrame([(r[0], r[2], r[3]) for r in data] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, column, truth", [(quality, "quality", 2), (toxicity, "toxic", 3)])
def test_held_out_rows_are_told_apart(spark, data, module, column, truth):
    d, labels = tables(spark, data)
    out = linear.score(d, module.model(d, labels), module.scorer, module.held_out(), module.CUT)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    mod, rest = (4, 2) if module is quality else (5, 0)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.CUT) for r in got.values())
    held = [r for r in data if got[r[0]]["held_out"]]
    assert np.mean([got[r[0]]["predicted"] == r[truth] for r in held]) >= 0.93


def test_odd_rows_are_scored(spark, data):
    _, labels = tables(spark, data)
    d = docs(spark, ODD)
    for module in (quality, toxicity):
        out = linear.score(d, module.model(docs(spark, [r[:2] for r in data]), labels), module.scorer, module.held_out(), module.CUT).collect()
        assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
        none = linear.score(d, module.model(d, labels.limit(0)), module.scorer, module.held_out(), module.CUT).collect()
        assert {r["score"] for r in none} == {0.5}


def test_counterfactuals_lower_the_change_of_a_swap():
    texts = [f"the muslim neighbour {prose(4)}" for _ in range(30)] + [f"the christian neighbour {prose(4)}" for _ in range(30)] + [prose(6) for _ in range(60)]
    labels = [1] * 22 + [0] * 38 + [0] * 60
    change = lambda w: abs(toxicity.logit("the muslim neighbour", w) - toxicity.logit("the christian neighbour", w))
    free, fair = (toxicity.train(texts, labels, l1=0.5, fairness=f) for f in (0.0, 1.0))
    assert change(fair) < 0.5 * change(free)
    assert toxicity.counterfactuals("Nothing here.") == [] and toxicity.swapped("a muslim woman".split(), 1) == ["a", "christian", "man"]


def plain_hash(parts, kind):
    """The number of an n-gram, in whole numbers."""
    out, step, mask = 2 * kind + 1, 0x9E3779B97F4A7C15, (1 << 64) - 1
    for part in parts:
        out = (out ^ part) * step & mask
    out ^= out >> 29
    return max(1, (out * step & mask) >> 44)


def plain_quality(text):
    words = text.split()
    h = [xxhash.xxh64_intdigest(w) for w in words]
    signs = [re.sub(r"\d+", "0", re.sub("[A-ZÀ-ÖØ-Þ]+", "A", re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", w))) for w in words]
    shape = [int(quality.SAME) if i and h[i] == h[i - 1] else xxhash.xxh64_intdigest(s) for i, s in enumerate(signs)]
    counts = {}
    for seq, n, kind in ((h, 1, 1), (h, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
        for i in range(len(seq) - n + 1):
            at = plain_hash(seq[i : i + n], kind)
            counts[at] = counts.get(at, 0) + 1
    return {at: math.sqrt(c / len(words)) for at, c in counts.items()}


def plain_toxicity(text):
    h = [xxhash.xxh64_intdigest(w) for w in re.findall(r"[^\W_]+", text.lower())]
    return {plain_hash(h[i : i + n], n): 1.0 for n in (1, 2) for i in range(len(h) - n + 1)}


def plain_ftrl(data, epochs, alpha, l1, l2):
    """Follow the regularised leader by its formulas, one number at a time, without counterfactuals."""
    z, n = {}, {}
    ones = sum(y for _, y in data)
    bias = math.log((ones + 1) / (len(data) - ones + 1))

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((1.0 + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for x, y in data:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-(bias + sum(w[i] * v for i, v in x.items()))))
            for i, v in x.items():
                g, old = (p - y) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
    return lambda x: 1 / (1 + math.exp(-(bias + sum(weight(i) * v for i, v in x.items()))))


@pytest.mark.parametrize("module, plain, column, mod, rest, arguments", [(quality, plain_quality, 2, 4, 2, (4, 0.3, 0.3, 0.1)), (toxicity, plain_toxicity, 3, 5, 0, (6, 2.0, 10.0, 0.02))])
def test_scores_equal_a_plain_computation(spark, data, module, plain, column, mod, rest, arguments):
    neutral = lambda m: "x" if m[0].lower() in toxicity.GROUP_OF else m[0]
    some = [(r[0], re.sub(r"[^\W_]+", neutral, r[1]), r[2], r[3]) for r in data[:150]]  # no counterfactuals
    d, labels = tables(spark, some)
    got = {r["doc_id"]: r["score"] for r in linear.score(d, module.model(d, labels), module.scorer, module.held_out(), module.CUT).collect()}
    order = sorted((r for r in some if zlib.crc32(str(r[0]).encode()) % mod != rest), key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
    score = plain_ftrl([(plain(r[1]), r[column]) for r in order], *arguments)
    assert not any(toxicity.counterfactuals(r[1]) for r in some)
    for i, text, *_ in some:
        assert abs(got[i] - score(plain(text))) < 1e-5


CLASHES = ["doc_id", "text", "score", "predicted", "held_out", "_id", "_text", "_out", "_key", "row", "id", "key", "node", "tokens", "copy", "a b"]


def test_stages_keep_columns_of_any_name(spark, data, tmp_path):
    rows_ = [(r[0], r[1], *["v"] * (len(CLASHES) - 2)) for r in data[:60]] + [(900, None, *["v"] * (len(CLASHES) - 2)), (None, "", *[None] * (len(CLASHES) - 2))] * 2
    d = spark.createDataFrame(rows_, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in CLASHES))
    tables(spark, data)[0].write.parquet(f"{tmp_path}/documents.parquet")
    tables(spark, data)[1].write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage, corpus_pipeline.jaccard_stage):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == CLASHES
        left = [tuple(r) for r in out.collect()]
        assert left and all(r in rows_ for r in left)
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.packing_stage(spark, d, "").count() >= 64
    assert corpus_pipeline.packing_stage(spark, d.limit(0), "").count() == 0
    for module in (quality, toxicity):
        empty = linear.score(d.limit(0), module.model(d.limit(0).select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet")), module.scorer, module.held_out(), module.CUT)
        assert empty.count() == 0


def test_pipeline_stages_keep_columns(spark, data, tmp_path):
    d, labels = tables(spark, data)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, read, str(tmp_path))
    assert good.columns == read.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(r[0] in kept) == bool(r[2]) for r in data]) > 0.95
    clean = corpus_pipeline.toxicity_stage(spark, read, str(tmp_path))
    assert clean.columns == read.columns and np.mean([(r["doc_id"] % 7 != 0) for r in clean.collect()]) > 0.95
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
