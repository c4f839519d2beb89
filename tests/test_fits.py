import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintlake.functions import network, special
from stintlake.plans import fits, significance, xg
from stintlake.sources import layout


def test_index_model_equals_plain_folds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2] + 3
    y = x @ [1.0, -0.2, 2.0] + rng.normal(size=120)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "key long, a double, b double, c double, y double")
    fold = np.array([r[0] for r in df.orderBy("key").select(F.pmod(F.xxhash64("key"), F.lit(5))).collect()])
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()

    def missed(lam):
        out = 0.0
        for f in range(5):
            a = np.c_[np.ones((fold != f).sum()), z[fold != f]]
            b = np.linalg.solve(a.T @ a + np.diag([0, lam, lam, lam]), a.T @ t[fold != f])
            out += ((t[fold == f] - np.c_[np.ones((fold == f).sum()), z[fold == f]] @ b) ** 2).sum()
        return out

    lam, r2, beta = fits.index_model(df, ["a", "b", "c"], "y")
    assert lam == min(fits.INDEX_PENALTIES, key=missed) and abs(r2 - (1 - missed(lam) / 120)) < 1e-9
    assert np.allclose(beta, np.linalg.solve(z.T @ z + lam * np.eye(3), z.T @ t))


def poisson(x, y, off, pen):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu = np.exp(x @ b + off)
        b = b + np.clip(np.linalg.solve(x.T @ (mu[:, None] * x) + np.diag(pen), x.T @ (y - mu) - pen * b), -1, 1)
    mu = np.exp(x @ b + off)
    return b, mu, 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)).sum()


def test_poisson_with_levels(spark):
    rng = np.random.default_rng(7)
    game, unit, hours = rng.integers(0, 4, 60), rng.integers(0, 3, 60), rng.uniform(0.5, 2, 60)
    y = rng.poisson(hours * np.exp(0.2 * game + 0.3 * unit))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(game, unit, y, hours)], "game double, unit double, y double, hours double").cache()
    g, u, off = (game[:, None] == np.arange(4)) * 1.0, (unit[:, None] == np.arange(3))[:, 1:] * 1.0, np.log(hours)
    small, large = poisson(g, y, off, np.full(4, 1e-4)), poisson(np.c_[g, u], y, off, np.full(6, 1e-4))
    delta, dof = significance.units_differ(df, "unit", "y", "hours")
    assert dof == 2 and abs(delta - (small[2] - large[2])) < 1e-5
    fit, v = fits.random_intercept(df, [F.lit(1.0)], F.col("y"), F.ln("hours"), "game", [0.0])
    b, mu, _ = poisson(np.c_[np.ones(60), g], y, off, np.r_[0, np.full(4, 1 / v)])
    ll = (y * np.log(mu) - mu).sum()
    found = {r["game"]: (r["level"], r["se"]) for r in fit.levels.collect()}
    design = np.c_[np.ones(60), g]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ (mu[:, None] * design) + np.diag(np.r_[0, np.full(4, 1 / v)]))))
    assert v in fits.VARIANCES and np.allclose([fit.beta[0], *(found[i][0] for i in range(4))], b, atol=1e-6)
    assert np.allclose([fit.se[0], *(found[i][1] for i in range(4))], se, atol=1e-6)
    marginal, best = fit.marginal, []
    for other in fits.VARIANCES:
        c, m, _ = poisson(design, y, off, np.r_[0, np.full(4, 1 / other)])
        best.append(((y * np.log(m) - m).sum() - (c[1:] ** 2).sum() / (2 * other) - 0.5 * np.log1p(other * (g.T @ m)).sum()))
    assert fits.VARIANCES[int(np.argmax(best))] == v
    assert abs(marginal - (ll - (b[1:] ** 2).sum() / (2 * v) - 0.5 * np.log1p(v * (g.T @ mu)).sum())) < 1e-5


@pytest.mark.parametrize("find", [fits.betweenness, network.betweenness, lambda e: network.betweenness(e, 12)], ids=["tasks", "joins", "batches"])
def test_betweenness_counts_all_shortest_routes(spark, find):
    rng = np.random.default_rng(2)
    w = {(a, b): float(rng.integers(1, 4)) for a in range(6) for b in range(6) if a != b and rng.random() < 0.5}
    got = {r["node"]: r["centrality"] for r in find(spark.createDataFrame([(a, b, v) for (a, b), v in w.items()], "src long, dst long, w double")).collect()}
    want = dict.fromkeys(range(6), 0.0)
    for s, t in itertools.permutations(range(6), 2):
        routes = [(s, *m, t) for n in range(5) for m in itertools.permutations(set(range(6)) - {s, t}, n)]
        length = {r: sum(1 / w[e] for e in zip(r, r[1:])) for r in routes if all(e in w for e in zip(r, r[1:]))}
        if length:
            best = [r for r, d in length.items() if d < min(length.values()) + 1e-9]
            for v in range(6):
                want[v] += sum(v in r[1:-1] for r in best) / len(best)
    assert all(abs(got.get(v, 0.0) - want[v] / 20) < 1e-9 for v in want)


def test_large_graphs_are_searched_by_joins(spark, monkeypatch):
    edges = spark.createDataFrame([(a, (a + step) % 12, float(1 + (a * step) % 3)) for a in range(12) for step in (1, 5)] + [(20, 20, 1.0), (21, 22, 0.0)], "src long, dst long, w double")
    few = {r["node"]: r["centrality"] for r in fits.betweenness(edges).collect()}
    monkeypatch.setattr(fits, "MOST_EDGES", 3)
    many = {r["node"]: r["centrality"] for r in fits.betweenness(edges).collect()}
    assert set(few) == set(many) == set(range(12)) | {20, 21, 22} and all(abs(few[v] - many[v]) < 1e-12 for v in few)
    assert max(few.values()) > 0
    assert network.betweenness(edges.limit(0)).count() == 0


def test_defence_is_found():
    rng = np.random.default_rng(1)
    defence, forwards = [f"d{i}" for i in range(6)], [f"f{i}" for i in range(9)]
    stretches = [((*rng.choice(defence, 2, replace=False), *rng.choice(forwards, 3, replace=False)), float(rng.uniform(20, 60))) for _ in range(60)]
    depth = {p: (10 if p[0] == "d" else 20) + rng.normal() for p in defence + forwards}
    depth["d0"], depth["f0"] = 25, 9  # depth alone misleads
    assert fits.choose_defence(defence + forwards, depth, {"f1"}, set(), stretches) == set(defence)
    assert fits.choose_defence(forwards, depth, set(), set(), []) == {"f0"} | set(sorted(forwards[1:], key=depth.get)[:2])


def test_tails_and_posteriors(spark):
    p = [0.1, 0.5, 0.9, 0.3]
    every = [(sum(o), math.prod(q if x else 1 - q for q, x in zip(p, o))) for o in itertools.product((0, 1), repeat=4)]
    shots = spark.createDataFrame([(g, q, int(i < g)) for g in range(5) for i, q in enumerate(p)], "player long, p double, goal int")
    for g, *found in xg.finishing_tails(shots).collect():
        assert np.allclose(found, (sum(v for k, v in every if k >= g), sum(v for k, v in every if k <= g)))
    act = spark.createDataFrame([(1, "click")] * 4 + [(1, "view")] * 2, "player long, action string")
    r = significance.posterior(act, 2.0, 3.0).first()
    assert abs(r["value"] - 600 / 11) < 1e-9 and abs(special.beta_inc(6, 5, r["low"] / 100) - 0.05) < 1e-9 and abs(special.beta_inc(6, 5, r["high"] / 100) - 0.95) < 1e-9
    assert abs(r["above"] - (1 - special.beta_inc(6, 5, 0.4))) < 1e-9


def test_paired_t_has_an_interval(spark):
    d = [1.0, 2.5, -0.5, 3.0, 1.5]
    r = significance.paired_t(spark.createDataFrame([(1, v) for v in d] + [(2, 1.0), (2, 1.0)], "k int, d double"), ["k"], "d").orderBy("k").collect()
    half = 2.7764451051977987 * np.std(d, ddof=1) / math.sqrt(5)  # the 0.975 quantile of t with 4 degrees
    assert abs(r[0]["low"] - (1.5 - half)) < 1e-7 and abs(r[0]["high"] - (1.5 + half)) < 1e-7 and r[1]["t"] is None and r[1]["p"] is None


def test_lines_go_by_their_first_word(spark):
    words = [("p", "a", 0.0, 8.0, -4.0, 4.0), ("p", "c", 50.0, 58.0, -2.5, 5.5), ("p", "b", 20.0, 28.0, -1.0, 7.0), ("q", "x", 0.0, 8.0, 0.0, 8.0), ("p", None, 30.0, 38.0, 0.9, 8.9)]
    df = spark.createDataFrame(words, "page string, text string, x0 double, x1 double, top double, bottom double").repartition(3)
    got = {(r["page"], r["text"]): (r["line"], r["at"]) for r in layout.with_lines(df, ["page"]).collect()}
    assert got == {("p", "a"): (0, 1), ("p", "c"): (0, 2), ("p", "b"): (1, 1), ("p", None): (1, 2), ("q", "x"): (0, 1)}
    assert layout.with_lines(df.limit(0), ["page"]).count() == 0


@pytest.mark.parametrize("name, number, surname", [("7 O'Neil", 7, "O'Neil"), ("Ström", None, "Ström"), ("12  van Dyk", 12, "van Dyk"), ("TOTAL", None, "TOTAL"), ("12", None, None), ("- 3", None, None), ("", None, None)])
def test_row_labels(spark, name, number, surname):
    r = spark.createDataFrame([(name,)], "s string").select(layout.row_label(F.col("s")).alias("l")).select("l.*").first()
    assert tuple(r) == (number, surname)


def test_modularity_of_two_cliques(spark):
    e = spark.createDataFrame([(a, b, 1.0) for c in (0, 3) for a, b in itertools.permutations(range(c, c + 3), 2)], "src long, dst long, w double")
    m = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, community long")
    assert abs(network.modularity(e, m).first()["q"] - 0.5) < 1e-12


def test_distributions_of_many_chances(spark):
    """One key with most rows, equal and certain chances, against term by term."""
    from stintlake.plans import distributions as D

    rng = np.random.default_rng(6)
    p = [*rng.random(900), *[0.25] * 700, 0.0, 1.0]
    df = spark.createDataFrame([("hot", float(q)) for q in p] + [("one", 0.5)], "k string, p double").repartition(5)
    got = {r["k"]: r["d"] for r in D.success_distributions(df, ["k"], "p").collect()}
    want = np.ones(1)
    for q in p:
        want = np.append(want, 0.0) * (1 - q) + np.append(0.0, want) * q
    assert np.allclose(got["hot"], want, atol=1e-13) and got["one"] == [0.5, 0.5]
    assert np.allclose(D.binomial(0.3, 5), [math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(6)])
    r = spark.createDataFrame([([0.2, 0.3, 0.5], 700)], "d array<double>, n int").select(D.powered("d", "n")).first()[0]
    want = np.ones(1)
    for _ in range(700):
        want = np.convolve(want, [0.2, 0.3, 0.5])
    assert np.allclose(r, want, atol=1e-13)


def test_levels_of_a_hundred_thousand_groups(spark):
    """As many levels as rows of sums: the equations of all terms hold, and planted effects are found."""
    from stintlake.functions.levels import fit_levels

    rows = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), (F.rand(5) < 0.5).cast("double").alias("x"), F.rand(6).alias("r"))
    mu = F.exp(0.5 + 0.7 * F.col("x") + F.when(F.col("g") % 2 == 0, 0.4).otherwise(-0.4))
    obs = rows.withColumn("y", F.floor(mu) + (F.col("r") < mu - F.floor(mu)).cast("int"))
    fit = fit_levels(obs, [F.lit(1.0), F.col("x")], F.col("y"), F.lit(0.0), "g", [5.0], [0.0, 0.0])[0]
    assert fit.levels.count() == 100_000 and abs(fit.beta[1] - 0.7) < 0.02
    even, odd = (fit.levels.filter(F.col("g") % 2 == i).agg(F.avg("level")).first()[0] for i in (0, 1))
    assert even > 0.15 > -0.15 > odd and abs(fit.levels.agg(F.sum("level")).first()[0]) < 1  # no penalty on the intercept: levels add to none
