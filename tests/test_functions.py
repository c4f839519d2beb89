import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from stintlake.functions import network, regression, special
from stintlake.functions import rink, text


def test_distributions():
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803477074037) < 1e-12
    assert abs(special.chi2_sf(3.84145882069412, 1) - 0.05) < 1e-10
    assert abs(special.f_sf(4.0, 2, 10) - 0.05295) < 1e-4
    assert abs(special.beta_inc(2, 3, 0.4) - 0.5248) < 1e-12
    assert abs(special.beta_quantile(0.5248, 2, 3) - 0.4) < 1e-9
    assert abs(special.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(special.t_quantile(0.975, 5) - 2.5705818366147395) < 1e-8


def test_exact_tests():
    every = lambda n, p: [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    for k in range(11):
        pmf = every(10, 0.3)
        assert abs(special.binomial_two_sided(k, 10, 0.3) - sum(q for q in pmf if q <= pmf[k] * (1 + 1e-7))) < 1e-12
    pmf = [math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(60)]
    for k in range(8):
        assert abs(special.poisson_two_sided(k, 2.5) - sum(q for q in pmf if q <= pmf[k] * (1 + 1e-7))) < 1e-12
    assert abs(special.fisher(3, 1, 1, 3) - 34 / 70) < 1e-12
    d = [1.5, -2.0, 3.0, 4.5, -5.0, 6.0, 7.0]  # ranks 1 to 7, all signs equally likely
    w, p, n = special.wilcoxon(d)
    sums = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert (w, n) == (21.0, 7) and abs(p - min(1, 2 * min(np.mean([x <= 21 for x in sums]), np.mean([x >= 21 for x in sums])))) < 1e-12
    assert abs(special.normal_quantile(0.975) - 1.959963984540054) < 1e-9 and abs(special.normal_cdf(-1.0) - 0.15865525393145707) < 1e-12
    assert special.correlation_p(1.0, 10) == 0 and abs(special.correlation_p(0.5, 12) - special.t_two_sided(0.5 * math.sqrt(10 / 0.75), 10)) < 1e-12
    for n, p0 in ((9, 0.5), (30, 0.31)):
        assert [bool(x) for x in special.binomial_rejected(n, p0)] == [special.binomial_two_sided(k, n, p0) < 0.05 for k in range(n + 1)]
    assert special.wilcoxon([1.0, 2.0, 3.0])[1] == 0.25 and special.wilcoxon([0.0])[2] == 0


def test_regressions_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x, e = rng.standard_normal((200, 2)), rng.standard_normal(200)
    y = 1 + x @ [2.0, -1.0] + e
    counts, wins = rng.poisson(np.exp(0.3 + 0.5 * x[:, 0])), (rng.random(200) < 1 / (1 + np.exp(-x[:, 1]))).astype(float)
    df = spark.createDataFrame([(*map(float, r),) for r in np.column_stack([x, y, counts, wins])], "a double, b double, y double, k double, w double").cache()
    full = np.column_stack([np.ones(200), x])
    cols = [F.col("a"), F.col("b")]
    fit = regression.ols(df, cols, F.col("y"))
    assert np.allclose(fit["beta"], np.linalg.lstsq(full, y, rcond=None)[0])
    g = regression.glm(df, [F.lit(1.0), *cols], F.col("k"), "poisson")
    assert np.abs(full.T @ (counts - np.exp(full @ g.beta))).max() < 1e-5
    h = regression.glm(df, [F.lit(1.0), *cols], F.col("w"), "logistic", penalty=np.array([0, 1.0, 1.0]))
    assert np.abs(full.T @ (wins - 1 / (1 + np.exp(-full @ h.beta))) - np.array([0, 1, 1]) * h.beta).max() < 1e-5
    r = regression.ridge(df, cols, F.col("y"), 10.0)
    c, cy = x - x.mean(0), y - y.mean()
    assert np.allclose(r[1:], np.linalg.solve(c.T @ c + 10 * np.eye(2), c.T @ cy))
    apart = spark.createDataFrame([(float(i), float(i > 3)) for i in range(8)], "x double, y double")
    f = regression.firth(apart, [F.lit(1.0), F.col("x")], F.col("y"))
    assert np.isfinite(f.beta).all() and f.beta[1] > 0


def test_networks(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 3, 1.0), (2, 3, 0.1)], "src long, dst long, w double")
    found = {r["node"]: r["community"] for r in network.communities(edges, rounds=4).collect()}
    assert found[0] == found[1] == found[2] != found[3] == found[4] == found[5]
    ranks = {r["node"]: r["rank"] for r in network.pagerank(edges, rounds=6).collect()}
    m, v = np.zeros((6, 6)), np.full(6, 1 / 6)
    for a, b, w in ((0, 1, 1), (1, 2, 1), (2, 0, 1 / 1.1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (2, 3, 0.1 / 1.1)):
        m[b, a] = w
    for _ in range(6):
        v = 0.15 / 6 + 0.85 * m @ v
    assert np.allclose([ranks[i] for i in range(6)], v)


def test_poisson_duel_at_any_mean(spark):
    from stintlake.plans.distributions import poisson_duel

    pairs = [(0.5, 0.5), (3.0, 5.0), (15.5, 16.5), (27.0, 20.0), (112.0, 105.0), (148.0, 148.0), (0.5, 400.0), (5000.0, 5050.0)]
    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", poisson_duel(F.col("a"), F.col("b")).alias("d"))
    for a, b, d in df.collect():
        pa, pb = ([math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(7000)] for m in (a, b))
        below = np.concatenate([[0], np.cumsum(pb)[:-1]])
        assert abs(d["win"] - np.dot(pa, below)) < 1e-9 and abs(d["tie"] - np.dot(pa, pb)) < 1e-9


def test_cells_of_every_kind(spark):
    n = None
    want = {
        "": ("Empty", n, n, n), None: ("Empty", n, n, n), " – ": ("Empty", n, n, n), "8": ("Int", 8, n, n), "+13": ("Int", 13, n, n), "–4": ("Int", -4, n, n), "2.50": ("Decimal", 2.5, n, n), "-0.07": ("Decimal", -0.07, n, n),
        "61%": ("Percent", 61, n, n), "48.5%": ("Percent", 48.5, n, n), "9:05": ("Clock", 545, n, n), "103:59": ("Clock", 6239, n, n), "9:5": ("Text", n, n, n), "7/3": ("Ratio", 7, 3, n), "12 / 0 0%": ("Ratio", 12, 0, n), "4/2 50.5%": ("Text", n, n, n),
        "1/2/3": ("Triple", 1, 2, 3), "9 / 8 / 7": ("Triple", 9, 8, 7), "5 25%": ("CountShare", 5, 25, n), "01:30 12%": ("ClockShare", 90, 12, n), "6—2": ("Pair", 6, 2, n), "0 - 0": ("Pair", 0, 0, n), "- 5": ("Text", n, n, n), "n": ("Text", n, n, n), "n/n": ("Text", n, n, n), "3 of 4": ("Text", n, n, n),
    }
    got = spark.createDataFrame([(c,) for c in want], "s string").select("s", text.cell(F.col("s")).alias("c")).collect()
    assert {r["s"]: tuple(r["c"]) for r in got} == want


def test_names_and_times(spark):
    t = spark.createDataFrame([("77",), ("9.5",), ("0.004",), ("-12",), ("-3.25",), ("6.0004",), ("x",), ("1.",)], "s string").select(text.video_ms(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in t] == [77000, 9500, 4, -12000, -3250, None, None, None]
    r = spark.createDataFrame([("stone   Ada may", "a/notes.csv")], "n string, f string").select(text.name_key(F.col("n")), text.display_name(F.col("n")), text.surname(F.col("n")), text.title_parts(F.col("f"))["team_a"]).first()
    assert tuple(r) == ("ADA MAY STONE", "MAY STONE ADA", "STONE", None)


def test_zones(spark):
    points = {(17.5, 15.0): "Slot", (17.5, -15.6): "Center", (18.0, 1.0): "Center", (36.9, 34.1): "RightFlank", (36.9, -34.1): "LeftFlank", (37.0, 15.9): "BlueLineCenter", (37.0, 16.0): "BlueLineRight", (60.0, -16.0): "BlueLineLeft", (-2.0, 3.0): "RightFlank"}
    df = spark.createDataFrame([(89.0 - o, a, z) for (o, a), z in points.items()], "along double, across double, z string")
    assert all(r[0] == r[1] for r in df.select(rink.shot_zone(F.col("along"), F.col("across")), "z").collect())
