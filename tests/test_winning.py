"""Firth fits in common passes and leave-one-out against plain refits in numpy; the models of winning."""

import numpy as np
import pytest

from stintlake.functions import firth_fits as FF
from stintlake.functions import special as S
from stintlake.plans import winning

SF = "/root/testdata/sf0.001"


def plain(x, y):
    """Firth's logistic regression, with the leverages worked out row by row."""
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        w = p * (1 - p)
        inverse = np.linalg.inv(x.T @ (w[:, None] * x))
        lever = w * np.einsum("ij,jk,ik->i", x, inverse, x)
        step = inverse @ (x.T @ (y - p + lever * (0.5 - p)))
        step *= min(1, 5 / np.abs(step).max())
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b, np.sqrt(np.diag(inverse))


def games(spark, x, y, keys=None):
    k = x.shape[1]
    rows = [(str(keys[i]) if keys is not None else f"g{i}", *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"x{i} double" for i in range(k)) + ", y double").repartition(3)


def sample(seed, n=40):
    rng = np.random.default_rng(seed)
    x = np.c_[np.ones(n), rng.normal(size=(n, 2)), rng.normal(size=n) * 3]
    return x, (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.3, 1.2, -0.7, 0.0])))).astype(float)


def test_subsets_with_gaps_equal_plain_fits(spark):
    x, y = sample(1)
    x[3, 1] = x[7, 2] = np.nan
    fits = [FF.FirthFit((0, 1)), FF.FirthFit((0, 2, 3)), FF.FirthFit((0, 1, 2, 3), "g5"), FF.FirthFit((0,))]
    FF.run_fits(games(spark, x, y), ["x0", "x1", "x2", "x3"], "y", "key", fits)
    for f in fits:
        keep = ~np.isnan(x[:, f.used]).any(axis=1)
        if f.out:
            keep[5] = False
        b, se = plain(x[keep][:, f.used], y[keep])
        assert np.abs(f.beta - b).max() < 1e-7 and np.abs(f.se - se).max() < 1e-6


def test_separated_and_dependent_columns(spark):
    x = np.c_[np.ones(12), np.arange(12.0), 2 * np.arange(12.0)]
    y = (np.arange(12) > 5).astype(float)
    apart, dependent = FF.FirthFit((0, 1)), FF.FirthFit((0, 1, 2))
    FF.run_fits(games(spark, x, y), ["x0", "x1", "x2"], "y", "key", [apart, dependent])
    assert np.isfinite(apart.beta).all() and np.abs(apart.beta - plain(x[:, :2], y)[0]).max() < 1e-6
    assert dependent.beta is None
    empty = FF.FirthFit((0, 1))
    FF.run_fits(games(spark, x, y).limit(0), ["x0", "x1", "x2"], "y", "key", [empty])
    assert empty.beta is None


@pytest.mark.parametrize("block", [7, 1024])
def test_leave_one_out_equals_plain_refits(spark, monkeypatch, block):
    monkeypatch.setattr(FF, "FITS", block)
    x, y = sample(2, 30)
    want = 0
    for i in range(len(x)):
        keep = np.arange(len(x)) != i
        want += (x[i] @ plain(x[keep], y[keep])[0] > 0) == (y[i] > 0.5)
    assert FF.leave_one_out(games(spark, x, y), ["x0", "x1", "x2", "x3"], "y", "key") == (want, len(x))


def test_models_of_winning_on_the_tables(spark):
    g = winning.shares(spark, SF).toPandas().sort_values("game")
    found = {r["predictor"]: r for r in winning.win_predictors(spark, SF).collect()}
    assert len(found) == 6 and found["Puck possession %"]["games"] == 0 and found["Puck possession %"]["odds_ratio"] is None
    for c, name, _, _ in winning.PREDICTORS[:5]:
        part = g.dropna(subset=[c])
        x, won, diff = np.c_[np.ones(len(part)), part[c]], part["won"].to_numpy(), part["difference"].to_numpy()
        b, se = plain(x, won)
        r = found[name]
        assert r["games"] == len(part) and abs(r["odds_ratio"] - np.exp(b[1])) < 1e-6 * np.exp(b[1])
        assert abs(r["odds_p"] - S.normal_two_sided(b[1] / se[1])) < 1e-6
        beta, rss = np.linalg.lstsq(x, diff, rcond=None)[:2]
        assert abs(r["slope"] - beta[1]) < 1e-7 and abs(r["r2"] - (1 - rss[0] / ((diff - diff.mean()) ** 2).sum())) < 1e-7
    names = [winning.PREDICTORS[i][0] for i in winning.JOINT]
    full = g.dropna(subset=names)
    x, won = np.c_[np.ones(len(full)), full[names]], full["won"].to_numpy()
    right = sum((x[i] @ plain(np.delete(x, i, 0), np.delete(won, i))[0] > 0) == (won[i] > 0.5) for i in range(len(x)))
    rows = winning.win_model(spark, SF).collect()
    assert len(rows) == 4 and all(abs(r["loo_accuracy"] - right / len(x)) < 1e-12 for r in rows)
    beta = np.linalg.lstsq(x, full["difference"].to_numpy(), rcond=None)[0]
    assert np.abs(np.array([r["estimate"] for r in rows]) - beta).max() < 1e-7


def test_too_few_games(spark):
    g = winning.shares(spark, SF).limit(9)
    assert winning.single_models(g).count() == 0 and winning.joint_model(g).count() == 0
