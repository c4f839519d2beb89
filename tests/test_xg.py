"""The shot model against plain numpy: its optimum for all rows and without each day, the errors on days left out, the values."""

import numpy as np

from stintlake.functions import totals_fit as T
from stintlake.plans import xg

SF = "/root/testdata/sf0.001"
SCHEMA = "a double, b double, day int, g int, t double"


def sample(seed, n=300, groups=40, days=8):
    rng = np.random.default_rng(seed)
    x, group = rng.normal(size=(n, 2)), rng.integers(0, groups, n)
    p = 1 / (1 + np.exp(-(-1 + x @ [0.8, -0.4])))
    total = np.array([p[group == g].sum() * rng.uniform(0.7, 1.3) for g in range(groups)])
    return x, group, group % days, total


def frame(spark, x, group, day, total):
    return spark.createDataFrame([(float(a), float(b), int(d), int(g), float(total[g])) for (a, b), d, g in zip(x, day, group)], SCHEMA)


def objective(b, x, group, total):
    q = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    return sum((total[g] - q[group == g].sum()) ** 2 / (total[g] + T.WEIGHT_FLOOR) for g in set(group)) + T.SLOPE_RIDGE * (b[1:] ** 2).sum()


def plain_fit(x, group, total):
    """The optimum by many small steps of Gauss and Newton with halving."""
    z, b = np.c_[np.ones(len(x)), x], np.zeros(3)
    for _ in range(100):
        q = 1 / (1 + np.exp(-z @ b))
        names = sorted(set(group))
        j = np.array([(z * (q * (1 - q))[:, None])[group == g].sum(0) for g in names])
        miss, w = np.array([total[g] - q[group == g].sum() for g in names]), np.array([1 / (total[g] + T.WEIGHT_FLOOR) for g in names])
        ridge = np.array([0, T.SLOPE_RIDGE, T.SLOPE_RIDGE])
        step = np.linalg.solve(j.T @ (w[:, None] * j) + np.diag(ridge), j.T @ (w * miss) - ridge * b)
        while objective(b + step, x, group, total) > objective(b, x, group, total) and np.abs(step).max() > 1e-12:
            step = step / 2
        b = b + step
    return b


def test_logistic_to_totals_is_at_its_optimum(spark):
    x, group, day, total = sample(3)
    df = frame(spark, x, group, day, total)
    beta = T.logistic_to_totals(df, ["a", "b"], ["g"], "t")
    assert np.abs(beta - plain_fit(x, group, total)).max() < 1e-5
    assert np.abs(beta - [-1, 0.8, -0.4]).max() < 0.3
    assert T.logistic_to_totals(df.limit(0), ["a", "b"], ["g"], "t") is None
    assert T.logistic_to_totals(df.selectExpr("a", "b", "g", "0.0 as t"), ["a", "b"], ["g"], "t") is None


def test_days_left_out_equal_plain_refits(spark, monkeypatch):
    monkeypatch.setattr(T, "FITS", 3)  # more than one block
    x, group, day, total = sample(4)
    df = frame(spark, x, group, day, total)
    extra = spark.createDataFrame([(1.0, 1.0, 0, 99, None), (None, 1.0, 0, 98, 2.0), (1.0, 1.0, None, 97, 2.0)], SCHEMA)
    whole, left_out = T.without_each_fold(df.unionByName(extra), ["a", "b"], ["g"], "t", "day")
    assert np.abs(whole - plain_fit(x, group, total)).max() < 1e-5
    assert [f for f, _, _ in left_out] == sorted(set(day))
    missed, flat_missed = [], []
    for d, flat, beta in left_out:
        keep = day != d
        want = plain_fit(x[keep], group[keep], total)
        assert np.abs(beta - want).max() < 1e-5
        mean = sum(total[g] for g in set(group[keep])) / keep.sum()
        assert abs(flat - mean) < 1e-12
        q = 1 / (1 + np.exp(-(want[0] + x @ want[1:])))
        for g in set(group[~keep]):
            missed.append(abs(q[group == g].sum() - total[g]))
            flat_missed.append(abs(mean * (group == g).sum() - total[g]))
    got = T.holdout(df.unionByName(extra), ["a", "b"], ["g"], "t", "day", left_out).first()
    assert got["folds"] == len(set(day)) and abs(got["model_error"] - np.mean(missed)) < 1e-5 and abs(got["flat_error"] - np.mean(flat_missed)) < 1e-9
    q = 1 / (1 + np.exp(-(whole[0] + x @ whole[1:])))
    names = sorted(set(group))
    miss = np.array([total[g] - q[group == g].sum() for g in names])
    t = np.array([total[g] for g in names])
    assert abs(T.explained(df, ["a", "b"], ["g"], "t", whole).first()[0] - (1 - (miss**2).sum() / ((t - t.mean()) ** 2).sum())) < 1e-9


def test_one_day_or_too_few_groups_give_no_holdout(spark):
    x, group, day, total = sample(5, 60, 4, 1)
    df = frame(spark, x, group, day, total)
    whole, left_out = T.without_each_fold(df, ["a", "b"], ["g"], "t", "day")
    assert whole is not None and left_out[0][2] is None
    assert tuple(T.holdout(df, ["a", "b"], ["g"], "t", "day", left_out).first()) == (1, None, None)
    assert T.without_each_fold(df.limit(0), ["a", "b"], ["g"], "t", "day") == (None, [])


def test_report_on_the_tables_equals_plain_fits(spark):
    s = xg.shots(spark, SF).select("ln_d", "angle", "game", "player", "printed").toPandas()
    s["g"] = s.groupby(["game", "player"]).ngroup()
    x, group, total = s[["ln_d", "angle"]].to_numpy(), s["g"].to_numpy(), s.groupby("g")["printed"].first().to_numpy()
    want = plain_fit(x, group, total)
    row = xg.xg_model(spark, SF).first()
    assert np.abs(np.array([row["intercept"], row["slope_distance"], row["slope_angle"]]) - want).max() < 1e-4
    sums = np.bincount(group, 1 / (1 + np.exp(-(want[0] + x @ want[1:]))))
    assert abs(row["r2"] - (1 - ((total - sums) ** 2).sum() / ((total - total.mean()) ** 2).sum())) < 1e-6
    assert row["folds"] == s["game"].nunique() and row["model_error"] < row["flat_error"]
    day = s["game"].min()
    keep = (s["game"] != day).to_numpy()
    there = plain_fit(x[keep], group[keep], total)
    without = 1 / (1 + np.exp(-(there[0] + x @ there[1:])))
    found = {(r["game"], r["player"]): r for r in xg.xg_calibration(spark, SF).collect()}
    assert len(found) == len(total)
    for (game, player), part in s.groupby(["game", "player"]):
        r = found[game, player]
        assert (r["shots"], r["printed"]) == (len(part), part["printed"].iloc[0])
        assert abs(r["model"] - sums[part["g"].iloc[0]]) < 1e-4
        if game == day:
            assert abs(r["without_day"] - without[part.index].sum()) < 1e-4


def test_scaled_values_add_up_and_others_stay(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.6), (1, 0.2, 0.6), (2, 0.3, None), (3, 0.0, 0.5)], "g int, v double, t double")
    got = sorted((r["g"], r["v"], round(r["xg"], 9)) for r in xg.scaled(rows, ["g"], "v", "t").collect())
    assert got == [(1, 0.1, 0.2), (1, 0.2, 0.4), (2, 0.3, 0.3), (3, 0.0, 0.0)]
