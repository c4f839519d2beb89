"""Queries without SQL against plain computations on the smallest tables."""

import itertools
import math

import numpy as np
import pyarrow.parquet as pq

from stintlake import registry
from stintlake.plans import lineup, models

SF = "/root/testdata/sf0.001"


def test_pca_takes_all_components(spark):
    x = np.stack([v for v in pq.read_table(f"{SF}/embeddings.parquet")["embedding"].to_pylist() if v is not None and len(v) == 64])
    values = np.linalg.eigvalsh(np.corrcoef(x.T))
    got = registry.QUERIES["pca"](spark, SF).collect()
    assert len(got) == 3 * 64
    assert np.allclose(sorted({r["explained"] for r in got}), values[-3:] / values.sum())


def test_lineup_is_best_of_all_players(spark):
    """The query's lines and pairs against all disjoint choices, by the ratings that it uses."""
    found = registry.QUERIES["lineup_search"](spark, SF).toPandas()
    at = {(r["side"], r["term"]): r["estimate"] for r in models.ratings(spark, SF).collect()}
    players = [r for r in lineup.roster(spark, SF).collect() if ("for", r["player"]) in at]
    rate = lambda g, s: math.exp(at[s, "intercept"] + sum(at[s, p] for p in g))
    worth = {"goals_for": lambda g: rate(g, "for"), "goals_against": lambda g: -rate(g, "against"), "goal_differential": lambda g: rate(g, "for") - rate(g, "against")}
    worth["shot_share"] = lambda g: 100 * rate(g, "for") / (rate(g, "for") + rate(g, "against"))
    assert set(found["objective"]) == set(worth)
    for (objective, position), rows in found.groupby(["objective", "position"]):
        size, most = lineup.SHAPES[position]
        mine = [r["player"] for r in players if r["position"] == position]
        centres = {r["player"] for r in players if r["position"] == position and r["centre"]}
        units, shares = min(len(mine) // size, most), sorted(rows["minutes_share"], reverse=True)
        groups = [(worth[objective](g), set(g)) for g in itertools.combinations(mine, size) if size != 3 or len(centres) < units or centres & set(g)]
        best = max(sum(w * v for w, v in zip(shares, sorted((v for v, _ in c), reverse=True))) for c in itertools.combinations(groups, units) if len(set().union(*(g for _, g in c))) == units * size)
        assert len(rows) == units and abs(rows["total"].iloc[0] - best) < 1e-9
