"""Queries whose intermediate rows must not grow faster than their input: against plain loops, and by their plans."""

import random
import tracemalloc

import numpy as np

from stintlake import registry
from stintlake.functions import network, sparse_fit, stint_model
from stintlake.functions import special as S
from stintlake.operators import intervals as I
from stintlake.operators import joins as J
from stintlake.plans import fits, significance
from stintlake.plans import game as G
from stintlake.plans.rink_game import rebuilt
from stintlake.sources import layout as L
from tests.test_stint_model import dense

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_receivers_are_found_without_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.randrange(2), rng.randrange(400)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, who int, team int, at long")
    got = {r["id"]: r["next"] and r["next"]["id"] for r in J.next_of_another(df, ["team"], "who", "at", "id", 7, []).collect()}

    def brute(i, who, team, at):
        later = [(a, j) for j, w, t, a in rows if t == team and w != who and 0 < a - at <= 7]
        return min(later)[1] if later else None

    assert got == {r[0]: brute(*r) for r in rows} and None in got.values()
    for name in ("pass_receivers", "pass_matrix"):
        assert "Join" not in plan(registry.QUERIES[name](spark, SF))


def test_goals_are_counted_without_lists(spark):
    rng = random.Random(6)
    points = [(i % 3, i, rng.randrange(40) / 2) for i in range(60)]
    spans = [(rng.randrange(3), a, a + rng.randrange(-1, 9)) for a in (rng.randrange(20) / 1.0 for _ in range(50))]
    held = I.holding(spark.createDataFrame(points, "k int, id int, at double"), spark.createDataFrame(spans, "k int, s double, e double"), ["k"], "at", "s", "e")
    assert {r["id"]: r["holding"] for r in held.collect()} == {i: sum(k == g and s < t <= e for g, s, e in spans) for k, i, t in points}
    rows = rebuilt(spark, SF)
    listed = G.goals(rows)
    counts = {(r["team"], r["row_no"]): r["skaters"] for r in G.skater_counts(rows).collect()}
    assert counts == {(r["team"], r["row_no"]): len(r["on_ice"]) for r in listed.collect()}
    key = lambda df: sorted(map(tuple, df.select("file", "team", "player_id", "plus_minus").collect()))
    assert key(G.plus_minus_of(rows)) == key(G.plus_minus(listed))
    for name in ("goal_strengths", "plus_minus_rules"):
        assert "collect_set" not in plan(registry.QUERIES[name](spark, SF))


def test_defence_of_a_large_side_stays_small():
    rng, players = random.Random(7), [f"p{i}" for i in range(3000)]
    stretches = [(tuple(rng.sample(players[:9], 5)), rng.random()) for _ in range(50)]
    tracemalloc.start()
    found = fits.choose_defence(players, {}, set(), set(), stretches)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fits.FEWEST <= len(found) <= fits.MOST and most < 30_000_000  # changes as rows of a matrix took over 300 MB


def test_counts_at_one_place_keep_the_order_of_the_table(spark):
    # two counts at one place of the blue line: whichever file order they come in, the first is on the left
    places = [(i, 10.0 * i, 10.0 + i % 2) for i in range(4)] + [(4, 5.0, 90.0), (5, 5.0, 90.0), (6, 30.0, 90.0)]
    for back in (False, True):
        df = spark.createDataFrame([(1, float(i), x, y, -i if back else i) for i, x, y in places], "k int, value double, x double, y double, place int").repartition(3)
        found = {r["area"]: r["value"] for r in L.grid(df, ["k"], "zone", ("place",)).collect()}
        assert (found["BlueLineLeft"], found["BlueLineCenter"]) == ((5.0, 4.0) if back else (4.0, 5.0))


def test_pairs_are_added_up_in_blocks(spark):
    rng = random.Random(8)
    at = {(t, g, p): (rng.randrange(5), rng.randrange(5)) for t in (0, 1) for g in range(6) for p in (1, 2, 3)}
    played = [(w, w % 2, g, p, *at[w % 2, g, p]) for w in range(22) for g in range(6) for p in (1, 2, 3) if rng.random() < 0.5]
    df = spark.createDataFrame(played, "player long, team long, game long, period int, f long, g long").repartition(3)
    want = {}
    for a in range(22):
        for b in range(a + 2, 22, 2):
            sums, shares = [0, 0], []
            for g in range(6):
                x, y = ({r[3]: r[4:] for r in played if r[0] == w and r[2] == g} for w in (a, b))
                if not x.keys() & y.keys():
                    continue
                t = [sum(x[p][i] for p in x.keys() & y.keys()) for i in (0, 1)]
                o = [sum(v[p][i] for v in (x, y) for p in v) - 2 * t[i] for i in (0, 1)]
                sums = [s + v for s, v in zip(sums, t)]
                shares += [100 * t[0] / sum(t) - 100 * o[0] / sum(o)] if sum(t) >= 2 and sum(o) > 0 else []
                want[a, b] = (*sums, len(shares), round(sum(shares) / len(shares), 9) if shares else 0.0)
    for block in (4, 512):
        got = {(r["a"], r["b"]): (r["f"], r["g"], r["n"], round(r["mean"], 9)) for r in significance.pair_sums(df, block).collect()}
        assert got == want
    assert "Join" not in plan(significance.pair_sums(df))


def test_array_functions_equal_plain_ones():
    rng = np.random.default_rng(9)
    n = rng.integers(1, 2000, 500)
    p, t = rng.random(500) * 0.98 + 0.01, rng.standard_normal(500) * 3
    k = np.clip(rng.binomial(n, p) + rng.integers(-3, 4, 500), 0, n)
    with np.errstate(all="raise", under="ignore"):
        assert np.allclose(S.binomial_two_sideds(k, n, p), [S.binomial_two_sided(int(a), int(b), c) for a, b, c in zip(k, n, p)], rtol=0, atol=1e-9)
        assert np.allclose(S.binomial_two_sideds(k, n, np.full(500, 0.5)), [S.binomial_two_sided(int(a), int(b), 0.5) for a, b in zip(k, n)], rtol=0, atol=1e-9)
        assert np.allclose(S.t_two_sideds(t, n.astype(float)), [S.t_two_sided(a, float(b)) for a, b in zip(t, n)], rtol=0, atol=1e-11)


def test_players_always_together_are_one_term(spark):
    rng = np.random.default_rng(10)
    base = [(i % 4, sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()), float(rng.poisson(3)), float(rng.poisson(2)), float(rng.random() + 0.1)) for i in range(120)]
    rows = [(g, [f"p{p}" for p in m] + [f"q{p}" for p in m if p < 3] + [f"r{p}" for p in m if p == 1], *v) for g, m, *v in base]
    df = spark.createDataFrame(rows, "game int, members array<string>, y_for double, y_against double, hours double").repartition(3)
    assert sparse_fit.sizes(sparse_fit.numbered_rows(df, merged=True)[1]).tolist() == [2, 3, 2, 1, 1, 1]
    got = {(r["side"], r["term"]): r for r in stint_model.impact(df).collect()}
    names = sorted({m for r in rows for m in r[1]})
    x = np.array([[1.0, *(n in r[1] for n in names)] for r in rows])
    for side, i in (("for", 2), ("against", 3)):
        lam = got[side, "p0"]["penalty"]
        beta, se = dense(x, np.array([r[i] for r in rows]), np.array([r[4] for r in rows]), lam)
        assert np.allclose([(got[side, n]["estimate"], got[side, n]["se"]) for n in ["intercept", *names]], np.column_stack([beta, se]), atol=1e-6)
    many = [(g, [f"{p}-{c}" for p in m for c in range(400)], *v) for g, m, *v in base]  # 2400 players: more than a dense rank takes
    found = stint_model.interaction_test(spark.createDataFrame(many, df.schema)).first()
    sets = {tuple(r[1]) for r in rows}
    rank = np.linalg.matrix_rank(np.array([[1.0, *(n in s for n in names)] for s in sets]))
    assert (found["df"], found["groups"]) == (2 * (len(sets) - rank), len(sets))


def test_graphs_of_some_hundred_thousand_links_go_to_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(fits.network, "betweenness", lambda *_: 1 / 0)  # the search by joins
    edges = spark.range(250_000).selectExpr("id % 500 AS src", "id div 500 + 1000 AS dst", "1.0D AS w").unionByName(spark.createDataFrame([(1000, 5000, 1.0), (1001, 5000, 1.0)], "src long, dst long, w double"))
    found = {r["node"]: r["centrality"] for r in fits.betweenness(edges).collect()}
    assert len(found) == 1001 and {v for v, c in found.items() if c} == {1000, 1001}
    assert abs(found[1000] - 500 * 0.5 / (1000 * 999)) < 1e-12


def test_graph_measures_send_ranks_to_links(spark, monkeypatch):
    edges = spark.createDataFrame([(a, (a * s + 1) % 30, 1.0 + a % 3) for a in range(30) for s in (1, 7)], "src long, dst long, w double")
    sent = []
    monkeypatch.setattr(network, "_sent", lambda df, rows: sent.append(rows) or df, raising=False)
    by_key = {r["node"]: r["rank"] for r in network.pagerank(edges).collect()}
    assert set(sent) == {30}
    monkeypatch.undo()
    assert all(abs(r["rank"] - by_key[r["node"]]) < 1e-12 for r in network.pagerank(edges).collect())


def test_a_half_round_of_moves_deals_no_links(spark, monkeypatch):
    edges = spark.createDataFrame([(a, (a * s + 1) % 30, 1.0 + a % 3) for a in range(30) for s in (1, 7)], "src long, dst long, w double")
    plans, write = [], network.written
    monkeypatch.setattr(network, "written", lambda df, name: (name == "where" and plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        network._moved(edges.union(edges.select("dst", "src", "w")), 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 1 and all(p.count("Exchange hashpartitioning") <= 5 for p in plans[1:])  # of the sizes, and of the kept links
