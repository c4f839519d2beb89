import hashlib

import numpy as np
import pytest

from stintlake.llm import dual_tree, lloyd, yinyang

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, x string, code string, n string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c", "d") for i, v, label in rows], SCHEMA).repartition(3)


def nearest(x, c):
    return ((x[:, None] - c) ** 2).sum(2).argmin(1)


def lloyd_rounds(x, c, rounds):
    for _ in range(rounds):
        a = nearest(x, c)
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    a = nearest(x, c)
    return c, a, ((x - c[a]) ** 2).sum(1)


def odd(dims):
    bad = [None, [], [1.0], [NAN] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [-INF], [None] + [0.0] * (dims - 1)]
    return [(900 + i, v, 1) for i, v in enumerate(bad)]


def vectors(dims, n=500, clumps=9, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 3, (clumps, dims))[rng.integers(0, clumps, n)] + rng.normal(0, 0.2, (n, dims))
    x[n // 3 : 2 * n // 3] = x[n // 3]  # a hot vector
    return [(i if i % 50 else None, v.tolist(), i % 4 or None) for i, v in enumerate(x)] + [(7, x[8].tolist(), 2), (7, x[7].tolist(), 3), (7, x[7].tolist(), 3)]


@pytest.mark.parametrize(("k", "rows"), [(16, vectors(64)), (16, vectors(64)[:5]), (3, [(i, [float(i % 2)] * 64, 0) for i in range(40)])])
def test_dual_tree_equals_lloyd(spark, k, rows):
    got = dual_tree.dual_tree_lloyd(frame(spark, rows + odd(64)), k=k, chunk=64).collect()
    x = np.floor(np.array([v for _, v, _ in rows]) * 64).astype(int)
    digest = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i, _, _ in rows]
    first = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, digest[j] if rows[j][0] is not None else "", rows[j][1]))[:k]
    c, a, far = lloyd_rounds(x, x[first], 3)
    sums = [int(far[a == j].sum()) for j in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    want = [(rows[j][0], int(a[j]), int(far[j]), sums[a[j]], sum(sums), names[a[j]]) for j in range(len(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_cover_tree_holds_its_promises():
    rng = np.random.default_rng(2)
    p = np.unique(rng.integers(-50, 50, (8, 5))[rng.integers(0, 8, 600)] + rng.integers(-3, 4, (600, 5)), axis=0)
    tree, order = dual_tree.cover_tree(p)
    assert (tree.points == p[order]).all() and sorted(order) == list(range(len(p)))
    for i in range(len(tree.first)):
        inside = tree.points[tree.first[i] : tree.last[i]]
        assert np.sqrt(lloyd.distances(inside, tree.points[tree.centre[i]])).max() <= tree.radius[i]
        kids = range(tree.child[i], tree.child[i] + tree.children[i])
        if kids:
            assert [tree.first[i], *(tree.last[c] for c in kids)] == [*(tree.first[c] for c in kids), tree.last[i]]
            mids = tree.points[tree.centre[list(kids)]]
            apart = np.sqrt(lloyd.distances(mids[:, None], mids)) + np.eye(len(mids)) * 1e9
            assert apart.min() > tree.radius[i] / dual_tree.BASE >= max(tree.radius[c] for c in kids)
    c = p[::100]
    chosen, seen = dual_tree.nearest(tree, *dual_tree.centroid_tree(c))
    assert (chosen == nearest(tree.points, c)).all() and seen < len(p) * len(c) / 2  # most pairs are given up
    twice = np.concatenate([c, c])
    assert (dual_tree.nearest(tree, *dual_tree.centroid_tree(twice))[0] == nearest(tree.points, twice)).all()


def test_lloyd_of_nothing_and_of_too_much(spark):
    assert dual_tree.dual_tree_lloyd(frame(spark, [])).count() == 0
    assert dual_tree.dual_tree_lloyd(frame(spark, odd(64))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert yinyang.fitted_codes(frame(spark, [])).count() == 0
    assert yinyang.fitted_codes(frame(spark, [(1, [1.0] * 7, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        lloyd.integers(np.full((1, 64), 1e30), 64)


@pytest.mark.parametrize(("rows", "label_rows"), [(vectors(32, 700, 30), 100), (vectors(32)[:6], 100), ([(i, [i % 3 / 4.0, 1.0] * 8, i % 2) for i in range(60)], 1)])
def test_yinyang_equals_lloyd(spark, rows, label_rows):
    dims = len(rows[0][1])
    got = yinyang.fitted_codes(frame(spark, rows + odd(dims)), label_rows=label_rows).collect()
    x = np.floor(np.array([v for _, v, _ in rows]) * 4096).astype(int)
    first = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, rows[j][1]))[:16]
    w = dims // 8
    done = [lloyd_rounds(x[:, p * w : (p + 1) * w], x[first, p * w : (p + 1) * w], 6) for p in range(8)]
    error = sum(far for _, _, far in done)
    of = {label: int(sum(e for e, r in zip(error, rows) if r[2] == label)) for label in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(str(v) for c, _, _ in done for v in c.ravel().tolist()).encode()).hexdigest()
    want = [(r[0], "".join(f"{a[j]:02x}" for _, a, _ in done), int(error[j]), of[r[2]], digest) for j, r in enumerate(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_yinyang_scans_little_and_keeps_its_bounds():
    rng = np.random.default_rng(5)
    x = rng.integers(-4000, 4000, (24, 8))[rng.integers(0, 24, 4000)] + rng.integers(-300, 300, (4000, 8))
    c = x[:16].copy()
    group = yinyang.groups_of(c)
    part = yinyang.Part(c, group, np.zeros(16))
    code, upper, lower = part.first(x)
    scans = []
    for _ in range(8):
        assert (code == nearest(x, c)).all()
        d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
        assert (upper >= d[np.arange(len(x)), code]).all()
        others = d.copy()
        others[np.arange(len(x)), code] = np.inf
        assert all((lower[:, g] <= others[:, group == g].min(1, initial=np.inf)).all() for g in range(lower.shape[1]))
        new = np.array([x[code == j].sum(0) // (code == j).sum() if (code == j).any() else c[j] for j in range(16)])
        part = yinyang.Part(new, group, np.sqrt(((new - c) ** 2).sum(1)))
        c = new
        code, upper, lower, scanned = part.again(x, code, upper, lower)
        scans.append(scanned)
    assert sum(scans) < 0.6 * len(scans) * x.shape[0] * 16
