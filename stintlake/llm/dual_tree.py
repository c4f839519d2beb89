"""Centroid clustering by exact dual-tree Lloyd.

The rows are cut into chunks of a bounded size where they are read, without a shuffle, and each chunk's distinct vectors
get a cover tree, which is built once and written. A node has a vector as its centre and a radius that covers all vectors
below it; its children cover a smaller radius each, and their centres lie farther apart than that. Every round makes a
cover tree of the centroids, and each chunk goes down both trees at once: a pair of nodes is given up when no centroid
below the one can be nearest to a vector below the other (by the distance of the centres, less both radii, against the
largest distance that some centroid is known to keep to all of them). A node that has one centroid left gets it with all
that is below, from prefix sums of its vectors; leaf pairs are compared in integers, ties to the smaller number.

What leaves a task is a count and a sum for each centroid, what reaches the driver is the k centroids. The result doesn't
depend on how rows are cut into chunks, and a hot or repeated vector costs its chunk one comparison.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part. Rows with
null or repeated ids are rows of their own; null ids come last as seeds, equal hashes are ordered by their vectors.
Fewer rows than k: as many centroids as rows. No rows: no rows. Components past 2 ** 30 / sqrt(dims) (scaled) are an error,
as their distances don't fit a long. Columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import released, table
from stintlake.llm.lloyd import SUMS, Sums, distances, finite, floor_means, integers, matrix, seeds
from stintlake.session import ship_package, written

#: Vectors of a chunk, vectors that a leaf may hold, and how much smaller a child's radius is.
CHUNK, LEAF, BASE = 1024, 8, 1.3
#: What rounding may add to a bound, relative to the distances in it.
SLACK = 1e-9
FOREST = "ids array<long>, at array<int>, points array<long>, centre array<int>, radius array<double>, first array<int>, last array<int>, child array<int>, children array<int>"


class Tree:
    """A cover tree as arrays: node i covers points[first:last], its children are the nodes child..child + children."""

    def __init__(self, points, centre, radius, first, last, child, children):
        self.points, self.centre, self.radius = points, np.asarray(centre), np.asarray(radius)
        self.first, self.last, self.child, self.children = map(np.asarray, (first, last, child, children))


def cover_tree(points: np.ndarray, leaf: int = LEAF, base: float = BASE) -> tuple[Tree, np.ndarray]:
    """The tree of distinct points (one at least), and the order in which it holds them."""
    order = np.arange(len(points))
    far = np.sqrt(distances(points, points[0]).astype("f8"))
    centre, radius, first, last, child, children = [0], [far.max()], [0], [len(points)], [0], [0]
    todo = [(order.copy(), far)]
    for node, (members, far) in enumerate(todo):  # grows as it goes
        if len(members) <= leaf:
            continue
        reach, at, mid = radius[node] / base, first[node], centre[node]
        child[node] = len(centre)
        while len(members):
            near = far <= reach
            mine, dist = members[near], far[near]
            order[at : at + len(mine)] = mine
            for part, value in ((centre, mid), (radius, dist.max()), (first, at), (last, at + len(mine)), (child, 0), (children, 0)):
                part.append(value)
            todo.append((mine, dist))
            at += len(mine)
            members = members[~near]
            if len(members):
                mid = members[0]
                far = np.sqrt(distances(points[members], points[mid]).astype("f8"))
        children[node] = len(centre) - child[node]
        todo[node] = None
    place = np.empty(len(points), int)
    place[order] = np.arange(len(points))
    return Tree(points[order], place[centre], radius, first, last, child, children), order


def spread(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of the nodes, and which of the nodes each belongs to."""
    n = tree.children[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    return tree.child[nodes][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def nearest(tree: Tree, centroids: Tree, number: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of the nearest centroid for each point of ``tree``, and how many distances were computed.

    centroids: a tree with one point a leaf; number: the numbers of its points.
    """
    chosen, seen = np.empty(len(tree.points), "i8"), 0
    q, r = np.zeros(1, int), np.zeros(1, int)
    leaf_pairs = []
    while len(q):
        d = np.sqrt(distances(tree.points[tree.centre[q]], centroids.points[centroids.centre[r]]).astype("f8"))
        seen += len(q)
        most = np.full(len(tree.first), np.inf)
        np.minimum.at(most, q, d + tree.radius[q])
        reach = tree.radius[q] + centroids.radius[r]
        keep = d - reach <= most[q] + SLACK * (d + reach)
        q, r = q[keep], r[keep]
        inner_r = centroids.children[r] > 0
        waits = np.zeros(len(tree.first), bool)
        waits[q[inner_r]] = True  # nodes whose centroids are not all single yet
        alone = (np.bincount(q, minlength=len(tree.first))[q] == 1) & ~inner_r
        for node, c in zip(q[alone], r[alone]):
            chosen[tree.first[node] : tree.last[node]] = number[centroids.centre[c]]
        q, r, inner_r = q[~alone], r[~alone], inner_r[~alone]
        down, which = spread(centroids, r[inner_r])
        ready = ~inner_r & ~waits[q]
        bottom = ready & (tree.children[q] == 0)
        leaf_pairs.append((q[bottom], centroids.centre[r[bottom]]))
        split = ready & ~bottom
        below, of = spread(tree, q[split])
        stays = ~inner_r & ~ready
        q, r = np.concatenate([q[inner_r][which], q[stays], below]), np.concatenate([down, r[stays], r[split][of]])
    nodes, c = (np.concatenate(x) for x in zip(*leaf_pairs))
    n = tree.last[nodes] - tree.first[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    point = tree.first[nodes][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    d = distances(tree.points[point], centroids.points[c[which]])
    best = np.lexsort((number[c[which]], d, point))
    point, of = point[best], number[c[which]][best]
    firsts = np.flatnonzero(np.diff(point, prepend=-1))
    chosen[point[firsts]] = of[firsts]
    return chosen, seen + len(d)


def centroid_tree(centres: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of the distinct centroids, and their numbers (of equal ones the smallest)."""
    distinct, number = np.unique(centres, axis=0, return_index=True)
    tree, order = cover_tree(distinct, leaf=1)
    return tree, number[order]


def forest(rows: DataFrame, dims: int, scale: int, chunk: int) -> DataFrame:
    """A row for each chunk of rows (vec_id, x): its ids, the point of each, and the tree of its distinct points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                distinct, which = np.unique(integers(matrix(part.column(1), dims), scale), axis=0, return_inverse=True)
                tree, order = cover_tree(distinct)
                place = np.empty(len(order), "i4")
                place[order] = np.arange(len(order))
                values = {"ids": part.column(0).to_pylist(), "at": place[which.ravel()], "points": tree.points.ravel()}
                values |= {k: getattr(tree, k) for k in ("centre", "radius", "first", "last", "child", "children")}
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values.values(), TYPES)], names=list(values))

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, FOREST)


TYPES = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())]


def chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    """The ids, places and trees of a task's chunks."""
    for batch in released(batches):
        for i in range(batch.num_rows):
            ids, *parts = (batch.column(j).slice(i, 1).flatten() for j in range(batch.num_columns))
            at, points, *nodes = (p.to_numpy(zero_copy_only=False) for p in parts)
            yield ids, at, Tree(points.reshape(-1, dims), *nodes)


def assigned_sums(centres: np.ndarray):
    """For mapInArrow over chunks: the counts and sums of all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centres.shape
        (tree, number), sums = centroid_tree(centres), Sums(k, dims)
        for _, at, chunk in chunks(batches, dims):
            weight = np.bincount(at, minlength=len(chunk.points))
            chosen, _ = nearest(chunk, tree, number)
            edge = np.flatnonzero(np.diff(chosen, prepend=-1))  # points of one centroid stand together
            total = np.add.reduceat(chunk.points * weight[:, None], edge, axis=0)
            sums.add(chosen[edge], total, np.add.reduceat(weight, edge))
        yield from sums.rows()

    return run


def assigned_rows(centres: np.ndarray):
    """For mapInArrow over chunks: the centroid and squared distance of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = centroid_tree(centres)
        for ids, at, chunk in chunks(batches, centres.shape[1]):
            chosen, _ = nearest(chunk, tree, number)
            far = distances(chunk.points, centres[chosen])
            yield pa.RecordBatch.from_arrays([ids, pa.array(chosen[at].astype("i4")), pa.array(far[at])], names=["vec_id", "cluster", "distance"])

    return run


def dual_tree_lloyd(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable row of rows (vec_id,
    embedding). The seeds are the k rows with the smallest sha256 of ``<seed>:<vec_id>``."""
    spark = rows.sparkSession
    ship_package(spark)
    out = "vec_id long, cluster int, distance long"
    kept = rows.filter((F.size("embedding") == dims) & finite("embedding")).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    centres = seeds(kept, [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)], k, scale)
    if not len(centres):
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = written(forest(kept, dims, scale, chunk), "trees")
    for _ in range(rounds):
        centres = floor_means(trees.mapInArrow(assigned_sums(centres), SUMS), centres)
    found = written(trees.mapInArrow(assigned_rows(centres), out), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = spark.createDataFrame([(c, s, total, hashes[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds from 16 seeds over all embeddings of 64 finite components, times 64 and floored; odd rows as in the module."""
    return dual_tree_lloyd(table(spark, sf_dir, "embeddings"))


_FAR = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
_ROUND = """
a{n} AS MATERIALIZED (SELECT r, vec_id, x, cluster, distance FROM (
        SELECT v.r, v.vec_id, v.x, c.cluster, {far} AS distance, row_number() OVER (PARTITION BY v.r ORDER BY {far}, c.cluster) AS place
        FROM v CROSS JOIN c{n} c) WHERE place = 1)"""
_MEANS = """,
m{n} AS (SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY cluster, i),
c{next} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN
        (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{n} GROUP BY cluster) m USING (cluster)),"""
ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x
        FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT 16)),
{"".join(_ROUND.format(n=n, far=_FAR) + (_MEANS.format(n=n, next=n + 1) if n < 3 else "") for n in range(4))}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""
