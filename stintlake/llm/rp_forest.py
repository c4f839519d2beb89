"""Approximate nearest neighbours: a forest of random-projection trees under one shared queue.

A tree halves its rows by planes between two rows drawn at random until a leaf has about ``leaf_rows`` rows (twice as many
at most), whatever the size of the table. The top levels of a tree come from a bounded sample of all rows; a node that still has more than
``sample_rows`` rows is split again from a sample of its own, level by level, and one that has no more is split to its
leaves by one task. The index is a table with one row a leaf (its vectors, packed) and one a subtree.

A query walks all trees at once: the open branches of all of them wait in a single queue by their distance from the
splitting planes, and the nearest ``search_leaves`` leaves are taken whichever tree they belong to. Below the top levels
the queue goes on as a table: of every query the nearest branches are kept at each level, as many as leaves are wanted.
Since a branch is never nearer than its parent, these are the leaves that one long queue would have given. Their members
are then reranked by exact cosine, in digits enough that multiples of one vector tie.

Defined results: rows whose id is null, or whose vector is null, empty, zero or holds null or non-finite components, take
no part, nor do vectors of another length than the commonest. Equal vectors are searched once and share their score. Rows
with one id count as one candidate for others and never answer their own query. Ties among the candidates found go to the
smaller id. Rows that no plane can part (multiples of one vector) are dealt into several leaves. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.llm.common import best_per_query, blocks, common_length, ranked_ids, smallest_ids, spread, table, usable_vector
from stintlake.session import written

#: By how much a score in plain doubles may be off, at the very most.
SLACK = 2e-12
#: Levels of planes that one step adds to a tree, so it adds up to FAN branches to a node.
STEP, FAN = 9, 512
TREE = "planes binary, cuts binary, kids binary"


def build_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> dict:
    """Planes, thresholds and children (negative: leaf -1 - n) of a tree over the rows of x, ``depth`` planes deep."""
    planes, cuts, kids, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0, depth)]
    while todo:
        rows, parent, side, below = todo.pop()
        split = None
        for _ in range(8 if below and len(rows) > 1 else 0):
            a, b = x[rng.choice(rows, 2, replace=False)]
            if (norm := np.linalg.norm(a - b)) > 1e-9:
                plane = (a - b) / norm
                at = x[rows] @ plane
                cut = float(np.median(at))
                if 0 < (left := at <= cut).sum() < len(rows):
                    split = left
                    break
        if split is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            me = len(planes)
            planes.append(plane)
            cuts.append(cut)
            kids.append([0, 0])
            todo += [(rows[~split], me, 1, below - 1), (rows[split], me, 0, below - 1)]
        if parent >= 0:
            kids[parent][side] = me
    return {"planes": np.array(planes).reshape(len(planes), x.shape[1]), "cuts": np.array(cuts), "kids": np.array(kids, dtype=np.int64).reshape(-1, 2)}


def packed(tree: dict) -> list[bytes]:
    return [tree["planes"].astype("<f4").tobytes(), tree["cuts"].astype("<f8").tobytes(), tree["kids"].astype("<i4").tobytes()]


def unpacked(planes: bytes, cuts: bytes, kids: bytes, width: int) -> dict:
    return {"planes": np.frombuffer(planes, "<f4").reshape(-1, width).astype(np.float64), "cuts": np.frombuffer(cuts, "<f8"), "kids": np.frombuffer(kids, "<i4").reshape(-1, 2)}


def rounded(tree: dict, width: int) -> dict:
    """The tree as it is stored: rows must go by the same numbers as queries."""
    return unpacked(*packed(tree), width)


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x."""
    out = np.zeros(len(x), dtype=np.int64)
    todo = [(0, np.arange(len(x)))] if len(tree["cuts"]) else []
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
            continue
        left = x[rows] @ tree["planes"][node] <= tree["cuts"][node]
        todo += [(tree["kids"][node][0], rows[left]), (tree["kids"][node][1], rows[~left])]
    return out


def search(forest: list[dict], q: np.ndarray, leaves: int) -> list[tuple[float, int, int]]:
    """The first leaves (distance, tree, leaf) that the shared queue gives for one query."""
    margins = [t["planes"] @ q - t["cuts"] for t in forest]
    queue = [(0.0, t, 0 if len(forest[t]["cuts"]) else -1) for t in range(len(forest))]
    found = []
    while queue and len(found) < leaves:
        far, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((far, t, -1 - node))
            continue
        m = margins[t][node]
        near, other = forest[t]["kids"][node] if m <= 0 else forest[t]["kids"][node][::-1]
        heapq.heappush(queue, (far, t, int(near)))
        heapq.heappush(queue, (max(far, abs(float(m))), t, int(other)))
    return found


def distances(tree: dict, x: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each row of x, of which the tree's root is ``far``, how far each leaf is (a row a query)."""
    out = np.empty((len(x), len(tree["cuts"]) + 1))
    todo = [(0 if len(tree["cuts"]) else -1, far)]
    while todo:
        node, d = todo.pop()
        if node < 0:
            out[:, -1 - node] = d
            continue
        m = x @ tree["planes"][node] - tree["cuts"][node]
        todo += [(tree["kids"][node][0], np.where(m <= 0, d, np.maximum(d, m))), (tree["kids"][node][1], np.where(m > 0, d, np.maximum(d, -m)))]
    return out


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row of c and q as the double nearest to it, so that all multiples of a vector tie: from long doubles where their
    error can't reach another double, else from integers."""
    c, q = c.astype(np.longdouble), q.astype(np.longdouble)
    norm = np.sqrt((c * c).sum(axis=1) * (q * q).sum(axis=-1))
    found, most = (c * q).sum(axis=1) / norm, np.abs(c * q).sum(axis=1) / norm
    error = (most + np.abs(found)) * ((c.shape[1] + 2) * np.longdouble(2) ** -64)
    out = found.astype(np.float64)
    for i in np.flatnonzero((found - error).astype(np.float64) != (found + error).astype(np.float64)):
        out[i] = exact_cosine(c[i].tolist(), (q[i] if q.ndim > 1 else q).tolist())
    return out


def exact_cosine(c: list[float], q: list[float]) -> float:
    """The double nearest to a cosine, by a root of 200 binary places."""

    def whole(v: list[float]) -> list[int]:
        parts = [float(x).as_integer_ratio() for x in v]
        scale = max(d for _, d in parts)  # all are powers of two
        return [n * (scale // d) for n, d in parts]

    c, q = whole(c), whole(q)
    dot, squares = sum(x * y for x, y in zip(c, q)), sum(x * x for x in c) * sum(x * x for x in q)
    root = math.isqrt((dot * dot << 400) // squares)
    return math.copysign(float(Fraction(root, 1 << 200)), dot) if root else 0.0


def best_members(c: np.ndarray, first: np.ndarray, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its ``keep`` best rows of c (ties: smaller ``first``): rows of q, rows of c, scores."""
    few = min(keep, len(c))
    near = unit(q) @ unit(c).T
    least = np.partition(near, len(c) - few, axis=1)[:, len(c) - few] - SLACK
    rows, cols = np.nonzero(near >= least[:, None])  # with all ties at the last score
    exact = cosine(c[cols], q[rows])
    order = np.lexsort((first[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    starts = np.searchsorted(rows, np.arange(len(q)))
    kept = np.arange(len(rows)) - starts[rows] < keep
    return rows[kept], cols[kept], exact[kept]


def depth_for(rows: int, leaf_rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / leaf_rows)))


def default_leaves(leaves: int) -> int:
    """How many of all (six) trees' leaves a query takes: sublinear, for a recall of 0.9 on vectors without any structure."""
    return math.ceil(0.45 * leaves**0.81)


class Forest:
    """The index: top trees (small, on the driver), deeper splits a level, and the leaves."""

    def __init__(self, vectors: DataFrame, width: int, rows: int, trees: int, leaf_rows: int, sample_rows: int, seed: int, kind: str):
        self.width, self.trees, self.leaf_rows, self.sample_rows, self.seed, self.kind = width, trees, leaf_rows, sample_rows, seed, kind
        sample = unit(matrix(vectors.select("embedding", "ckey").orderBy("ckey").limit(sample_rows).select("embedding").toArrow()["embedding"], width))
        depth = min(STEP, depth_for(rows, leaf_rows))
        self.top = [rounded(build_tree(sample, depth, np.random.default_rng([seed, t])), width) for t in range(trees)]
        top = self.top
        self.levels: list[DataFrame] = []

        def assign(batches):
            for batch in batches:
                x = unit(matrix(batch.column(2), width))
                for t, tree in enumerate(top):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), t), pa.int32()), pa.array(leaf_of(tree, x))], names=["ckey", "first_id", "embedding", "tree", "node"])

        placed = vectors.select("ckey", "first_id", "embedding").mapInArrow(assign, f"ckey binary, first_id long, embedding {kind}, tree int, node long")
        if rows > sample_rows:
            placed = self._split_large(placed)
        self.table = written(self._leaves(placed), "forest")

    def _split_large(self, placed: DataFrame) -> DataFrame:
        """Nodes of over sample_rows rows split from samples of their own, level by level, until none is or none can be."""
        width, leaf_rows, seed = self.width, self.leaf_rows, self.seed
        by = Window.partitionBy("tree", "node").orderBy("ckey")
        while len(self.levels) < 6:  # node numbers have 9 bits a level
            sizes = placed.groupBy("tree", "node").agg(F.count("*").alias("m"))
            large = written(sizes.filter(F.col("m") > self.sample_rows), "large")
            if large.isEmpty():
                return placed
            placed = written(placed, "placed")
            picked = placed.join(large, ["tree", "node"]).withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= self.sample_rows)

            def build(group: pa.Table) -> pa.Table:
                t, node, m = (group[c][0].as_py() for c in ("tree", "node", "m"))
                tree = build_tree(unit(matrix(group["embedding"], width)), min(STEP, depth_for(m, leaf_rows)), np.random.default_rng([seed, t, node]))
                return pa.table([pa.array([t], pa.int32()), pa.array([node]), pa.array([m]), *[pa.array([b], pa.binary()) for b in packed(tree)]], names=["tree", "node", "m", "planes", "cuts", "kids"])

            splits = written(picked.groupBy("tree", "node").applyInArrow(build, f"tree int, node long, m long, {TREE}"), "splits")
            splits = splits.filter(F.length("cuts") > 0)
            if splits.isEmpty():
                return placed
            n = blocks(F.col("m"), self.sample_rows)
            left = placed.join(splits.select("tree", "node", n.alias("n")), ["tree", "node"], "left").withColumn("block", F.coalesce(spread("ckey", F.col("n")), F.lit(0)))
            right = splits.select("tree", "node", "planes", "cuts", "kids", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))

            def assign(rows: pa.Table, split: pa.Table) -> pa.Table:
                tree = unpacked(*(split[c][0].as_py() for c in ("planes", "cuts", "kids")), width)
                node = rows["node"].to_numpy() * FAN + (leaf_of(tree, unit(matrix(rows["embedding"], width))) if rows.num_rows else 0)
                return rows.select(["ckey", "first_id", "embedding", "tree"]).append_column("node", pa.array(node, pa.int64()))

            moved = left.filter("n is not null").groupBy("tree", "node", "block").cogroup(right.groupBy("tree", "node", "block")).applyInArrow(assign, f"ckey binary, first_id long, embedding {self.kind}, tree int, node long")
            stay = left.filter("n is null").select("ckey", "first_id", "embedding", "tree", (F.col("node") * FAN).alias("node"))
            placed = moved.unionByName(stay)
            self.levels.append(splits)
        return placed

    def _leaves(self, placed: DataFrame) -> DataFrame:
        """One row a leaf (``part, leaf, ids, vectors``) and one a subtree (leaf null): a node's rows, by chunks of bounded size."""
        width, leaf_rows, seed, kind = self.width, self.leaf_rows, self.seed, np.dtype("<f4" if "float" in self.kind else "<f8")
        sizes = placed.groupBy("tree", "node").agg(F.count("*").alias("m")).filter(F.col("m") > self.sample_rows)
        part = F.coalesce(spread("ckey", blocks(F.col("m"), self.sample_rows)), F.lit(0))
        rows = placed.join(sizes, ["tree", "node"], "left").withColumn("part", part).drop("m") if self.levels or not sizes.isEmpty() else placed.withColumn("part", F.lit(0))

        def leaves(group: pa.Table) -> pa.Table:
            t, node, part = (group[c][0].as_py() for c in ("tree", "node", "part"))
            x = matrix(group["embedding"], width)
            u = unit(x)
            tree = rounded(build_tree(u, depth_for(len(x), leaf_rows), np.random.default_rng([seed, t, node, part, 1])), width)
            at, out = leaf_of(tree, u), []
            for leaf in range(len(tree["cuts"]) + 1):
                rows = np.flatnonzero(at == leaf)
                for i in range(0, max(len(rows), 1), 2 * leaf_rows):  # rows that no plane parts
                    some = pa.array(rows[i : i + 2 * leaf_rows])
                    out.append((leaf, group["ckey"].take(some).to_pylist(), group["first_id"].take(some).to_pylist(), x[some].astype(kind).tobytes(), None, None, None))
            out.append((None, None, None, None, *packed(tree)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()))]
            same = [pa.array([v] * len(out), k) for v, k in ((t, pa.int32()), (node, pa.int64()), (part, pa.int32()))]
            return pa.table([*same, *columns], names=["tree", "node", "part", "leaf", "keys", "ids", "vectors", "planes", "cuts", "kids"])

        return rows.select("tree", "node", "part", "ckey", "first_id", "embedding").groupBy("tree", "node", "part").applyInArrow(leaves, f"tree int, node long, part int, leaf long, keys array<binary>, ids array<long>, vectors binary, {TREE}")

    def visits(self, probes: DataFrame, leaves: int) -> DataFrame:
        """``qkey, tree, node, part, leaf`` that each row of probes (qkey, embedding) takes."""
        width, top = self.width, self.top

        def start(batches):
            for batch in batches:
                u = unit(matrix(batch.column(1), width))
                for i, q in enumerate(u):
                    got = search(top, q, leaves)
                    far = [g[0] for g in got]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(got))), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64()), pa.array(far), pa.array([far[-1] if len(got) == leaves else math.inf] * len(got))], names=["qkey", "tree", "node", "far", "most"])

        open_ = probes.select("qkey", "embedding").mapInArrow(start, "qkey binary, tree int, node long, far double, most double")
        for splits in self.levels:
            open_ = self._nearest(self._expand(open_, probes, splits.withColumn("part", F.lit(0)), False), leaves, ["node"])
        subtrees = self.table.filter("leaf is null").select("tree", "node", "part", "planes", "cuts", "kids")
        return self._nearest(self._expand(open_, probes, subtrees, True), leaves, ["node", "part", "leaf"])

    def _nearest(self, found: DataFrame, leaves: int, keys: list[str]) -> DataFrame:
        """The queue's next state: the nearest branches of each query over all trees, and how far they go at most."""
        order = Window.partitionBy("qkey").orderBy("far", "tree", *keys)
        kept = found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= leaves)
        return kept.withColumn("most", F.when(F.count("*").over(Window.partitionBy("qkey")) == leaves, F.max("far").over(Window.partitionBy("qkey"))).otherwise(F.lit(math.inf))).drop("rn")

    def _expand(self, open_: DataFrame, probes: DataFrame, splits: DataFrame, last: bool) -> DataFrame:
        """The branches below the open ones that are no farther than the last of the wanted ones can be.

        Each open branch has a leaf that is as near as itself, so the farthest of them bounds all that are wanted.
        """
        width, by = self.width, ["tree", "node", "block"]
        asked = written(open_.join(probes.select("qkey", "embedding"), "qkey"), "open")
        sizes = asked.groupBy("tree", "node").agg(F.count("*").alias("m")).select("tree", "node", blocks(F.col("m"), self.sample_rows).alias("n"))
        left = asked.join(sizes, ["tree", "node"]).withColumn("block", spread("qkey", F.col("n"))).drop("n")
        right = splits.join(sizes, ["tree", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        names = ["qkey", "tree", "node", "part", "leaf", "far", "most"]

        def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table({"qkey": pa.array([], pa.binary()), "tree": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "leaf": pa.array([], pa.int64()), "far": pa.array([], pa.float64()), "most": pa.array([], pa.float64())})
            u, far, most, node = unit(matrix(rows["embedding"], width)), rows["far"].to_numpy(), rows["most"].to_numpy(), rows["node"].to_numpy()
            out = []
            for i in range(trees.num_rows):
                d = distances(unpacked(*(trees[c][i].as_py() for c in ("planes", "cuts", "kids")), width), u, far)
                q, leaf = np.nonzero(d <= most[:, None])
                out.append((q, leaf, d[q, leaf], trees["part"][i].as_py()))
            if not trees.num_rows:
                out.append((np.arange(len(u)), np.zeros(len(u), np.int64), far, 0))
            q, leaf, d = (np.concatenate([o[k] for o in out]) for k in range(3))
            part = np.concatenate([np.full(len(o[0]), o[3], np.int32) for o in out])
            at = pa.array(q)
            return pa.table([rows["qkey"].take(at), rows["tree"].take(at), pa.array(node[q] if last else node[q] * FAN + leaf), pa.array(part), pa.array(leaf), pa.array(d), pa.array(most[q])], names=names)

        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "qkey binary, tree int, node long, part int, leaf long, far double, most double")

    def rerank(self, visits: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
        """``qkey, ckey, first_id, score``: the best members of the leaves that a query visits, ``keep`` of each shard.

        A shard is a range of neighbouring nodes of one tree with about half of ``sample_rows`` rows, so a query sends its vector to
        few places and gets few candidates back from each.
        """
        width, kind, by = self.width, np.dtype("<f4" if "float" in self.kind else "<f8"), ["tree", "shard", "block"]
        nodes = self.table.filter("leaf is not null").groupBy("tree", "node").agg(F.sum(F.size("keys")).alias("m")).agg(F.avg("m")).first()[0]
        shard = F.floor(F.col("node") / max(1, int(self.sample_rows / 2 / max(nodes, 1))))
        asked = visits.withColumn("shard", shard).groupBy("qkey", "tree", "shard").agg(F.collect_list(F.struct("node", "part", "leaf")).alias("leaves")).join(probes.select("qkey", "embedding"), "qkey")
        asked = written(asked, "visits")
        sizes = asked.groupBy("tree", "shard").agg(F.count("*").alias("m")).select("tree", "shard", blocks(F.col("m"), self.sample_rows).alias("n"))
        left = asked.join(sizes, ["tree", "shard"]).withColumn("block", spread("qkey", F.col("n"))).drop("n")
        leaves = self.table.filter("leaf is not null").select("tree", shard.alias("shard"), "node", "part", "leaf", "keys", "ids", "vectors")
        right = leaves.join(sizes, ["tree", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

        def run(rows: pa.Table, members: pa.Table) -> pa.Table:
            names, kinds = ["qkey", "ckey", "first_id", "score"], (pa.binary(), pa.binary(), pa.int64(), pa.float64())
            if not rows.num_rows or not members.num_rows:
                return pa.table([pa.array([], k) for k in kinds], names=names)
            x = matrix(rows["embedding"], width).astype(np.float64)
            wanted = rows["leaves"].combine_chunks()
            flat, owner = wanted.flatten(), np.repeat(np.arange(len(x)), pc.list_value_length(wanted).to_numpy())
            who: dict[tuple, list[int]] = {}
            for *leaf, q in zip(*(flat.field(i).to_pylist() for i in range(3)), owner.tolist()):
                who.setdefault(tuple(leaf), []).append(q)
            found, at = [], 0  # queries, rows of all members, scores
            for i, leaf in enumerate(zip(*(members[c].to_pylist() for c in ("node", "part", "leaf")))):
                ids = members["ids"][i].values
                if leaf in who and len(ids):
                    mine = np.array(who[leaf])
                    c = np.frombuffer(members["vectors"][i].as_py(), kind).reshape(-1, width).astype(np.float64)
                    q, m, score = best_members(c, ids.to_numpy(), x[mine], keep)
                    found.append((mine[q], m + at, score))
                at += len(ids)
            keys, ids = (members[c].combine_chunks().flatten() for c in ("keys", "ids"))
            if not found:
                return pa.table([pa.array([], k) for k in kinds], names=names)
            q, m, score = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((ids.to_numpy()[m], -score, q))
            q, m, score = q[order], m[order], score[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < keep
            return pa.table([rows["qkey"].take(pa.array(q[kept])), keys.take(pa.array(m[kept])), ids.take(pa.array(m[kept])), pa.array(score[kept])], names=names)

        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "qkey binary, ckey binary, first_id long, score double")


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = 6, leaf_rows: int = 128, sample_rows: int = 16384, search_leaves: int | None = None, seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row of queries among rows.

    leaf_rows bounds a leaf; sample_rows bounds what one node's planes are fitted on (the vectors with the smallest
    hashes) and how many rows one task takes to leaves. search_leaves: leaves that a query takes from the shared queue;
    by default ``default_leaves`` of the number of leaves in all trees.
    """
    key = F.unhex(F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>")))).alias("key")

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).filter(F.col("vec_id").isNotNull() & usable_vector("embedding")).select("*", key)

    spark = rows.sparkSession
    base = common_length(shaped(rows), "embedding").dropDuplicates(["vec_id", "key"])
    ids = written(smallest_ids(base, "key", "vec_id", k + 1), "ids")
    vectors = ids.filter("rn = 1").select(F.col("key").alias("ckey"), F.col("vec_id").alias("first_id"), "embedding")
    found = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not found[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = found[1]
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"
    forest = Forest(vectors.withColumn("embedding", F.col("embedding").cast(kind)), width, found[0], trees, leaf_rows, sample_rows, seed, kind)
    asked = shaped(queries).filter(F.size("embedding") == width).select(F.col("vec_id").alias("query_id"), F.col("key").alias("qkey"), F.col("embedding").cast(kind).alias("embedding")).dropDuplicates(["query_id", "qkey"])
    probes = written(asked.groupBy("qkey").agg(F.first("embedding").alias("embedding")), "probes")
    leaves = search_leaves or default_leaves(trees * 2 ** depth_for(found[0], leaf_rows))
    best = best_per_query(forest.rerank(forest.visits(probes, leaves), probes, k + 1), F.desc("score"), k + 1)
    return ranked_ids(asked.select("query_id", "qkey"), best, ids.select("key", "vec_id"), F.desc("score"), k)


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every embedding whose id is divisible by 50, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))
