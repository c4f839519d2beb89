"""Vector code compression: product codes whose codebooks are fitted by exact Yinyang Lloyd.

A vector is cut into equal parts, each with its own codebook. The entries of a codebook are put into groups, and every part
of every vector remembers an upper bound of the distance to its entry and one lower bound for each group of other
entries. When entries move, the bounds move by as much; a part is looked at only if some group's bound fails, and then
only that group's entries are scanned. Bounds are rounded outwards and a tie fails them, so what decides is always a
comparison in integers (ties to the lower index).

The bounds travel with the rows: every round reads the table of the round before and writes its own, in batches, without a
shuffle. A second pass adds up the parts by entry; what leaves a task is a count and a sum an entry, what reaches the driver
the codebooks. A lost executor repeats its tasks of one round.

Defined results: vectors that are null, or hold null or non-finite components, take no part; of the others those of the
commonest length that the number of parts divides (of two such lengths the longer) are coded. Rows with null or repeated
ids are rows of their own; null ids come last as first entries, equal ids are ordered by their vectors. Fewer rows than
entries: as many entries as rows. No rows: no rows. Components past 2 ** 30 / sqrt(length) (scaled) are an error, as their
distances don't fit a long. Null labels are a label. Columns other than vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import common_length, released, table
from stintlake.llm.lloyd import SUMS, Sums, distances, finite, floor_means, integers, matrix, seeds
from stintlake.session import ship_package, written

#: Entries of a group at the mean; rows that are computed at once.
GROUP, ROWS = 4, 2048
#: Sums by label that may be broadcast, and the parts a label is dealt into beyond that.
LABEL_ROWS, SALTS = 100_000, 32
STATE = "vec_id long, label string, x array<long>, code array<int>, upper array<float>, lower array<float>"
FLOATS = pa.list_(pa.float32())


def up(x: np.ndarray) -> np.ndarray:
    """A float that is no smaller."""
    return np.nextafter(np.asarray(x, "f8").astype("f4"), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """A float that is no larger, and not below 0."""
    return np.maximum(np.nextafter(np.asarray(x, "f8").astype("f4"), np.float32(-np.inf)), np.float32(0))


def groups_of(entries: np.ndarray, per_group: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd over the entries, from seeds that lie far apart."""
    n = max(1, len(entries) // per_group)
    x = entries.astype("f8")
    mids = x[:1]
    while len(mids) < n:
        mids = np.vstack([mids, x[distances(x[:, None], mids).min(1).argmax()]])
    for _ in range(rounds):
        group = distances(x[:, None], mids).argmin(1)
        mids = np.array([x[group == g].mean(0) if (group == g).any() else mids[g] for g in range(n)])
    return group


class Part:
    """One part position's entries with their groups, and how far they have moved since the bounds were right."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, moved: np.ndarray):
        self.entries, self.group, self.n_groups = entries, group, int(group.max()) + 1
        self.drift = up(moved)
        self.group_drift = np.array([self.drift[group == g].max(initial=0) for g in range(self.n_groups)], "f4")
        self.members = [np.flatnonzero(group == g) for g in range(self.n_groups)]

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and bounds from all distances."""
        d = distances(x[:, None], self.entries)
        code = d.argmin(1).astype("i4")  # the lower index of a tie
        upper = up(np.sqrt(d[np.arange(len(x)), code].astype("f8")))
        other = np.sqrt(d.astype("f8"))
        other[np.arange(len(x)), code] = np.inf
        return code, upper, np.stack([down(other[:, m].min(1, initial=np.inf)) for m in self.members], 1)

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes and bounds after the entries have moved, and how many entries were scanned."""
        code, upper, lower = code.copy(), up(upper.astype("f8") + self.drift[code]), down(lower.astype("f8") - self.group_drift)
        asked = np.flatnonzero((lower <= upper[:, None]).any(1))
        if not len(asked):
            return code, upper, lower, 0
        y, old = x[asked], code[asked]
        best_d, best = distances(y, self.entries[old]), old.copy()
        old_d = best_d.copy()
        fails = lower[asked] <= up(np.sqrt(best_d.astype("f8")))[:, None]
        scanned, seen = len(asked), {}
        for g, members in enumerate(self.members):
            at = np.flatnonzero(fails[:, g])
            if not len(at) or not len(members):
                continue
            d = distances(y[at][:, None], self.entries[members])
            scanned += d.size
            seen[g] = at, d
            near = d.argmin(1)
            found_d, found = d[np.arange(len(at)), near], members[near]
            wins = (found_d < best_d[at]) | ((found_d == best_d[at]) & (found < best[at]))
            best_d[at[wins]], best[at[wins]] = found_d[wins], found[wins]
        bounds = lower[asked]
        left = np.flatnonzero(best != old)  # their old entry is one of the others of its group now
        of = self.group[old[left]]
        bounds[left, of] = np.minimum(bounds[left, of], down(np.sqrt(old_d[left].astype("f8"))))
        for g, (at, d) in seen.items():
            other = np.where(self.members[g] == best[at][:, None], np.inf, np.sqrt(d.astype("f8")))
            bounds[at, g] = down(other.min(1))
        code[asked], upper[asked], lower[asked] = best, up(np.sqrt(best_d.astype("f8"))), bounds
        return code, upper, lower, scanned


def assigned(parts: list[Part], scale: int | None = None):
    """For mapInArrow: the state of every row; with ``scale`` from vectors (vec_id, label, x) that have none yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width = len(parts), parts[0].entries.shape[1]
        edges = np.cumsum([0] + [p.n_groups for p in parts])
        for batch in released(batches):
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x = matrix(rows.column(2), n * width)
                x = integers(x, scale) if scale else x
                cut = [x[:, i * width : (i + 1) * width] for i in range(n)]
                if scale:
                    done = [p.first(c) for p, c in zip(parts, cut)]
                else:
                    code, upper, lower = matrix(rows.column(3), n), matrix(rows.column(4), n), matrix(rows.column(5), edges[-1])
                    done = [p.again(c, code[:, i], upper[:, i], lower[:, edges[i] : edges[i + 1]]) for i, (p, c) in enumerate(zip(parts, cut))]
                code, upper, lower = np.stack([d[0] for d in done], 1), np.stack([d[1] for d in done], 1), np.concatenate([d[2] for d in done], 1)
                lists = [pa.array(list(x), pa.list_(pa.int64())), pa.array(list(code), pa.list_(pa.int32())), pa.array(list(upper), FLOATS), pa.array(list(lower), FLOATS)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], names=["vec_id", "label", "x", "code", "upper", "lower"])

    return run


def part_sums(n: int, width: int, k: int):
    """For mapInArrow over (x, code): counts and sums by part and entry (slot part * k + entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(n * k, width)
        for batch in released(batches):
            x, code = matrix(batch.column(0), n * width), matrix(batch.column(1), n)
            for i in range(n):
                sums.add(i * k + code[:, i], x[:, i * width : (i + 1) * width])
        yield from sums.rows()

    return run


def coded(books: np.ndarray):
    """For mapInArrow over the last state: ``vec_id, label, code, error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, _, width = books.shape
        for batch in released(batches):
            x, code = matrix(batch.column(2), n * width), matrix(batch.column(3), n)
            error = sum(distances(x[:, i * width : (i + 1) * width], books[i][code[:, i]]) for i in range(n))
            text = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fitted_codes(rows: DataFrame, n_parts: int = 8, k: int = 16, rounds: int = 6, scale: int = 4096, label_rows: int = LABEL_ROWS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each usable row of rows (vec_id, embedding, label)."""
    if k > 256:
        raise ValueError("a code has two hex digits a part")
    spark = rows.sparkSession
    ship_package(spark)
    usable = rows.filter(finite("embedding") & (F.size("embedding") > 0) & (F.size("embedding") % n_parts == 0))
    kept = common_length(usable.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("x")), "x")
    first = seeds(kept, [F.col("vec_id")], k, scale)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    k, width = len(first), first.shape[1] // n_parts
    books = first.reshape(k, n_parts, width).transpose(1, 0, 2)
    groups = [groups_of(b) for b in books]
    parts = [Part(b, g, np.zeros(k)) for b, g in zip(books, groups)]
    state = written(kept.mapInArrow(assigned(parts, scale), STATE), "state")
    for _ in range(rounds):
        sums = state.select("x", "code").mapInArrow(part_sums(n_parts, width, k), SUMS)
        new = floor_means(sums, books.reshape(n_parts * k, width)).reshape(books.shape)
        parts = [Part(b, g, np.sqrt(distances(b, a).astype("f8"))) for a, b, g in zip(books, new, groups)]
        books = new
        state = written(state.mapInArrow(assigned(parts), STATE), "state")
    found = written(state.mapInArrow(coded(books), "vec_id long, label string, code string, error long"), "codes")
    by_label = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    if by_label.count() <= label_rows:
        joined = found.join(F.broadcast(by_label), F.col("label").eqNullSafe(F.col("of")))
    else:
        dealt = by_label.withColumn("part", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        joined = found.withColumn("salt", salt).join(dealt, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts of 16 entries after six rounds over all embeddings, times 4096 and floored; odd rows as in the module."""
    return fitted_codes(table(spark, sf_dir, "embeddings"))


_FAR = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
_ROUND = """
a{n} AS MATERIALIZED (SELECT r, part, x, entry, distance FROM (
        SELECT p.r, p.part, p.x, c.entry, {far} AS distance, row_number() OVER (PARTITION BY p.r, p.part ORDER BY {far}, c.entry) AS place
        FROM p JOIN c{n} c ON p.part = c.part) WHERE place = 1)"""
_MEANS = """,
m{n} AS (SELECT part, entry, i, sum(e) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS e, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY part, entry, i),
c{next} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN
        (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{n} GROUP BY part, entry) m
        ON c.part = m.part AND c.entry = m.entry),"""
ORACLE = f"""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 8 = 0
        AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM u WHERE len(x) = (SELECT len(x) FROM u GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
p AS MATERIALIZED (SELECT r, part, list_slice(x, part * (len(x) // 8) + 1, (part + 1) * (len(x) // 8)) AS x FROM v CROSS JOIN (SELECT unnest(range(8)) AS part)),
f AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry, r FROM v ORDER BY vec_id NULLS LAST, x LIMIT 16),
c0 AS MATERIALIZED (SELECT p.part, f.entry, p.x FROM f JOIN p USING (r)),
{"".join(_ROUND.format(n=n, far=_FAR) + (_MEANS.format(n=n, next=n + 1) if n < 6 else "") for n in range(7))},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6),
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN e USING (r) CROSS JOIN h
"""
