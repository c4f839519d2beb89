"""Model fits, graphs, clusters, simulations: queries that SQL can't express."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.functions import network as N
from stintlake.functions import regression as R
from stintlake.functions import special as S
from stintlake.functions.stint_model import impact, interaction_test
from stintlake.operators import intervals as I
from stintlake.plans.adapter import actions, table
from stintlake.plans.season import daily, ice_time
from stintlake.plans.timeline import ORACLES as TIMELINE_SQL
from stintlake.plans.timeline import pass_matrix, stint_sets
from stintlake.session import written

QUERIES, ORACLES = {}, {}
PASSES = TIMELINE_SQL["pass_matrix"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def coefficients(spark: SparkSession, names: list[str], fit: R.Fit) -> DataFrame:
    rows = [(n, float(b), float(s), S.normal_two_sided(b / s) if s > 0 else None) for n, b, s in zip(names, fit.beta, fit.se)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, p double")


@query
def poisson_glm(spark, sf_dir):
    """Goals by clicks and views with time as exposure."""
    t = ice_time(spark, sf_dir).filter("toi > 0")
    x = [F.lit(1.0), F.col("clicks") / 10, F.col("views") / 10]
    return coefficients(spark, ["intercept", "clicks", "views"], R.glm(t, x, F.col("goals"), "poisson", F.ln(F.col("toi") / 3600), np.array([0, 0.1, 0.1])))


def stint_counts(spark, sf_dir) -> DataFrame:
    """``game, members, y_for, y_against, hours`` of the stints with players: the actions of their own team and of the others in them."""
    st = stint_sets(spark, sf_dir).filter("on_ice > 0").withColumn("hours", F.greatest((F.col("to_us") - F.col("from_us")) / 3.6e9, F.lit(1e-6)))
    a = actions(spark, sf_dir).select("game", F.col("team").alias("by"), "event_id", "at_us")
    hit = I.point_in_interval(a, st.select("game", "team", "from_us", "to_us"), ["game"], "at_us", "from_us", "to_us")
    own = F.col("by") == F.col("team")
    n = hit.groupBy("game", "team", "from_us").agg(F.count_if(own).alias("y_for"), F.count_if(~own).alias("y_against"))
    return st.join(n, ["game", "team", "from_us"], "left").na.fill(0, ["y_for", "y_against"]).select("game", F.split("members", ",").alias("members"), "y_for", "y_against", "hours")


_RATINGS: dict[tuple[str, str], DataFrame] = {}


def ratings(spark, sf_dir) -> DataFrame:
    """The impact of every player, fitted once a session and folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _RATINGS:
        _RATINGS[key] = written(impact(stint_counts(spark, sf_dir)), "ratings")
    return _RATINGS[key]


@query
def rapm(spark, sf_dir):
    """Ridge impact of every player on what their team and the others do in a stint; the penalty is chosen by leaving out games."""
    return ratings(spark, sf_dir)


@query
def interaction_lrt(spark, sf_dir):
    """Whether sets of players do otherwise than their players add up to, over all stints."""
    return interaction_test(stint_counts(spark, sf_dir))


@query
def firth(spark, sf_dir):
    """Quality labels by text length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("x", F.log10(F.col("n_chars") + 1.0))
    return coefficients(spark, ["intercept", "log_chars"], R.firth(d, [F.lit(1.0), F.col("x")], F.col("quality")))


@query
def ols_fit(spark, sf_dir):
    """Price by quantity, discount and tax."""
    l = table(spark, sf_dir, "lineitem")
    f = R.ols(l, [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], F.col("l_extendedprice"))
    rows = [(n, float(b), float(s), float(t), S.t_two_sided(float(t), float(f["df"]))) for n, b, s, t in zip(("intercept", "quantity", "discount", "tax"), f["beta"], f["se"], f["t"])]
    out = spark.createDataFrame(rows, "term string, estimate double, se double, t double, p double")
    return out.select("term", *[F.round(c, 4).alias(c) for c in ("estimate", "se", "t")], F.round("p", 7).alias("p"))


@query
def logit_wins(spark, sf_dir):
    """Which team has more purchases on a day and period, by its clicks and views: Firth's logistic regression with Wald tests."""
    kind, mine = F.col("action"), F.col("team") == 0
    d = actions(spark, sf_dir).groupBy("game", "period").agg(*[(F.count_if((kind == k) & mine) - F.count_if((kind == k) & ~mine)).alias(k) for k in ("click", "view", "purchase")])
    return coefficients(spark, ["intercept", "clicks", "views"], R.firth(d, [F.lit(1.0), F.col("click") / 10, F.col("view") / 10], (F.col("purchase") > 0).cast("double")))


def pass_edges(spark, sf_dir) -> DataFrame:
    """The pass network, written: graph measures look at it several times."""
    return written(pass_matrix(spark, sf_dir).select(F.col("player").alias("src"), F.col("receiver").alias("dst"), F.col("passes").cast("double").alias("w")), "passes")


@query
def pagerank(spark, sf_dir):
    """PageRank of the pass network."""
    return N.pagerank(pass_edges(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


ORACLES["pagerank"] = f"""WITH RECURSIVE p AS (SELECT player AS src, receiver AS dst, passes::DOUBLE AS w FROM ({PASSES}) x), nd AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT src AS k FROM p UNION SELECT dst FROM p)), nn AS (SELECT count(*)::DOUBLE AS n FROM nd),
o AS (SELECT src, sum(w) AS t FROM p WHERE src <> dst AND w > 0 GROUP BY src), c AS (SELECT b.i AS j, list(coalesce(p.w / o.t, 0) ORDER BY a.i) AS col FROM nd a CROSS JOIN nd b LEFT JOIN p ON p.src = a.k AND p.dst = b.k AND a.k <> b.k LEFT JOIN o ON o.src = a.k GROUP BY b.i),
m AS (SELECT list(col ORDER BY j) AS m FROM c), d AS (SELECT list(CASE WHEN o.t IS NULL THEN 1.0::DOUBLE ELSE 0 END ORDER BY i) AS d FROM nd LEFT JOIN o ON o.src = nd.k),
it AS (SELECT 0 AS step, (SELECT list(1 / n) FROM nd, nn) AS r UNION ALL SELECT step + 1, list_transform(m, lambda col: 0.15 / n + 0.85 * (list_dot_product(col, r) + list_dot_product(d, r) / n)) FROM it, m, d, nn WHERE step < 200)
SELECT k AS node, round(r[i], 9) AS rank FROM it, nd WHERE step = 200"""


def kind_changes(spark, sf_dir) -> DataFrame:
    """``src, dst, n`` of all pairs of kinds: how often one follows the other on a team's day (0 for pairs that never do)."""
    a = actions(spark, sf_dir)
    order = Window.partitionBy("team", "game").orderBy("at_us", "event_id")
    c = a.select(F.col("action").alias("src"), F.lead("action").over(order).alias("dst")).dropna().groupBy("src", "dst").agg(F.count("*").alias("n"))
    kinds = c.select(F.explode(F.array("src", "dst")).alias("k")).distinct()  # five of them
    every = kinds.select(F.col("k").alias("src")).crossJoin(kinds.select(F.col("k").alias("dst")))
    return every.join(c, ["src", "dst"], "left").na.fill(0, ["n"])


@query
def ipf(spark, sf_dir):
    """Expected passes without preference between the kinds of action that follow one another."""
    x = N.quasi_independence(kind_changes(spark, sf_dir), cut=2)
    return x.select("src", "dst", "n", F.round("expected", 5).alias("expected"))


@query
def louvain(spark, sf_dir):
    """Communities of the pass network."""
    return N.communities(pass_edges(spark, sf_dir))


@query
def pca(spark, sf_dir):
    """Principal axes of the embeddings, from their correlations: loadings of the first three."""
    e = table(spark, sf_dir, "embeddings").select("embedding").filter("size(embedding) = 64").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    g, s, _, n = R.gram(e, [F.col(f"x{i}") for i in range(64)], F.lit(1.0))
    cov = g / n - np.outer(s / n, s / n)
    sd = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    rows = []
    for k in range(3):
        v = vectors[:, -1 - k]
        v = v * np.sign(v[np.abs(v).argmax()])
        rows += [(k, i, float(v[i]), float(values[-1 - k] / values.sum())) for i in range(64)]
    return spark.createDataFrame(rows, "axis int, feature int, loading double, explained double")


@query
def kmeans(spark, sf_dir):
    """Two or three clusters of the players' rates, whichever has the better silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    t = ice_time(spark, sf_dir).filter("toi > 0").select("player", *[(3600.0 * F.col(c) / F.col("toi")).alias(c) for c in ("clicks", "views", "goals")])
    v = VectorAssembler(inputCols=["clicks", "views", "goals"], outputCol="raw").transform(t)
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v).select("player", "features")
    done = [KMeans(k=k, seed=99, maxIter=100).fit(v).transform(v) for k in (2, 3)]
    best = max(done, key=lambda d: ClusteringEvaluator().evaluate(d))
    return best.select("player", F.col("prediction").alias("cluster"))


@query
def bootstrap_ci(spark, sf_dir):
    """Means of the teams' daily totals with bootstrap intervals: 4000 resamples by hashed draws, in array functions."""
    d = actions(spark, sf_dir).groupBy("team", "game").agg(F.sum("value").alias("v")).groupBy("team").agg(F.collect_list(F.struct("game", "v")).alias("g"))
    d = d.select("team", F.transform(F.array_sort("g"), lambda x: x["v"]).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(4000))).alias("rep"))
    n = F.size("v")
    draw = F.transform(F.sequence(F.lit(1), n), lambda i: F.get("v", F.pmod(F.xxhash64(F.lit(11), F.col("team"), F.col("rep"), i), n).cast("int")))
    m = d.select("team", "v", (F.aggregate(draw, F.lit(0.0), lambda a, x: a + x) / n).alias("m"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    return m.groupBy("team").agg(F.first(mean).alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


@query
def permutation_p(spark, sf_dir):
    """How often a shuffled series has as large a change as the real one: each player's season is one small group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("game")["v"].to_numpy()
        if len(v) < 6:
            return pd.DataFrame({"player": [], "gain": [], "p": []})
        i = np.arange(3, len(v) - 2)

        def gain(x: np.ndarray) -> float:
            s = np.cumsum(x)
            return float((i * (len(x) - i) / len(x) * (s[i - 1] / i - (s[-1] - s[i - 1]) / (len(x) - i)) ** 2).max())

        rng, real = np.random.default_rng(1000 + int(key[0])), gain(v)
        more = sum(gain(rng.permutation(v)) >= real for _ in range(999))
        return pd.DataFrame({"player": [key[0]], "gain": [real], "p": [(more + 1) / 1000]})

    return daily(spark, sf_dir).groupBy("player").applyInPandas(run, "player long, gain double, p double")


@query
def games_needed(spark, sf_dir):
    """Games, up to 60, until an exact test against one half would find each player's share, four times out of five: 400 simulations of Poisson attempts a step of a binary search."""

    most, tries, wanted = 60, 400, 0.8

    def run(batches):
        rejected = lru_cache(maxsize=4096)(lambda n: S.binomial_rejected(n, 0.5))  # of this task

        def power(share: float, a_game: float, games: int, rng: np.random.Generator) -> float:
            n = rng.poisson(a_game * games, tries)
            k = rng.binomial(n, share)
            return float(np.mean([rejected(int(m))[j] for m, j in zip(n, k)]))

        for pdf in batches:
            out = []
            for p, s, n, g in pdf.itertuples(index=False):
                rng, low, high = np.random.default_rng(2024 + int(p)), 1, most + 1
                share = (s + 50) / (n + 100)
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if power(share, n / g, mid, rng) >= wanted else (mid + 1, high)
                out.append((p, share, low if low <= most else None))
            yield pd.DataFrame(out, columns=["player", "share", "games"]).astype({"games": "float64"})

    kind = F.col("action")
    t = actions(spark, sf_dir).groupBy("player").agg(F.count_if(kind == "click").alias("s"), F.count_if(kind.isin("click", "view")).alias("n"), F.countDistinct("game").alias("g")).filter("n > 0")
    return t.mapInPandas(run, "player long, share double, games double")
