"""Test statistics, nearness, sets, texts and small reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.functions import special as S
from stintlake.functions import text as T
from stintlake.operators import aggregates as A
from stintlake.operators import joins as J
from stintlake.operators import windows as W
from stintlake.plans import distributions as D
from stintlake.plans.adapter import DAY, HOUR, SQL, actions, skater_lines, table
from stintlake.plans.season import DAILY, LEAGUE, TOI, ZONE_SQL, daily, duels, DUELS, ice_time, league, placed

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}"
        return f

    return add


CONTINGENCY = """o AS (SELECT action AS a, period AS b, count(*) AS n FROM act GROUP BY ALL),
e AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS expected FROM o)"""


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of each cell."""
    o = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb, t = (o.groupBy(*k).agg(F.sum("n").alias(c)) for k, c in (([a], "ra"), ([b], "rb"), ([], "t")))
    return o.join(ra, a).join(rb, b).join(F.broadcast(t)).withColumn("expected", F.col("ra") * F.col("rb") / F.col("t"))


@query(f""", {CONTINGENCY} SELECT round(sum((n - expected) ** 2 / expected), 6) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df, round(min(expected), 6) AS least, round(sqrt(sum((n - expected) ** 2 / expected) / sum(n) / least(count(DISTINCT a) - 1, count(DISTINCT b) - 1)), 8) AS cramer_v FROM e""")
def chi_square_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independence of action and period."""
    e = contingency(actions(spark, sf_dir), "action", "period")
    chi, ka, kb = F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")), F.countDistinct("action") - 1, F.countDistinct("period") - 1
    return e.agg(F.round(chi, 6).alias("chi2"), (ka * kb).alias("df"), F.round(F.min("expected"), 6).alias("least"), F.round(F.sqrt(chi / F.sum("n") / F.least(ka, kb)), 8).alias("cramer_v"))


@query(f", {CONTINGENCY} SELECT round(2 * sum(n * ln(n / expected)), 6) AS g2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df FROM e")
def g_squared(spark, sf_dir):
    """The likelihood-ratio statistic of the same table."""
    e = contingency(actions(spark, sf_dir), "action", "period")
    return e.agg(F.round(2 * F.sum(F.col("n") * F.ln(F.col("n") / F.col("expected"))), 6).alias("g2"), ((F.countDistinct("action") - 1) * (F.countDistinct("period") - 1)).alias("df"))


@query(""", p AS (SELECT player, sum(CASE WHEN period = 1 THEN value ELSE 0 END) - sum(CASE WHEN period = 3 THEN value ELSE 0 END) AS d, player % 2 AS team FROM act GROUP BY player)
SELECT team, CAST(count(*) AS BIGINT) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS d_z FROM p GROUP BY team""")
def t_paired_stat(spark, sf_dir):
    """Paired t of the players' first and third periods."""
    d = actions(spark, sf_dir).groupBy("player").agg((F.sum(F.when(F.col("period") == 1, F.col("value")).otherwise(0.0)) - F.sum(F.when(F.col("period") == 3, F.col("value")).otherwise(0.0))).alias("d"))
    sd = F.nullif(F.stddev_samp("d"), F.lit(0.0))
    return d.groupBy((F.col("player") % 2).alias("team")).agg(F.count("*").alias("n"), F.round(F.avg("d") / (sd / F.sqrt(F.count("*"))), 6).alias("t"), F.round(F.avg("d") / sd, 6).alias("d_z"))


@query(""", s AS (SELECT team, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM act GROUP BY team)
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS df FROM s a, s b WHERE a.team = 0 AND b.team = 1""")
def welch_stat(spark, sf_dir):
    """Welch's t of the teams' values."""
    a = actions(spark, sf_dir)
    x, y = F.when(F.col("team") == 0, F.col("value")), F.when(F.col("team") == 1, F.col("value"))
    va, vb = F.var_samp(x) / F.count(x), F.var_samp(y) / F.count(y)
    return a.agg(F.round((F.avg(x) - F.avg(y)) / F.sqrt(va + vb), 6).alias("t"), F.round((va + vb) ** 2 / (va**2 / (F.count(x) - 1) + vb**2 / (F.count(y) - 1)), 4).alias("df"))


#: ln of a binomial chance, and the exact two-sided p as sums over all outcomes no likelier.
def ln_binomial_sql(k: str, n: str, p: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def binomial_p_sql(k: str, n: str, p: str) -> str:
    """Needs 0 < p < 1."""
    return f"least(1, (SELECT sum(exp({ln_binomial_sql('i', n, p)})) FILTER (WHERE {ln_binomial_sql('i', n, p)} <= {ln_binomial_sql(k, n, p)} + 1e-7) FROM (SELECT unnest(range(0, CAST({n} AS BIGINT) + 1)) AS i)))"


@query(f""", {TOI}, x AS (SELECT player, clicks AS k, clicks + views AS n, (sum(clicks) OVER w - clicks) / nullif(sum(clicks + views) OVER w - clicks - views, 0) AS p FROM t WINDOW w AS (PARTITION BY player % 2)),
y AS (SELECT *, n * p AS mu FROM x WHERE n > 0 AND p > 0 AND p < 1)
SELECT player, round({binomial_p_sql('k', 'n', 'p')}, 6) AS p_binomial, round(least(1, (SELECT sum(exp(i * ln(mu) - mu - lgamma(i + 1))) FILTER (WHERE i * ln(mu) - mu - lgamma(i + 1) <= k * ln(mu) - mu - lgamma(k + 1) + 1e-7) FROM (SELECT unnest(range(0, CAST(ceil(mu + 12 * sqrt(mu) + 20) AS BIGINT) + k + 1)) AS i))), 6) AS p_poisson FROM y""")
def exact_tests(spark, sf_dir):
    """Exact binomial and Poisson p-values of each player's clicks against the share of the team without them."""
    w = Window.partitionBy(F.col("player") % 2)
    t = ice_time(spark, sf_dir).withColumn("n", F.col("clicks") + F.col("views"))
    t = t.withColumn("p", A.ratio(F.sum("clicks").over(w) - F.col("clicks"), F.sum("n").over(w) - F.col("n"))).filter("n > 0 and p > 0 and p < 1")
    b, q = S.column(S.whole(S.binomial_two_sided, 2), F.col("clicks"), F.col("n"), F.col("p")), S.column(S.whole(S.poisson_two_sided, 1), F.col("clicks"), F.col("n") * F.col("p"))
    return t.select("player", F.round(b, 6).alias("p_binomial"), F.round(q, 6).alias("p_poisson"))


LN_TABLE = "(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(s - x + 1) - lgamma(n - r - s + x + 1))"


@query(f""", c AS (SELECT action, count(*) FILTER (WHERE team = 0 AND period = 1) AS a, count(*) FILTER (WHERE team = 0 AND period = 3) AS b, count(*) FILTER (WHERE team = 1 AND period = 1) AS c, count(*) FILTER (WHERE team = 1 AND period = 3) AS d FROM act GROUP BY action),
m AS (SELECT action, a, a + b AS r, a + c AS s, a + b + c + d AS n FROM c), e AS (SELECT m.*, unnest(range(greatest(0, r + s - n), least(r, s) + 1)) AS x FROM m), l AS (SELECT action, a, x, {LN_TABLE} AS ln FROM e),
o AS (SELECT *, max(CASE WHEN x = a THEN ln END) OVER (PARTITION BY action) AS ref, max(ln) OVER (PARTITION BY action) AS top FROM l)
SELECT action, round(least(1, sum(CASE WHEN ln <= ref + 1e-7 THEN exp(ln - top) ELSE 0 END) / sum(exp(ln - top))), 6) AS p FROM o GROUP BY action""")
def fisher_tests(spark, sf_dir):
    """Fisher's exact test of each action's counts in periods 1 and 3 by team."""
    a = actions(spark, sf_dir)
    cells = [F.count_if((F.col("team") == t) & (F.col("period") == p)).alias(f"c{t}{p}") for t in (0, 1) for p in (1, 3)]
    g = a.groupBy("action").agg(*cells)
    return g.select("action", F.round(S.column(S.whole(S.fisher, 4), *[F.col(f"c{t}{p}") for t in (0, 1) for p in (1, 3)]), 6).alias("p"))


@query()
def wilcoxon_tests(spark, sf_dir):
    """Signed-rank tests of each team's daily totals against those of the day before."""
    def run(pdf):
        import pandas as pd

        d = pdf.sort_values("game")["v"].diff().dropna().tolist()
        w, p, n = S.wilcoxon(d)
        return pd.DataFrame({"team": pdf["team"].iloc[:1], "w": [w], "p": [p], "n": [n]})

    d = actions(spark, sf_dir).groupBy("team", "game").agg(F.sum("value").alias("v"))  # a row a day
    return d.groupBy("team").applyInPandas(run, "team long, w double, p double, n long")


GAMES = "g AS (SELECT game, CAST(count(*) FILTER (WHERE action = 'click') AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE action = 'view') AS DOUBLE) AS y, sum(value) AS v FROM act GROUP BY game)"


def games(spark, sf_dir) -> DataFrame:
    kind = F.col("action")
    return actions(spark, sf_dir).groupBy("game").agg(F.count_if(kind == "click").cast("double").alias("x"), F.count_if(kind == "view").cast("double").alias("y"), F.sum("value").alias("v"))


ZGAMES = f"{GAMES}, z AS (SELECT game, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in "xyv") + " FROM g)"


def zgames(spark, sf_dir) -> DataFrame:
    g = games(spark, sf_dir).withColumn("all", F.lit(1))
    return g.select("game", *[W.zscore(c, ["all"]).alias(c) for c in "xyv"])


@query(f""", {ZGAMES}, d AS (SELECT a.game, b.game AS like_game, sqrt(((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.v - b.v) ** 2) / 3) AS distance FROM z a JOIN z b ON b.game < a.game)
SELECT game, like_game, round(distance, 5) AS distance, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY distance, like_game) AS n FROM d) WHERE n <= 3""")
def similar_games(spark, sf_dir):
    """The three earlier days most like each day: a row a day on both sides; over 10,000 days are an error, not a broadcast."""
    z = zgames(spark, sf_dir)
    bound = z.agg(F.when(F.count("*") > 10_000, F.raise_error(F.lit("too many days to compare each with all"))).alias("none"))
    o = z.select(F.col("game").alias("like_game"), *[F.col(c).alias(f"o{c}") for c in "xyv"])
    d = z.join(F.broadcast(o), F.col("like_game") < F.col("game")).join(F.broadcast(bound), F.col("none").cast("string").isNull())
    d = d.withColumn("distance", F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyv") / 3))
    return W.top(d, ["game"], ["distance", "like_game"], 3).select("game", "like_game", F.round("distance", 5).alias("distance"), "n")


@query(f", {ZGAMES} SELECT game, stat, round(z, 5) AS z FROM (SELECT game, 'x' AS stat, x AS z FROM z UNION ALL SELECT game, 'y', y FROM z UNION ALL SELECT game, 'v', v FROM z) WHERE abs(z) >= 1.5")
def standouts(spark, sf_dir):
    """Figures one and a half deviations from the mean."""
    return zgames(spark, sf_dir).unpivot("game", list("xyv"), "stat", "z").filter(F.abs("z") >= 1.5).withColumn("z", F.round("z", 5))


#: The nine faceoff dots in feet (along, across).
DOTS = ((-69, -22), (-69, 22), (-20, -22), (-20, 22), (0, 0), (20, -22), (20, 22), (69, -22), (69, 22))
DOT_SQL = ", dots AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(DOTS)) + ") AS d(dot, dx, dy))"


@query(ZONE_SQL + DOT_SQL + """ SELECT dot, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_id, dot FROM zone, dots QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY sqrt((along - dx) ** 2 + (across - dy) ** 2), dot) = 1) GROUP BY dot""")
def nearest_point(spark, sf_dir):
    """Actions by the nearest of nine dots, the first of equals; the dots are literals of each row."""
    dots = F.array(*[F.struct(F.sqrt((F.col("along") - x) ** 2 + (F.col("across") - y) ** 2).alias("d"), F.lit(i).alias("dot")) for i, (x, y) in enumerate(DOTS)])
    return placed(spark, sf_dir).select(F.array_min(dots)["dot"].alias("dot")).groupBy("dot").agg(F.count("*").alias("n"))


@query(""", e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS k, unnest(v) AS x FROM e) GROUP BY label, k),
d AS (SELECT a.label, b.label AS other, sqrt(sum((a.x - b.x) ** 2) / 64) AS distance FROM m a JOIN m b ON a.k = b.k AND a.label <> b.label GROUP BY ALL)
SELECT label, other, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, other) <= 3""")
def look_alike_vectors(spark, sf_dir):
    """The three labels whose mean vectors are nearest to each label's."""
    m = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    o = m.select(F.col("label").alias("other"), "k", F.col("x").alias("ox"))
    d = m.join(o, "k").filter("label <> other").groupBy("label", "other").agg(F.sqrt(F.sum((F.col("x") - F.col("ox")) ** 2) / 64).alias("distance"))
    return W.top(d, ["label"], ["distance", "other"], 3).select("label", "other", F.round("distance", 6).alias("distance"))


@query(ZONE_SQL + """, s AS (SELECT along, across FROM zone WHERE action = 'purchase'), grid AS (SELECT gx * 10 AS gx, gy * 10 AS gy FROM (SELECT unnest(range(-9, 10)) AS gx), (SELECT unnest(range(-4, 5)) AS gy))
SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, round(sum(exp(-((along - gx) ** 2 + (across - gy) ** 2) / 50)), 5) AS density FROM grid JOIN s ON (along - gx) ** 2 + (across - gy) ** 2 <= 225 GROUP BY ALL""")
def kde_grid(spark, sf_dir):
    """Gaussian density of purchases on a grid, cut at three bandwidths: each point goes to the grid cells near it."""
    s = placed(spark, sf_dir).filter("action = 'purchase'").groupBy("along", "across").agg(F.count("*").alias("w"))
    near = lambda c, n: F.explode(F.transform(F.sequence(F.ceil((F.col(c) - 15) / 10).cast("int"), F.floor((F.col(c) + 15) / 10).cast("int")), lambda g: g * 10))
    g = s.withColumn("gx", near("along", 9)).withColumn("gy", near("across", 4)).filter("abs(gx) <= 90 and abs(gy) <= 40")
    d2 = (F.col("along") - F.col("gx")) ** 2 + (F.col("across") - F.col("gy")) ** 2
    return g.filter(d2 <= 225).groupBy("gx", "gy").agg(F.round(F.sum(F.col("w") * F.exp(-d2 / 50)), 5).alias("density"))


BAND = "CASE WHEN sqrt((89 - along) ** 2 + across ** 2) < 20 THEN '0-20' WHEN sqrt((89 - along) ** 2 + across ** 2) < 40 THEN '20-40' ELSE '40+' END"


@query(ZONE_SQL + f" SELECT {BAND} AS band, CAST(count(*) AS BIGINT) AS shots, CAST(count(*) FILTER (WHERE action = 'purchase') AS BIGINT) AS goals FROM zone GROUP BY 1")
def distance_bands(spark, sf_dir):
    """Shots and goals by distance from the net."""
    d = F.sqrt((89 - F.col("along")) ** 2 + F.col("across") ** 2)
    return placed(spark, sf_dir).groupBy(F.when(d < 20, "0-20").when(d < 40, "20-40").otherwise("40+").alias("band")).agg(F.count("*").alias("shots"), F.count_if(F.col("action") == "purchase").alias("goals"))


@query(ZONE_SQL + " SELECT player, CAST(count(*) AS BIGINT) AS shots, CAST(count(*) FILTER (WHERE action = 'purchase') AS BIGINT) AS goals, CAST(count(*) FILTER (WHERE sqrt((89 - along) ** 2 + across ** 2) <= 20) AS BIGINT) AS close, round(avg(sqrt((89 - along) ** 2 + across ** 2)), 5) AS mean_distance FROM zone GROUP BY player")
def shooters_table(spark, sf_dir):
    """Shots, goals, shots from up to twenty feet and mean distance of each player."""
    d = F.sqrt((89 - F.col("along")) ** 2 + F.col("across") ** 2)
    return placed(spark, sf_dir).groupBy("player").agg(F.count("*").alias("shots"), F.count_if(F.col("action") == "purchase").alias("goals"), F.count_if(d <= 20).alias("close"), F.round(F.avg(d), 5).alias("mean_distance"))


ZONES = ("Slot", "Center", "RightFlank", "LeftFlank", "BlueLineRight", "BlueLineCenter", "BlueLineLeft")


@query(ZONE_SQL + " SELECT player, " + ", ".join(f"CAST(count(*) FILTER (WHERE zone = '{z}') AS BIGINT) AS {z}" for z in ZONES) + " FROM zone GROUP BY player")
def pivot_by_area(spark, sf_dir):
    """Each player's actions with a column for each zone."""
    return placed(spark, sf_dir).groupBy("player").pivot("zone", list(ZONES)).count().na.fill(0)


@query(f", {TOI}, r AS (SELECT 1 AS tier, player, clicks AS score FROM t WHERE clicks > 12 UNION ALL SELECT 2, player, views FROM t WHERE views > 15 UNION ALL SELECT 3, player, goals FROM t) SELECT CAST(tier AS INTEGER) AS tier, player, CAST(score AS BIGINT) AS score FROM r ORDER BY tier, score DESC, player LIMIT 7")
def takeaways_topk(spark, sf_dir):
    """The first seven of all rules' findings, by tier and size."""
    t = ice_time(spark, sf_dir)
    rules = [t.filter("clicks > 12").select(F.lit(1).alias("tier"), "player", F.col("clicks").alias("score")), t.filter("views > 15").select(F.lit(2).alias("tier"), "player", F.col("views").alias("score")), t.select(F.lit(3).alias("tier"), "player", F.col("goals").alias("score"))]
    return rules[0].unionByName(rules[1]).unionByName(rules[2]).orderBy("tier", F.desc("score"), "player").limit(7)


@query(f", {TOI}, r AS (SELECT player, clicks, row_number() OVER (ORDER BY clicks DESC, player) AS up, row_number() OVER (ORDER BY clicks, player DESC) AS down FROM t) SELECT player, CAST(clicks AS BIGINT) AS clicks, CASE WHEN up <= 5 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE up <= 5 OR down <= 5")
def extremes_top_bottom(spark, sf_dir):
    """The five highest and the five lowest, none twice."""
    t = ice_time(spark, sf_dir).select("player", "clicks")
    high = t.orderBy(F.desc("clicks"), "player").limit(5).withColumn("side", F.lit("top"))
    low = t.orderBy("clicks", F.desc("player")).limit(5).withColumn("side", F.lit("bottom"))
    return high.unionByName(low.join(high, "player", "left_anti").select("player", "clicks", "side"))


@query(" SELECT 'ours' AS side, player FROM act WHERE team = 0 AND action = 'click' UNION ALL SELECT 'theirs', player FROM act WHERE team = 1 AND action = 'view'")
def union_appearances(spark, sf_dir):
    """Both sides' appearances, repeats kept."""
    a = actions(spark, sf_dir)
    return a.filter("team = 0 and action = 'click'").select(F.lit("ours").alias("side"), "player").unionByName(a.filter("team = 1 and action = 'view'").select(F.lit("theirs").alias("side"), "player"))


@query(" SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def except_orphans(spark, sf_dir):
    """Customers without an order."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(" SELECT DISTINCT player, game FROM act WHERE action = 'click' INTERSECT SELECT DISTINCT player, game FROM act WHERE action = 'purchase'")
def intersect_players(spark, sf_dir):
    """Days on which a player both clicks and purchases."""
    a = actions(spark, sf_dir)
    return a.filter("action = 'click'").select("player", "game").intersect(a.filter("action = 'purchase'").select("player", "game"))


@query(" SELECT DISTINCT game, c AS cut FROM (SELECT game, start_us AS c FROM shift WHERE action = 'signup' UNION SELECT game, end_us FROM shift WHERE action = 'signup')")
def distinct_cuts(spark, sf_dir):
    """All times at which something starts or ends, once each."""
    from stintlake.plans.adapter import shifts

    s = shifts(spark, sf_dir).filter("action = 'signup'")
    return s.select("game", F.col("start_us").alias("cut")).union(s.select("game", "end_us")).distinct()


ORD = "od AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS day FROM orders)"


def order_days(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / DAY).alias("day"))


@query(f", {ORD} SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM od a JOIN od b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND abs(a.day - b.day) <= 30 AND a.o_orderkey < b.o_orderkey")
def near_date_merge(spark, sf_dir):
    """Orders of one customer and priority within thirty days of one another."""
    o = order_days(spark, sf_dir)
    a = o.select(F.col("o_orderkey").alias("a"), "o_custkey", "o_orderpriority", "day")
    b = o.select(F.col("o_orderkey").alias("b"), "o_custkey", "o_orderpriority", F.col("day").alias("other"))
    return J.within(a, b, ["o_custkey", "o_orderpriority"], "day", "other", 30, 30, F.col("a") < F.col("b")).select("a", "b")


@query(f", {ORD} SELECT a.o_orderkey FROM od a WHERE a.o_orderpriority LIKE '1%' AND NOT EXISTS (SELECT 1 FROM od b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority LIKE '2%' AND abs(a.day - b.day) <= 60)")
def anti_join_near(spark, sf_dir):
    """Urgent orders without a high one of the customer within sixty days."""
    o = order_days(spark, sf_dir)
    a = o.filter("o_orderpriority like '1%'").select("o_orderkey", "o_custkey", "day")
    b = o.filter("o_orderpriority like '2%'").select("o_custkey", F.col("day").alias("other"))
    return a.join(J.within(a, b, ["o_custkey"], "day", "other", 60, 60).select("o_orderkey").distinct(), "o_orderkey", "left_anti").select("o_orderkey")


@query(""" SELECT c_custkey, coalesce(x.v, y.v, z.v) AS v, CAST(CASE WHEN x.v IS NOT NULL THEN 0 WHEN y.v IS NOT NULL THEN 1 WHEN z.v IS NOT NULL THEN 2 END AS INTEGER) AS layer FROM customer
LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) x ON x.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) y ON y.k = c_custkey
LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0) z ON z.k = c_custkey""")
def priority_overlay(spark, sf_dir):
    """Each customer's value from the first of three sources that has one."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    by = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("v"))
    return J.overlay(c, [by("P"), by("F"), c.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("v"))], "c_custkey", "v")


@query(" SELECT p_partkey, array_to_string(list_sort(string_split(regexp_replace(upper(trim(p_name)), '\\s+', ' ', 'g'), ' ')), ' ') AS name FROM part")
def name_key(spark, sf_dir):
    """Names as sorted upper-case words."""
    return table(spark, sf_dir, "part").select("p_partkey", T.name_key(F.col("p_name")).alias("name"))


@query(" SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '-', 'g') AS slug FROM part")
def slugify(spark, sf_dir):
    """Slugs of part types."""
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_type")).alias("slug"))


@query(""" SELECT o_orderkey, 'TEAM ' || o_custkey AS team_a, CAST(o_orderkey % 7 AS INTEGER) AS goals_a, CAST(o_orderkey % 5 AS INTEGER) AS goals_b, 'SIDE B' AS team_b FROM orders""")
def title_from_name(spark, sf_dir):
    """Teams and score read back from file names."""
    o = table(spark, sf_dir, "orders")
    name = F.format_string("data/Team %s %d _ %d Side B 26.09.2026-2 (1).csv", F.col("o_custkey").cast("string"), F.col("o_orderkey") % 7, F.col("o_orderkey") % 5)
    return o.select("o_orderkey", T.title_parts(name).alias("t")).select("o_orderkey", "t.team_a", "t.goals_a", "t.goals_b", "t.team_b")


@query(""" SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Ratio' WHEN 1 THEN 'Clock' WHEN 2 THEN 'Decimal' ELSE 'CountShare' END AS kind,
CAST(CASE l_linenumber % 4 WHEN 0 THEN CAST(l_quantity AS INTEGER) WHEN 1 THEN CAST(l_quantity AS INTEGER) * 60 + 46.0 WHEN 2 THEN CAST(l_quantity AS INTEGER) + 0.25 ELSE CAST(l_quantity AS INTEGER) END AS DOUBLE) AS a FROM lineitem""")
def cell_parse(spark, sf_dir):
    """Printed cells read as typed values."""
    q = F.col("l_quantity").cast("int").cast("string")
    printed = F.when(F.col("l_linenumber") % 4 == 0, F.concat(q, F.lit(" / 1 33%"))).when(F.col("l_linenumber") % 4 == 1, F.concat(q, F.lit(":46"))).when(F.col("l_linenumber") % 4 == 2, F.concat(q, F.lit(".25"))).otherwise(F.concat(q, F.lit(" 40%")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.cell(printed).alias("c")).select("l_orderkey", "l_linenumber", "c.kind", "c.a")


@query(f""", m AS (SELECT player, at_us // {HOUR} AS hour, list(DISTINCT action) AS names FROM act GROUP BY ALL)
SELECT player, hour, CASE WHEN list_contains(names, 'purchase') THEN 'Goal' WHEN list_contains(names, 'error') THEN 'Penalty' WHEN list_contains(names, 'click') THEN 'Shot' WHEN list_contains(names, 'signup') THEN 'Faceoff' ELSE 'Pass' END AS kind FROM m""")
def goal_describe(spark, sf_dir):
    """What a player did in each hour, by the most important of its actions."""
    m = actions(spark, sf_dir).groupBy("player", F.floor(F.col("at_us") / HOUR).alias("hour")).agg(F.collect_set("action").alias("names"))
    has = lambda k: F.array_contains("names", k)
    return m.select("player", "hour", F.when(has("purchase"), "Goal").when(has("error"), "Penalty").when(has("click"), "Shot").when(has("signup"), "Faceoff").otherwise("Pass").alias("kind"))


@query(""", s AS (SELECT game, team, least(greatest(value / 1000, 0), 1) AS p FROM act WHERE action = 'purchase')
SELECT game, team, round(exp(sum(ln(1 - p))), 9) AS p_none, round(sum(p), 6) AS expected FROM s GROUP BY game, team""")
def poisson_binomial(spark, sf_dir):
    """The chance of no goal and the mean of each team's shots of a day, from the whole distribution of its sum."""
    d = goal_chances(spark, sf_dir)
    return d.select("game", "team", F.round(F.col("d")[0], 9).alias("p_none"), F.round(D.mean_of(F.col("d")), 6).alias("expected"))


def goal_chances(spark, sf_dir) -> DataFrame:
    s = actions(spark, sf_dir).filter("action = 'purchase'").withColumn("p", F.greatest(F.least(F.col("value") / 1000, F.lit(1.0)), F.lit(0.0)))
    return D.success_distributions(s, ["game", "team"], "p")


@query()
def goal_distributions(spark, sf_dir):
    """The chance of every number of goals from each team's shots of a day."""
    return goal_chances(spark, sf_dir).select("game", "team", F.posexplode("d").alias("k", "p")).select("game", "team", F.col("k").cast("long"), F.round("p", 9).alias("chance"))


ORACLES["goal_distributions"] = f"""WITH RECURSIVE {SQL}, s AS (SELECT game, team, least(greatest(value / 1000, 0), 1) AS p, row_number() OVER (PARTITION BY game, team ORDER BY event_id) AS i FROM act WHERE action = 'purchase'),
d AS (SELECT game, team, CAST(0 AS BIGINT) AS i, [1.0::DOUBLE] AS d FROM s WHERE i = 1
  UNION ALL SELECT d.game, d.team, s.i, list_transform(range(1, len(d) + 2), lambda k: coalesce(d[k], 0) * (1 - p) + CASE WHEN k > 1 THEN d[k - 1] * p ELSE 0 END) FROM d JOIN s ON s.game = d.game AND s.team = d.team AND s.i = d.i + 1),
e AS (SELECT game, team, arg_max(d, i) AS d FROM d GROUP BY ALL) SELECT game, team, k - 1 AS k, round(d[k], 9) AS chance FROM (SELECT game, team, d, unnest(range(1, len(d) + 1)) AS k FROM e)"""


@query(f""", {DUELS}, p AS (SELECT period, count(*) AS n, avg(CASE WHEN points = 2 THEN 1.0 ELSE 0 END) AS w, avg(CASE WHEN points = 1 THEN 1.0 ELSE 0 END) AS t FROM o GROUP BY period)
SELECT period, round(n * (2 * w + t), 5) AS mean, round(pow(1 - w - t, n), 12) AS p_zero FROM p""")
def season_points_conv(spark, sf_dir):
    """The distribution of a season's points when every duel ends as the season's shares have it."""
    d = points_chances(spark, sf_dir)
    return d.select("period", F.round(D.mean_of(F.col("d")), 5).alias("mean"), F.round(F.col("d")[0], 12).alias("p_zero"))


def points_chances(spark, sf_dir) -> DataFrame:
    share = lambda k: F.avg((F.col("points") == k).cast("double"))
    p = duels(spark, sf_dir).groupBy("period").agg(F.count("*").cast("int").alias("n"), share(2).alias("w"), share(1).alias("t"))
    return p.select("period", D.powered(F.array(1 - F.col("w") - F.col("t"), F.col("t"), F.col("w")), F.col("n")).alias("d"))


@query()
def points_distribution(spark, sf_dir):
    """The chance of every number of points in a season of such duels."""
    return points_chances(spark, sf_dir).select("period", F.posexplode("d").alias("points", "p")).select("period", F.col("points").cast("long"), F.round("p", 9).alias("chance"))


ORACLES["points_distribution"] = f"""WITH RECURSIVE {SQL}, {DUELS}, share AS (SELECT period, count(*) AS n, avg(CASE WHEN points = 2 THEN 1.0 ELSE 0 END) AS w, avg(CASE WHEN points = 1 THEN 1.0 ELSE 0 END) AS t FROM o GROUP BY period),
sums AS (SELECT period, n, w, t, CAST(0 AS BIGINT) AS i, [1.0::DOUBLE] AS d FROM share
  UNION ALL SELECT period, n, w, t, i + 1, list_transform(range(1, len(d) + 3), lambda k: coalesce(d[k], 0) * (1 - w - t) + CASE WHEN k > 1 THEN coalesce(d[k - 1], 0) * t ELSE 0 END + CASE WHEN k > 2 THEN d[k - 2] * w ELSE 0 END) FROM sums WHERE i < n)
SELECT period, k - 1 AS points, round(d[k], 9) AS chance FROM (SELECT period, d, unnest(range(1, len(d) + 1)) AS k FROM sums WHERE i = n)"""


@query(f""", {DUELS}, x AS (SELECT game, period, greatest(gf, 0.5) AS a, greatest(ga, 0.5) AS b FROM o),
q AS (SELECT CAST(unnest(range(0, (SELECT CAST(ceil(max(greatest(a, b)) + 12 * sqrt(max(greatest(a, b))) + 30) AS BIGINT) + 1 FROM x))) AS BIGINT) AS k),
pa AS (SELECT game, period, k, exp(k * ln(a) - a - lgamma(k + 1)) AS p FROM x, q), pb AS (SELECT game, period, k, exp(k * ln(b) - b - lgamma(k + 1)) AS p FROM x, q)
SELECT pa.game, pa.period, round(sum(CASE WHEN pa.k > pb.k THEN pa.p * pb.p ELSE 0 END), 7) AS win, round(sum(CASE WHEN pa.k = pb.k THEN pa.p * pb.p ELSE 0 END), 7) AS tie FROM pa JOIN pb ON pa.game = pb.game AND pa.period = pb.period GROUP BY ALL""")
def deserved_points(spark, sf_dir):
    """Chances of a win and a tie when both sides score at their own means (Poisson, as far as the means reach)."""
    from stintlake.plans.distributions import poisson_duel

    x = duels(spark, sf_dir).select("game", "period", poisson_duel(F.greatest(F.col("gf"), F.lit(0.5)), F.greatest(F.col("ga"), F.lit(0.5))).alias("d"))
    return x.select("game", "period", F.round("d.win", 7).alias("win"), F.round("d.tie", 7).alias("tie"))


@query(""", g AS (SELECT team, count(*) FILTER (WHERE action = 'view') AS shots, sum(value) FILTER (WHERE action = 'view') / 1000 AS xg, count(*) FILTER (WHERE action = 'purchase') AS goals FROM act GROUP BY team),
a AS (SELECT avg(shots) AS shots, sum(xg) / sum(shots) AS quality FROM g)
SELECT team, round((g.shots - a.shots) * a.quality, 5) AS volume, round(g.xg - g.shots * a.quality, 5) AS quality, round(g.goals - g.xg, 5) AS finishing FROM g, a""")
def goal_split(spark, sf_dir):
    """A team's goals as what its shots' number, quality and finishing bring."""
    kind = F.col("action")
    g = actions(spark, sf_dir).groupBy("team").agg(F.count_if(kind == "view").alias("shots"), (F.sum(F.when(kind == "view", F.col("value"))) / 1000).alias("xg"), F.count_if(kind == "purchase").alias("goals")).withColumn("all", F.lit(1))
    w = Window.partitionBy("all")
    g = g.withColumn("mean", F.avg("shots").over(w)).withColumn("q", F.sum("xg").over(w) / F.sum("shots").over(w))
    return g.select("team", F.round((F.col("shots") - F.col("mean")) * F.col("q"), 5).alias("volume"), F.round(F.col("xg") - F.col("shots") * F.col("q"), 5).alias("quality"), F.round(F.col("goals") - F.col("xg"), 5).alias("finishing"))


@query(" SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 7) AS r2 FROM lineitem GROUP BY l_returnflag")
def ols_simple(spark, sf_dir):
    """Price by quantity."""
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 7).alias("r2"))


@query(""", m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, count(*) AS n FROM lineitem),
g AS (SELECT sum((l_quantity - a) ** 2) + 10 AS aa, sum((l_discount - b) ** 2) + 10 AS bb, sum((l_quantity - a) * (l_discount - b)) AS ab, sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS "by" FROM lineitem, m)
SELECT round((ay * bb - ab * "by") / (aa * bb - ab * ab), 4) AS quantity, round((aa * "by" - ab * ay) / (aa * bb - ab * ab), 2) AS discount FROM g""")
def ridge_gram(spark, sf_dir):
    """A ridge of price on quantity and discount, solved from sums alone."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_extendedprice").alias("y"))
    n = F.count("*")
    c = lambda p, q: F.covar_pop(p, q) * n
    g = l.agg((c("a", "a") + 10).alias("aa"), (c("b", "b") + 10).alias("bb"), c("a", "b").alias("ab"), c("a", "y").alias("ay"), c("b", "y").alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    return g.select(F.round((F.col("ay") * F.col("bb") - F.col("ab") * F.col("by")) / det, 4).alias("quantity"), F.round((F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det, 2).alias("discount"))
