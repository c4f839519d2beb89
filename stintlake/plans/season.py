"""Box scores, seasons, ranks, ratings and shrinkage: queries over players and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.operators import aggregates as A
from stintlake.operators import intervals as I
from stintlake.operators import joins as J
from stintlake.operators import ordered as O
from stintlake.operators import windows as W
from stintlake.plans.adapter import HOUR, SQL, actions, shifts, skater_lines, table, union_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}"
        return f

    return add


KINDS = ("view", "click", "purchase", "signup", "error")


@query(""" SELECT player, CAST(count(*) AS BIGINT) AS total, """ + ", ".join(f"CAST(count(*) FILTER (WHERE action = '{k}') AS BIGINT) AS {k}s" for k in KINDS) + """,
CAST(count(DISTINCT game) AS BIGINT) AS games, round(sum(value), 4) AS magnitude FROM act GROUP BY player""")
def box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count of a player in one pass."""
    counts = [F.count_if(F.col("action") == k).alias(f"{k}s") for k in KINDS]
    return actions(spark, sf_dir).groupBy("player").agg(F.count("*").alias("total"), *counts, F.countDistinct("game").alias("games"), F.round(F.sum("value"), 4).alias("magnitude"))


@query(""", g AS (SELECT team, game, at_us FROM act WHERE action = 'error'), s AS (SELECT player, team, game, start_us, end_us FROM shift WHERE action = 'purchase')
SELECT s.player, CAST(sum(CASE WHEN g.team = s.team THEN 1 ELSE -1 END) AS BIGINT) AS plus_minus, CAST(count(*) AS BIGINT) AS goals_on FROM s JOIN g ON g.game = s.game AND g.at_us >= s.start_us AND g.at_us < s.end_us GROUP BY s.player""")
def plus_minus(spark, sf_dir):
    """Errors of the own team less those of the other during each player's purchase shifts."""
    s = shifts(spark, sf_dir)
    g = s.filter("action = 'error'").select("game", F.col("team").alias("by"), "at_us")
    on = I.point_in_interval(g, s.filter("action = 'purchase'").select("player", "team", "game", "start_us", "end_us"), ["game"])
    return on.groupBy("player").agg(F.sum(F.when(F.col("by") == F.col("team"), 1).otherwise(-1)).alias("plus_minus"), F.count("*").alias("goals_on"))


@query(""" SELECT team, period, CAST(count(*) FILTER (WHERE action IN ('view','click','purchase')) AS BIGINT) AS shots, CAST(count(*) FILTER (WHERE action IN ('click','purchase')) AS BIGINT) AS on_goal, CAST(count(*) FILTER (WHERE action = 'purchase') AS BIGINT) AS goals FROM act GROUP BY team, period""")
def triples_by_period(spark, sf_dir):
    """Attempts, those on goal and goals of each team and period."""
    kind = F.col("action")
    return actions(spark, sf_dir).groupBy("team", "period").agg(F.count_if(kind.isin("view", "click", "purchase")).alias("shots"), F.count_if(kind.isin("click", "purchase")).alias("on_goal"), F.count_if(kind == "purchase").alias("goals"))


#: A place number as a rink point in feet.
POINT = "(place % 178) - 89", "(place * 7 % 85) - 42"
ZONE_SQL = f""", z AS (SELECT *, 89 - along AS out, abs(across) AS wide FROM (SELECT *, CAST({POINT[0]} AS DOUBLE) AS along, CAST({POINT[1]} AS DOUBLE) AS across FROM act WHERE place IS NOT NULL)),
zone AS (SELECT *, CASE WHEN out >= 37 THEN CASE WHEN wide < 16 THEN 'BlueLineCenter' WHEN across < 0 THEN 'BlueLineLeft' ELSE 'BlueLineRight' END
  WHEN out >= 0 AND out < 18 AND wide < 0.6 * out + 5 THEN 'Slot' WHEN out >= 0 AND wide < 0.8 * out + 4.5 THEN 'Center' WHEN across < 0 THEN 'LeftFlank' ELSE 'RightFlank' END AS zone FROM z)"""


def placed(spark, sf_dir) -> DataFrame:
    from stintlake.functions.rink import shot_zone

    a = actions(spark, sf_dir).filter("place is not null").withColumn("along", F.expr(POINT[0]).cast("double")).withColumn("across", F.expr(POINT[1]).cast("double"))
    return a.withColumn("zone", shot_zone(F.col("along"), F.col("across")))


@query(ZONE_SQL + " SELECT team, zone, CAST(count(*) AS BIGINT) AS shots, CAST(count(*) FILTER (WHERE action = 'purchase') AS BIGINT) AS goals FROM zone GROUP BY team, zone")
def zone_counts(spark, sf_dir):
    """Shots and goals by zone of the rink."""
    return placed(spark, sf_dir).groupBy("team", "zone").agg(F.count("*").alias("shots"), F.count_if(F.col("action") == "purchase").alias("goals"))


@query(" SELECT customer, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS games, CAST(count(*) AS BIGINT) AS lines, round(sum(quantity), 4) AS quantity, CAST(sum(returned) AS BIGINT) AS returned, CAST(floor(sum(CAST(round(price * 100) AS BIGINT)) / 100) AS BIGINT) AS price FROM log GROUP BY customer")
def season_totals(spark, sf_dir):
    """Totals of each customer's orders as a season."""
    return skater_lines(spark, sf_dir).groupBy("customer").agg(F.countDistinct("o_orderkey").alias("games"), F.count("*").alias("lines"), F.round(F.sum("quantity"), 4).alias("quantity"), F.sum("returned").alias("returned"), F.expr("sum(cast(round(price * 100) as bigint)) div 100").alias("price"))


TOI = f"""t AS (SELECT player, CAST(sum(end_us - start_us) // 1000000 AS BIGINT) AS toi, count(*) FILTER (WHERE action = 'click') AS clicks, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'purchase') AS goals FROM shift GROUP BY player)"""


def ice_time(spark, sf_dir) -> DataFrame:
    kind = F.col("action")
    return shifts(spark, sf_dir).groupBy("player").agg(
        F.expr("sum(end_us - start_us) div 1000000").alias("toi"), F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("goals")
    )


@query(f", {TOI} SELECT player, toi, " + ", ".join(f"round(CASE WHEN toi > 0 THEN 3600.0 * {c} / toi END, 6) AS {c}_60" for c in ("clicks", "views", "goals")) + " FROM t")
def rates_per60(spark, sf_dir):
    """Counts per 60 minutes of shift time."""
    return ice_time(spark, sf_dir).select("player", "toi", *[F.round(A.ratio(F.col(c), F.col("toi"), 3600.0), 6).alias(f"{c}_60") for c in ("clicks", "views", "goals")])


@query(f", {TOI} SELECT player, round(CASE WHEN clicks + views > 0 THEN 100.0 * clicks / (clicks + views) END, 6) AS share FROM t")
def share_pct(spark, sf_dir):
    """Clicks as a share of clicks and views."""
    return ice_time(spark, sf_dir).select("player", F.round(A.ratio(F.col("clicks"), F.col("clicks") + F.col("views"), 100.0), 6).alias("share"))


@query(f""", {TOI}, w AS (SELECT *, player % 2 AS team, sum(clicks) OVER (PARTITION BY player % 2) - clicks AS c, sum(views) OVER (PARTITION BY player % 2) - views AS v FROM t)
SELECT player, round(CASE WHEN clicks + views > 0 AND c + v > 0 THEN 100.0 * clicks / (clicks + views) - 100.0 * c / (c + v) END, 6) AS relative FROM w""")
def corsi_rel(spark, sf_dir):
    """A player's share less that of the team without them."""
    team = Window.partitionBy(F.col("player") % 2)
    t = ice_time(spark, sf_dir).withColumn("c", F.greatest(F.sum("clicks").over(team) - F.col("clicks"), F.lit(0))).withColumn("v", F.greatest(F.sum("views").over(team) - F.col("views"), F.lit(0)))
    rel = A.ratio(F.col("clicks"), F.col("clicks") + F.col("views"), 100.0) - A.ratio(F.col("c"), F.col("c") + F.col("v"), 100.0)
    return t.select("player", F.round(rel, 6).alias("relative"))


@query(""" SELECT player, action, CAST(trust AS INTEGER) AS trust, CAST(votes AS BIGINT) AS votes FROM (SELECT player, action, period AS trust, count(*) AS votes FROM act GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY player ORDER BY trust DESC, votes DESC, action DESC) = 1""")
def mode_with_trust(spark, sf_dir):
    """Each player's commonest action in the last period they act in."""
    return A.mode_with_trust(actions(spark, sf_dir), "player", "action", "period").withColumnRenamed("period", "trust")


@query(" SELECT player, arg_max(action, (at_us, event_id)) AS action, max(at_us) AS at_us FROM act GROUP BY player")
def last_value_roster(spark, sf_dir):
    """Each player's last action."""
    return actions(spark, sf_dir).groupBy("player").agg(F.max_by("action", F.struct("at_us", "event_id")).alias("action"), F.max("at_us").alias("at_us"))


@query(""", g AS (SELECT team, game, count(*) FILTER (WHERE action = 'click') AS part, count(*) FILTER (WHERE action IN ('click', 'view')) AS whole FROM act GROUP BY team, game)
SELECT team, round(100.0 * sum(part) / sum(whole), 6) AS pooled, round(avg(CASE WHEN whole > 0 THEN 100.0 * part / whole END), 6) AS per_game FROM g GROUP BY team""")
def pooled_vs_mean(spark, sf_dir):
    """A rate over all games against the mean of the games' rates."""
    kind = F.col("action")
    g = actions(spark, sf_dir).groupBy("team", "game").agg(F.count_if(kind == "click").alias("part"), F.count_if(kind.isin("click", "view")).alias("whole"))
    return g.groupBy("team").agg(F.round(A.ratio(F.sum("part"), F.sum("whole"), 100.0), 6).alias("pooled"), F.round(F.avg(A.ratio(F.col("part"), F.col("whole"), 100.0)), 6).alias("per_game"))


LEAGUE = """n AS (SELECT n_name AS team, n_regionkey AS region, round(sum(o_totalprice) / count(*), 4) AS strength, CAST(count(*) AS BIGINT) AS games
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def league(spark, sf_dir) -> DataFrame:
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_name").alias("team"), F.col("n_regionkey").alias("region")).agg(F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("strength"), F.count("*").alias("games"))


@query(f", {LEAGUE} SELECT team, region, strength, games, CAST(1 + (SELECT count(*) FROM n m WHERE m.strength > n.strength) AS INTEGER) AS place FROM n")
def league_rank(spark, sf_dir):
    """One more than the number of teams that are strictly better."""
    return league(spark, sf_dir).withColumn("all", F.lit(1)).withColumn("place", F.rank().over(Window.partitionBy("all").orderBy(F.desc("strength")))).drop("all")


DUELS = """d AS (SELECT game, period, count(*) FILTER (WHERE team = 0 AND action = 'purchase') AS gf, count(*) FILTER (WHERE team = 1 AND action = 'purchase') AS ga FROM act GROUP BY game, period),
o AS (SELECT *, CASE WHEN gf > ga THEN 2 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM d)"""


def duels(spark, sf_dir) -> DataFrame:
    goal = F.col("action") == "purchase"
    d = actions(spark, sf_dir).groupBy("game", "period").agg(F.count_if(goal & (F.col("team") == 0)).alias("gf"), F.count_if(goal & (F.col("team") == 1)).alias("ga"))
    return d.withColumn("points", F.when(F.col("gf") > F.col("ga"), 2).when(F.col("gf") == F.col("ga"), 1).otherwise(0))


@query(f""", {DUELS}, b AS (SELECT 0 AS team, period, gf, ga, points FROM o UNION ALL SELECT 1, period, ga, gf, 2 - points FROM o),
s AS (SELECT team, period, CAST(count(*) AS BIGINT) AS games, CAST(sum(points) AS BIGINT) AS points, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga FROM b GROUP BY team, period)
SELECT *, CAST(row_number() OVER (ORDER BY points * 1.0 / games DESC, gf DESC, team, period) AS INTEGER) AS place FROM s""")
def standings(spark, sf_dir):
    """A table by points a game, goals and name, both sides of every duel counted."""
    o = duels(spark, sf_dir)
    both = o.select(F.lit(0).alias("team"), "period", "gf", "ga", "points").unionByName(o.select(F.lit(1).alias("team"), "period", F.col("ga").alias("gf"), F.col("gf").alias("ga"), (2 - F.col("points")).alias("points")))
    s = both.groupBy("team", "period").agg(F.count("*").alias("games"), F.sum("points").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga")).withColumn("all", F.lit(1))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("all").orderBy(F.desc(F.col("points") / F.col("games")), F.desc("gf"), "team", "period"))).drop("all")


@query(f", {DUELS} SELECT game, period, CAST(sum(points) OVER w AS BIGINT) AS points, CAST(sum(gf - ga) OVER w AS BIGINT) AS difference FROM o WINDOW w AS (PARTITION BY period ORDER BY game ROWS UNBOUNDED PRECEDING)")
def cumulative_points(spark, sf_dir):
    """Running points and goal difference by date."""
    w = Window.partitionBy("period").orderBy("game").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return duels(spark, sf_dir).select("game", "period", F.sum("points").over(w).alias("points"), F.sum(F.col("gf") - F.col("ga")).over(w).alias("difference"))


PAIRS = """h AS (SELECT DISTINCT o_orderkey, supplier FROM log), n AS (SELECT supplier, count(*) AS games FROM h GROUP BY supplier),
p AS (SELECT a.supplier AS a, b.supplier AS b, count(*) AS together FROM h a JOIN h b ON a.o_orderkey = b.o_orderkey AND a.supplier < b.supplier GROUP BY ALL)"""


@query(f", {PAIRS} SELECT p.a, p.b, CAST(together AS BIGINT) AS together, CAST(x.games + y.games - 2 * together AS BIGINT) AS apart FROM p JOIN n x ON x.supplier = p.a JOIN n y ON y.supplier = p.b")
def pair_together_apart(spark, sf_dir):
    """In how many orders two suppliers meet, and in how many only one of them is."""
    h = skater_lines(spark, sf_dir).select("o_orderkey", "supplier").distinct()
    games = h.groupBy("supplier").agg(F.count("*").alias("games"))
    p = h.withColumnRenamed("supplier", "a").join(h.withColumnRenamed("supplier", "b"), "o_orderkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))
    j = p.join(games.withColumnsRenamed({"supplier": "a", "games": "ga"}), "a").join(games.withColumnsRenamed({"supplier": "b", "games": "gb"}), "b")
    return j.select("a", "b", "together", F.greatest(F.col("ga") + F.col("gb") - 2 * F.col("together"), F.lit(0)).alias("apart"))


@query(" SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2 AS DOUBLE) AS mid FROM customer")
def midranks(spark, sf_dir):
    """Average ranks of balances within nations."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", W.midrank("c_acctbal", ["c_nationkey"]).alias("mid"))


@query(" SELECT c_custkey, c_mktsegment, round(100.0 * (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 + count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) / 2) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS percentile FROM customer")
def percentile_midrank(spark, sf_dir):
    """Percentiles of balances within market segments, ties counted half."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round(W.percentile_midrank("c_acctbal", ["c_mktsegment"]), 6).alias("percentile"))


@query(f""", {TOI}, r AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ("toi", "clicks", "views", "goals")) + """ FROM t),
l AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS rho FROM r" for a in ("toi", "clicks", "views", "goals") for b in ("toi", "clicks", "views", "goals") if a < b) + ") SELECT * FROM l")
def spearman_matrix(spark, sf_dir):
    """Rank correlations of the players' figures."""
    names = ("toi", "clicks", "views", "goals")
    r = O.with_midranks(ice_time(spark, sf_dir), {c: f"r_{c}" for c in names}).select(*[F.col(f"r_{c}").alias(c) for c in names])
    pairs = [(a, b) for a in names for b in names if a < b]
    # one aggregate for all pairs; the guard keeps a column without spread from dividing by zero
    safe = [F.when((F.stddev_samp(a) > 0) & (F.stddev_samp(b) > 0), F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))).alias(f"{a}:{b}") for a, b in pairs]
    wide = r.agg(*safe)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(F.col(f"`{a}:{b}`"), 6).alias("rho")) for a, b in pairs])).alias("s")).select("s.*")


@query(" SELECT action, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM act GROUP BY action")
def quantiles(spark, sf_dir):
    """Interpolated quantiles of each action's values."""
    return actions(spark, sf_dir).groupBy("action").agg(*[F.round(F.percentile("value", F.lit(q / 100)), 6).alias(f"q{q}") for q in (10, 50, 90)])


DAILY = "d AS (SELECT player, game, sum(value) AS v FROM act GROUP BY player, game)"


def daily(spark, sf_dir) -> DataFrame:
    return actions(spark, sf_dir).groupBy("player", "game").agg(F.sum("value").alias("v"))


@query(f""", {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game DESC) AS n FROM d),
f AS (SELECT player, avg(v) FILTER (WHERE n <= 3) AS recent, avg(v) FILTER (WHERE n > 3) AS baseline, stddev_samp(v) FILTER (WHERE n > 3) AS sd, count(*) FILTER (WHERE n > 3) AS b FROM k GROUP BY player)
SELECT player, round(recent, 4) AS recent, round(baseline, 4) AS baseline, round(sd, 4) AS sd, round((recent - baseline) / sd, 5) AS z FROM f WHERE b >= 4 AND sd > 0""")
def form_vs_baseline(spark, sf_dir):
    """The last three games against all others."""
    f = W.trailing_form(daily(spark, sf_dir), ["player"], "game", "v")
    return f.select("player", *[F.round(c, 4).alias(c) for c in ("recent", "baseline", "sd")], F.round("z", 5).alias("z"))


@query(f""", {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game DESC) AS n FROM d),
f AS (SELECT player, avg(v) FILTER (WHERE n <= 3) AS last, avg(v) FILTER (WHERE n > 3) AS before, avg(v) AS season FROM k GROUP BY player)
SELECT player, round(season, 4) AS season, CASE WHEN season >= 400 THEN 'Met' WHEN before IS NULL THEN 'NoData' WHEN last > before THEN 'Improving' ELSE 'NotYet' END AS status FROM f""")
def target_status(spark, sf_dir):
    """Whether a season's mean meets a target, or the last games come nearer to it."""
    k = daily(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("game"))))
    f = k.groupBy("player").agg(F.avg(F.when(F.col("n") <= 3, F.col("v"))).alias("last"), F.avg(F.when(F.col("n") > 3, F.col("v"))).alias("before"), F.avg("v").alias("season"))
    status = F.when(F.col("season") >= 400, "Met").when(F.col("before").isNull(), "NoData").when(F.col("last") > F.col("before"), "Improving").otherwise("NotYet")
    return f.select("player", F.round("season", 4).alias("season"), status.alias("status"))


@query(f""", {DAILY}, k AS (SELECT player, game, row_number() OVER w AS i, count(*) OVER (PARTITION BY player) AS n, sum(v) OVER w AS s, sum(v) OVER (PARTITION BY player) AS t FROM d WINDOW w AS (PARTITION BY player ORDER BY game ROWS UNBOUNDED PRECEDING)),
g AS (SELECT player, game AS "at", s / i AS "before", (t - s) / (n - i) AS "after", i * (n - i) / n * (s / i - (t - s) / (n - i)) ** 2 AS gain FROM k WHERE i >= 3 AND n - i >= 3)
SELECT player, "at", round("before", 4) AS "before", round("after", 4) AS "after" FROM g QUALIFY row_number() OVER (PARTITION BY player ORDER BY gain DESC, "at") = 1""")
def best_split(spark, sf_dir):
    """The day at which each player's series changes most."""
    return W.best_split(daily(spark, sf_dir), ["player"], "game", "v").select("player", "at", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


#: Stat, weight and direction of the composite rating.
WEIGHTS = (("goals", 1.0, 1), ("clicks", 0.6, 1), ("views", 0.4, -1))
RATE_SQL = f"""{TOI}, i AS (SELECT player, player % 2 AS position, toi, CASE WHEN toi >= 20000 THEN 1 ELSE 0 END AS ok, """ + ", ".join(f"3600.0 * {s} / toi AS {s}" for s, _, _ in WEIGHTS) + """ FROM t WHERE toi > 0),
l AS (""" + " UNION ALL ".join(f"SELECT player, position, toi, ok, '{s}' AS stat, {w} AS w, {d} AS dir, {s} AS v FROM i" for s, w, d in WEIGHTS) + """),
r AS (SELECT l.*, CASE WHEN count(*) FILTER (WHERE ok = 1) OVER p >= 3 THEN avg(v) FILTER (WHERE ok = 1) OVER p ELSE avg(v) OVER p END AS m,
  CASE WHEN count(*) FILTER (WHERE ok = 1) OVER p >= 3 THEN stddev_samp(v) FILTER (WHERE ok = 1) OVER p ELSE stddev_samp(v) OVER p END AS sd FROM l WINDOW p AS (PARTITION BY position, stat)),
z AS (SELECT *, CASE WHEN sd > 0 THEN dir * greatest(least((toi / (toi + 600.0) * v + 600.0 / (toi + 600.0) * m - m) / sd, 3), -3) ELSE 0 END AS z FROM r),
c AS (SELECT player, position, max(ok) AS ok, sum(w * z) / sum(w) AS z FROM z GROUP BY player, position),
g AS (SELECT c.*, CASE WHEN count(*) FILTER (WHERE ok = 1) OVER q >= 3 THEN avg(z) FILTER (WHERE ok = 1) OVER q ELSE avg(z) OVER q END AS m, CASE WHEN count(*) FILTER (WHERE ok = 1) OVER q >= 3 THEN stddev_samp(z) FILTER (WHERE ok = 1) OVER q ELSE stddev_samp(z) OVER q END AS sd FROM c WINDOW q AS (PARTITION BY position))"""


def pooled(value: str, keys: list[str]) -> tuple:
    """Mean and deviation over the qualified of a group, or over all when fewer than three are."""
    w, ok = Window.partitionBy(*keys), F.when(F.col("ok") == 1, F.col(value))
    few = F.count(ok).over(w) < 3
    return F.when(few, F.avg(value).over(w)).otherwise(F.avg(ok).over(w)), F.when(few, F.stddev_samp(value).over(w)).otherwise(F.stddev_samp(ok).over(w))


def rating_parts(inputs: DataFrame, pool: list[str]) -> DataFrame:
    """Each player's score on each stat: shrunk towards the pool's mean by time, standardised, held within 3 and signed.

    inputs: player, the pool's columns, toi, ok, and the stats of WEIGHTS.
    """
    entries = F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(w).alias("w"), F.lit(d).alias("dir"), F.col(s).alias("v")) for s, w, d in WEIGHTS])
    l = inputs.select("player", *pool, "toi", "ok", F.explode(entries).alias("e")).select("player", *pool, "toi", "ok", "e.*")
    mean, sd = pooled("v", [*pool, "stat"])
    l = l.withColumn("m", mean).withColumn("sd", sd)
    keep = F.col("toi") / (F.col("toi") + 600.0)
    shrunk = keep * F.col("v") + 600.0 / (F.col("toi") + 600.0) * F.col("m")
    z = F.col("dir") * F.greatest(F.least((shrunk - F.col("m")) / F.col("sd"), F.lit(3)), F.lit(-3))
    return l.withColumn("z", F.when(F.col("sd") > 0, z).otherwise(0.0))


def graded(parts: DataFrame, pool: list[str]) -> DataFrame:
    """``player, pool, ok, z, rating``: weighted mean of the scores, put on a scale of 50 and 15 points a deviation."""
    c = parts.groupBy("player", *pool).agg(F.max("ok").alias("ok"), (F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))
    mean, sd = pooled("z", pool)
    c = c.withColumn("m", mean).withColumn("sd", sd)
    scaled = F.when(F.col("sd") > 0, (F.col("z") - F.col("m")) / F.col("sd")).otherwise(F.col("z"))
    return c.withColumn("rating", F.greatest(F.least(50 + 15 * scaled, F.lit(100.0)), F.lit(0.0)))


def rating_inputs(spark, sf_dir) -> DataFrame:
    t = ice_time(spark, sf_dir).filter("toi > 0")
    return t.select("player", (F.col("player") % 2).alias("position"), "toi", (F.col("toi") >= 20000).cast("int").alias("ok"), *[(3600.0 * F.col(s) / F.col("toi")).alias(s) for s, _, _ in WEIGHTS])


@query(f", {RATE_SQL} SELECT player, position, round(z, 5) AS z, round(greatest(least(50 + 15 * CASE WHEN sd > 0 THEN (z - m) / sd ELSE z END, 100), 0), 4) AS rating FROM g")
def composite_rating(spark, sf_dir):
    """A rating of 0 to 100 from weighted, shrunk and standardised rates."""
    return graded(rating_parts(rating_inputs(spark, sf_dir), ["position"]), ["position"]).select("player", "position", F.round("z", 5).alias("z"), F.round("rating", 4).alias("rating"))


@query(f", {RATE_SQL} SELECT z.player, z.stat, round(15 * (z.w / 2.0) * z.z / g.sd, 4) AS points, round(50 - 15 * g.m / g.sd, 4) AS start FROM z JOIN g USING (player) WHERE g.sd > 0")
def rating_points(spark, sf_dir):
    """How many points of a rating each stat brings."""
    parts = rating_parts(rating_inputs(spark, sf_dir), ["position"])
    g = graded(parts, ["position"]).filter("sd > 0").select("player", F.col("m").alias("gm"), F.col("sd").alias("gsd"))
    total = sum(w for _, w, _ in WEIGHTS)
    return parts.join(g, "player").select("player", "stat", F.round(15 * (F.col("w") / total) * F.col("z") / F.col("gsd"), 4).alias("points"), F.round(50 - 15 * F.col("gm") / F.col("gsd"), 4).alias("start"))


@query(f""", {RATE_SQL}, s AS (SELECT player, stat, z, 'strength' AS side, row_number() OVER (PARTITION BY player ORDER BY z DESC, stat) AS n FROM z WHERE z > 0.25 UNION ALL SELECT player, stat, z, 'weakness', row_number() OVER (PARTITION BY player ORDER BY z, stat) FROM z WHERE z < -0.25)
SELECT player, side, stat, round(z, 4) AS z, CAST(n AS INTEGER) AS n FROM s WHERE n <= 2""")
def strengths_weaknesses(spark, sf_dir):
    """Each player's two best and two worst stats beyond a quarter of a deviation."""
    p = rating_parts(rating_inputs(spark, sf_dir), ["position"])
    good = W.top(p.filter("z > 0.25"), ["player"], [F.desc("z"), "stat"], 2).withColumn("side", F.lit("strength"))
    bad = W.top(p.filter("z < -0.25"), ["player"], ["z", "stat"], 2).withColumn("side", F.lit("weakness"))
    return good.unionByName(bad).select("player", "side", "stat", F.round("z", 4).alias("z"), "n")


@query(""", t AS (SELECT player, game, CAST(sum(end_us - start_us) // 1000000 AS BIGINT) AS toi, count(*) AS n FROM shift GROUP BY ALL HAVING sum(end_us - start_us) >= 300000000)
SELECT player, game, round(3600.0 * n / toi, 5) AS rate, round(CASE WHEN stddev_samp(3600.0 * n / toi) OVER (PARTITION BY game) > 0 THEN (3600.0 * n / toi - avg(3600.0 * n / toi) OVER (PARTITION BY game)) / stddev_samp(3600.0 * n / toi) OVER (PARTITION BY game) END, 5) AS z FROM t""")
def game_ratings(spark, sf_dir):
    """Each game as its own pool: a player's rate against all others of five minutes or more."""
    t = shifts(spark, sf_dir).groupBy("player", "game").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"), F.count("*").alias("n")).filter("us >= 300000000")
    t = t.withColumn("rate", 3600.0 * F.col("n") / F.expr("us div 1000000"))
    return t.withColumn("z", F.round(W.zscore("rate", ["game"]), 5)).select("player", "game", F.round("rate", 5).alias("rate"), "z")


PRIOR = """u AS (SELECT player % 2 AS team, player, count(*) FILTER (WHERE action = 'click') AS s, count(*) FILTER (WHERE action IN ('click', 'view')) AS n FROM act GROUP BY player),
a AS (SELECT team, CAST(count(*) AS BIGINT) AS units, sum(s) / sum(n) AS mean, var_samp(s / n) AS var, avg(1.0 / n) AS inv FROM u WHERE n > 0 GROUP BY team),
pr AS (SELECT team, units, mean, CASE WHEN units < 3 OR mean * (1 - mean) <= 0 OR var - mean * (1 - mean) * inv <= 0 THEN 400.0 ELSE least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1, 4.0), 400.0) END AS strength FROM a)"""


def trials(spark, sf_dir) -> DataFrame:
    kind = F.col("action")
    return actions(spark, sf_dir).groupBy((F.col("player") % 2).alias("team"), "player").agg(F.count_if(kind == "click").alias("s"), F.count_if(kind.isin("click", "view")).alias("n"))


@query(f", {PRIOR} SELECT team, units, round(mean, 8) AS mean, round(strength, 4) AS strength FROM pr")
def beta_prior(spark, sf_dir):
    """Empirical-Bayes priors of both teams' shares."""
    return A.beta_prior(trials(spark, sf_dir), ["team"], "s", "n").select("team", "units", F.round("mean", 8).alias("mean"), F.round("strength", 4).alias("strength"))


@query(f", {PRIOR} SELECT player, round(100.0 * (s + strength * mean) / (n + strength), 5) AS posterior FROM u JOIN pr USING (team)")
def eb_posterior_mean(spark, sf_dir):
    """Shares shrunk towards the prior's mean."""
    t = trials(spark, sf_dir)
    return t.join(F.broadcast(A.beta_prior(t, ["team"], "s", "n")), "team").select("player", F.round(100.0 * (F.col("s") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength")), 5).alias("posterior"))


@query(f""", {PRIOR}, w AS (SELECT player, s / n AS p, n, 1.959963984540054 AS z FROM u WHERE n > 0)
SELECT player, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 0), 7) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1), 7) AS high FROM w""")
def wilson_interval(spark, sf_dir):
    """Score intervals of the players' shares."""
    t = trials(spark, sf_dir).filter("n > 0")
    low, high = A.wilson(F.col("s"), F.col("n"))
    return t.select("player", F.round(low, 7).alias("low"), F.round(high, 7).alias("high"))


@query(""", p AS (SELECT player, team, (player * 7919 % 1000 + 1) / 1000.0 AS p FROM (SELECT DISTINCT player, team FROM act)),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY p, player) AS i, count(*) OVER (PARTITION BY team) AS m FROM p)
SELECT player, team, p, round(least(min(p * m / i) OVER (PARTITION BY team ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS adjusted FROM r""")
def bh_adjust(spark, sf_dir):
    """Benjamini-Hochberg corrections within families."""
    p = actions(spark, sf_dir).select("player", "team").distinct().withColumn("p", (F.col("player") * 7919 % 1000 + 1) / F.lit(1000.0))
    return A.benjamini_hochberg(p, ["team"], "p", ["player"]).withColumn("adjusted", F.round("adjusted", 9))
