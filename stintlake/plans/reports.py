"""Season reports from rebuilt games: team record and percentages, league measures, focus areas, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.operators import aggregates as A
from stintlake.plans import game as G
from stintlake.plans.adapter import GAME_SQL, SQL, actions
from stintlake.plans.rink_game import SUMMARY, rebuilt

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, base: str = GAME_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {base}{sql}"
        return f

    return add


#: A row for each game and side with what the other side did as ``o_``.
FACED = ("shots", "on_goal", "goals", "power_plays", "pp_goals", "hits", "fo_dz", "fo_nz", "fo_oz", "battles")
SIDES = f"""{SUMMARY}, sd AS (SELECT t2.game, t2.team, coalesce(shots, 0) AS shots, coalesce(on_goal_p1 + on_goal_p2 + on_goal_p3, 0) AS on_goal, coalesce(goals_p1 + goals_p2 + goals_p3, 0) AS goals, coalesce(power_plays, 0) AS power_plays, coalesce(pp_goals_scored, 0) AS pp_goals, hits, faceoffs_won_dz AS fo_dz, faceoffs_won_nz AS fo_nz, faceoffs_won_oz AS fo_oz, battles_won AS battles
 FROM t2 LEFT JOIN t1 USING (game, team) LEFT JOIN t3 USING (game, team) LEFT JOIN t4 USING (game, team)), bo AS (SELECT a.*, {', '.join(f'b.{c} AS o_{c}' for c in FACED)} FROM sd a JOIN sd b ON a.game = b.game AND b.team = 1 - a.team)"""


def both_sides(rows: DataFrame) -> DataFrame:
    t = G.team_summary(rows)
    on = lambda k: sum(F.col(f"{k}_p{p}") for p in (1, 2, 3))
    s = t.select("file", "team", "shots", on("on_goal").alias("on_goal"), on("goals").alias("goals"), "power_plays", F.col("pp_goals_scored").alias("pp_goals"), "hits", F.col("faceoffs_won_dz").alias("fo_dz"), F.col("faceoffs_won_nz").alias("fo_nz"), F.col("faceoffs_won_oz").alias("fo_oz"), F.col("battles_won").alias("battles"))
    return s.join(s.select("file", (1 - F.col("team")).alias("team"), *[F.col(c).alias(f"o_{c}") for c in FACED]), ["file", "team"])


def pct(part: Column, whole: Column) -> Column:
    return A.ratio(part, whole, 100.0)


@query(f""", {SIDES}, s AS (SELECT team, CAST(count(*) AS BIGINT) AS games, CAST(count(*) FILTER (WHERE goals > o_goals) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE goals = o_goals) AS BIGINT) AS ties, {', '.join(f'sum({c}) AS {c}, sum(o_{c}) AS o_{c}' for c in FACED)} FROM bo GROUP BY team)
SELECT team, games, wins, ties, CAST(goals AS BIGINT) AS goals_for, CAST(o_goals AS BIGINT) AS goals_against, round(100.0 * shots / nullif(shots + o_shots, 0), 5) AS attempt_share, round(100.0 * goals / nullif(on_goal, 0), 5) AS shooting, round(100.0 * (o_on_goal - o_goals) / nullif(o_on_goal, 0), 5) AS saves, round(100.0 * goals / nullif(on_goal, 0) + 100.0 * (o_on_goal - o_goals) / nullif(o_on_goal, 0), 5) AS pdo,
 round(100.0 * pp_goals / nullif(power_plays, 0), 5) AS power_play, round(100.0 * (1 - o_pp_goals / nullif(o_power_plays, 0)), 5) AS penalty_kill FROM s""")
def team_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side's season: record, shares, shooting and save percentages with their sum, special teams."""
    b = both_sides(rebuilt(spark, sf_dir))
    s = b.groupBy("team").agg(F.count("*").alias("games"), F.count_if(F.col("goals") > F.col("o_goals")).alias("wins"), F.count_if(F.col("goals") == F.col("o_goals")).alias("ties"), *[F.sum(c).alias(c) for n in FACED for c in (n, f"o_{n}")])
    c = F.col
    shooting, saves = pct(c("goals"), c("on_goal")), pct(c("o_on_goal") - c("o_goals"), c("o_on_goal"))
    r = {"attempt_share": pct(c("shots"), c("shots") + c("o_shots")), "shooting": shooting, "saves": saves, "pdo": shooting + saves, "power_play": pct(c("pp_goals"), c("power_plays")), "penalty_kill": 100.0 - pct(c("o_pp_goals"), c("o_power_plays"))}
    return s.select("team", "games", "wins", "ties", c("goals").alias("goals_for"), c("o_goals").alias("goals_against"), *[F.round(v, 5).alias(n) for n, v in r.items()])


#: League measure, part, whole (nothing: the mean of the games' parts), direction (fixed values; those of reports are left out).
MEASURES = (
    ("Goals for", "goals", "", 1), ("Goals against", "o_goals", "", -1), ("Shot attempts for", "shots", "", 1), ("Shot attempts against", "o_shots", "", -1), ("Shot attempt share", "shots", "shots + o_shots", 1),
    ("Shots on goal for", "on_goal", "", 1), ("Shots on goal against", "o_on_goal", "", -1), ("Shooting %", "goals", "on_goal", 1), ("Save %", "greatest(o_on_goal - o_goals, 0)", "o_on_goal", 1),
    ("Faceoff win %", "fo_dz + fo_nz + fo_oz", "fo_dz + fo_nz + fo_oz + o_fo_dz + o_fo_nz + o_fo_oz", 1), ("Puck battles won %", "battles", "battles + o_battles", 1), ("Power play %", "pp_goals", "power_plays", 1),
    ("Penalty kill %", "greatest(o_power_plays - o_pp_goals, 0)", "o_power_plays", 1), ("Times short-handed", "o_power_plays", "", -1), ("Hits", "hits", "", 1),
)


@query(f", {SIDES}, ms AS ({' UNION ALL '.join(f'''SELECT team, '{n}' AS measure, {d} AS dir, {f'100.0 * sum({p}) / nullif(sum({w}), 0)' if w else f'avg({p})'} AS v FROM bo GROUP BY team''' for n, p, w, d in MEASURES)}) SELECT team, measure, round(v, 6) AS value, CAST(1 + (SELECT count(*) FROM ms o WHERE o.measure = ms.measure AND o.dir * (o.v - ms.v) > 1e-9) AS INTEGER) AS place FROM ms")
def league_measures(spark, sf_dir):
    """Fifteen measures of each side, as the mean of its games or pooled over them, and its place (one more than those that are better)."""
    b = both_sides(rebuilt(spark, sf_dir))
    value = lambda p, w: (F.avg(F.expr(p)) if not w else A.ratio(F.sum(F.expr(p)), F.sum(F.expr(w)), 100.0)).cast("double")
    s = b.groupBy("team").agg(F.array(*[F.struct(F.lit(n).alias("measure"), F.lit(d).alias("dir"), value(p, w).alias("v")) for n, p, w, d in MEASURES]).alias("m"))
    s = s.select("team", F.explode("m").alias("m")).select("team", "m.*").withColumn("r", F.round(F.col("dir") * F.col("v"), 8))
    return s.select("team", "measure", F.round("v", 6).alias("value"), F.when(F.col("v").isNull(), 1).otherwise(F.rank().over(Window.partitionBy("measure").orderBy(F.desc_nulls_last("r")))).alias("place"))


#: Area, part, whole, benchmark, fewest events (fixed values).
AREAS = (("Faceoffs in our zone", "fo_dz", "fo_dz + o_fo_oz", 50, 8), ("Faceoffs in their zone", "fo_oz", "fo_oz + o_fo_dz", 50, 8), ("Puck battles", "battles", "battles + o_battles", 50, 8), ("Power play", "pp_goals", "power_plays", 20, 1), ("Penalty kill", "o_power_plays - o_pp_goals", "o_power_plays", 80, 1))


@query(f""", {SIDES}, fa AS ({' UNION ALL '.join(f"SELECT team, '{n}' AS area, sum({p}) AS k, sum({w}) AS n, {b} AS benchmark FROM bo GROUP BY team HAVING sum({w}) >= {m}" for n, p, w, b, m in AREAS)})
SELECT team, area, CAST(n AS BIGINT) AS events, round(100.0 * k / n, 5) AS share, CASE WHEN n < 10 THEN 'Watch' WHEN 100.0 * k / n - benchmark >= 8 THEN 'Strength' WHEN 100.0 * k / n - benchmark <= -8 THEN 'WorkOn' ELSE 'Watch' END AS verdict FROM fa""")
def focus_areas(spark, sf_dir):
    """Areas of play that lie eight points above or below their benchmark; fewer than ten events are only watched."""
    b = both_sides(rebuilt(spark, sf_dir))
    s = b.groupBy("team").agg(F.array(*[F.struct(F.lit(n).alias("area"), F.sum(F.expr(p)).alias("k"), F.sum(F.expr(w)).alias("n"), F.lit(m).alias("benchmark"), F.lit(x).alias("least")) for n, p, w, m, x in AREAS]).alias("a"))
    s = s.select("team", F.explode("a").alias("a")).select("team", "a.*").filter("n >= least").withColumn("share", 100.0 * F.col("k") / F.col("n"))
    gap = F.col("share") - F.col("benchmark")
    return s.select("team", "area", F.col("n").alias("events"), F.round("share", 5).alias("share"), F.when(F.col("n") < 10, "Watch").when(gap >= 8, "Strength").when(gap <= -8, "WorkOn").otherwise("Watch").alias("verdict"))


@query(""", d AS (SELECT player, game, sum(value) AS v FROM act GROUP BY player, game), lo AS (SELECT * FROM d WHERE game % 4 = 0), hi AS (SELECT player, game, v + 1 AS v FROM d WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.player = d.player AND abs(lo.game - d.game) <= 1)), u AS (SELECT *, 'loaded' AS source FROM lo UNION ALL SELECT *, 'history' FROM hi)
SELECT player, CAST(count(*) AS BIGINT) AS games, CAST(count(*) FILTER (WHERE source = 'history') AS BIGINT) AS history, round(regr_slope(v, game - 19700), 3) AS slope FROM u GROUP BY player HAVING count(*) > 1""", SQL)
def trends(spark, sf_dir):
    """A player's series from loaded games and from a history of others: history within a day of a loaded game is that game."""
    d = actions(spark, sf_dir).groupBy("player", "game").agg(F.sum("value").alias("v"))
    loaded = d.filter("game % 4 = 0")
    near = loaded.select("player", F.explode(F.array(F.col("game") - 1, F.col("game"), F.col("game") + 1)).alias("game")).distinct()
    history = d.join(near, ["player", "game"], "left_anti").withColumn("v", F.col("v") + 1)
    u = loaded.withColumn("source", F.lit("loaded")).unionByName(history.withColumn("source", F.lit("history")))
    return u.groupBy("player").agg(F.count("*").alias("games"), F.count_if(F.col("source") == "history").alias("history"), F.round(F.regr_slope("v", F.col("game") - 19700), 3).alias("slope")).filter("games > 1")
