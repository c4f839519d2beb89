"""Ratings from a registry of nineteen stats: pools, shrinkage, category scores, grades, presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.plans import game as G
from stintlake.plans.adapter import GAME_SQL
from stintlake.plans.rink_game import BOX, rebuilt
from stintlake.plans.season import pooled

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {GAME_SQL}{sql}"
        return f

    return add


#: Stat, category, scale, part, whole, direction (less is better: -1), weight for forwards and for defence (fixed values).
STATS = (
    ("Points/60", "Offence", 3600, "points", "toi", 1, 3.0, 2.0), ("Goals/60", "Offence", 3600, "goals", "toi", 1, 1.5, 0.5), ("Shots/60", "Offence", 3600, "shots", "toi", 1, 1.5, 1.0),
    ("xG/60", "Offence", 3600, "xg", "toi", 1, 2.5, 1.0), ("Entries/60", "Offence", 3600, "entries", "toi", 1, 1.0, 0.5), ("Attempts for on ice/60", "Offence", 3600, "cf", "ev_toi", 1, 1.5, 2.0),
    ("Recoveries in their zone/60", "Offence", 3600, "recoveries_oz", "toi", 1, 1.0, 0.5),
    ("Shot share vs team", "Defence", 1, "rel", "one", 1, 3.0, 3.0), ("Attempts against/60", "Defence", 3600, "ca", "ev_toi", -1, 1.5, 2.5), ("xG against on ice/60", "Defence", 3600, "xga", "toi", -1, 2.0, 2.5),
    ("Blocks/60", "Defence", 3600, "blocks", "toi", 1, 0.5, 1.0), ("Hits/60", "Defence", 3600, "hits", "toi", 1, 0.0, 0.5), ("Own-zone losses/60", "Defence", 3600, "losses_dz", "toi", -1, 1.5, 2.0),
    ("Battles won %", "PuckPlay", 100, "won", "battles", 1, 2.0, 2.0), ("Recoveries/60", "PuckPlay", 3600, "recoveries", "toi", 1, 1.5, 2.0), ("Puck losses/60", "PuckPlay", 3600, "losses", "toi", -1, 1.5, 1.5),
    ("Passes/60", "PuckPlay", 3600, "passes", "toi", 1, 1.0, 1.5), ("Faceoff %", "PuckPlay", 100, "fo_won", "fo", 1, 1.0, 0.0), ("Carry-in %", "PuckPlay", 100, "carry", "entries", 1, 1.0, 0.5),
)
#: Stats that only one's own players have (the reports that they come from list no others).
OURS_ONLY = ("xG/60", "xG against on ice/60", "Passes/60")
#: Preset and the weights of offence, defence and puck play for forwards and for defence.
PRESETS = {
    "Recommended": ((1.5, 1.0, 1.0), (1.0, 1.5, 1.0)), "Offence first": ((3.0, 0.5, 0.5),) * 2, "Defence first": ((0.5, 3.0, 0.5),) * 2, "Puck control": ((0.5, 0.5, 3.0),) * 2, "Simple balanced": ((1.0, 1.0, 1.0),) * 2,
}
CATEGORIES = ("Offence", "Defence", "PuckPlay")
QUALIFIED_S, SHRINK_S = 1800, 600

#: Season totals and the box score's fields that they sum.
TOTALS = {"goals": "goals", "shots": "shots", "entries": "entries", "cf": "corsi_for", "ca": "corsi_against", "recoveries_oz": "puck_recoveries_oz", "blocks": "blocked_shots", "hits": "hits", "losses_dz": "puck_losses_dz", "battles": "puck_battles", "won": "puck_battles_won", "recoveries": "puck_recoveries", "losses": "puck_losses", "passes": "passes", "fo": "faceoffs", "fo_won": "faceoffs_won", "carry": "entries_carry"}
_BOX_CTES, _BOX_ROWS = BOX.rsplit("\nSELECT game", 1)
SEASON = f"""{_BOX_CTES}, bx AS (SELECT game{_BOX_ROWS}), se AS (SELECT player, team, {', '.join(f'sum({c}) AS {n}' for n, c in TOTALS.items())}, sum(goals + assists) AS points, sum(toi_ms) / 1000.0::DOUBLE AS toi, greatest(sum(toi_ms - pp_ms - sh_ms), 0) / 1000.0::DOUBLE AS ev_toi FROM bx GROUP BY ALL),
inp AS (SELECT *, 1 AS one, CASE WHEN player // 2 % 5 < 2 THEN 'Defence' ELSE 'Forward' END AS position, CASE WHEN toi >= {QUALIFIED_S} THEN 1 ELSE 0 END AS ok, CASE WHEN team = 0 THEN shots * 0.09 + goals * 0.2 END AS xg, CASE WHEN team = 0 THEN ca * 0.05 END AS xga,
 CASE WHEN cf + ca > 0 AND sum(cf + ca) OVER w - cf - ca > 0 THEN 100.0 * cf / (cf + ca) - 100.0 * (sum(cf) OVER w - cf) / (sum(cf + ca) OVER w - cf - ca) END AS rel FROM se WINDOW w AS (PARTITION BY team))"""
RATED = f"""{SEASON}, l0 AS ({' UNION ALL '.join(f"SELECT player, team, position, toi, ok, '{s}' AS stat, '{c}' AS category, {d} AS dir, CASE WHEN position = 'Forward' THEN {wf} ELSE {wd} END AS w, CASE WHEN {n} > 0{'' if s not in OURS_ONLY else ' AND team = 0'} THEN {k} * {p} / {n} END AS v FROM inp" for s, c, k, p, n, d, wf, wd in STATS)}),
l1 AS (SELECT * FROM l0 WHERE w > 0 AND v IS NOT NULL), l2 AS (SELECT *, CASE WHEN count(*) FILTER (WHERE ok = 1) OVER p >= 3 THEN avg(v) FILTER (WHERE ok = 1) OVER p ELSE avg(v) OVER p END AS m, CASE WHEN count(*) FILTER (WHERE ok = 1) OVER p >= 3 THEN stddev_samp(v) FILTER (WHERE ok = 1) OVER p ELSE stddev_samp(v) OVER p END AS sd FROM l1 WINDOW p AS (PARTITION BY position, stat)),
l3 AS (SELECT *, CASE WHEN sd > 1e-12 THEN dir * greatest(least(toi / (toi + {SHRINK_S}) * (v - m) / sd, 3), -3) ELSE 0 END AS z FROM l2), ca0 AS (SELECT player, team, position, ok, category, sum(w * z) / sum(w) AS s FROM l3 GROUP BY ALL)"""


def inputs(rows: DataFrame) -> DataFrame:
    """Season totals of all skaters with position, qualification, expected goals and the share against the team without them."""
    s = G.box(rows).groupBy(F.col("player_id").alias("player"), "team").agg(*[F.sum(c).alias(n) for n, c in TOTALS.items()], F.sum(F.col("goals") + F.col("assists")).alias("points"), (F.sum("toi_ms") / 1000.0).alias("toi"), (F.greatest(F.sum(F.col("toi_ms") - F.col("pp_ms") - F.col("sh_ms")), F.lit(0)) / 1000.0).alias("ev_toi"))
    w = Window.partitionBy("team")
    ocf, oca = F.sum("cf").over(w) - F.col("cf"), F.sum("ca").over(w) - F.col("ca")
    own, rest = F.col("cf") + F.col("ca"), ocf + oca
    ours = F.col("team") == 0
    return s.select(
        "*", F.lit(1).alias("one"), F.when(F.floor(F.col("player") / 2) % 5 < 2, "Defence").otherwise("Forward").alias("position"), (F.col("toi") >= QUALIFIED_S).cast("int").alias("ok"),
        F.when(ours, F.col("shots") * 0.09 + F.col("goals") * 0.2).alias("xg"), F.when(ours, F.col("ca") * 0.05).alias("xga"), F.when((own > 0) & (rest > 0), 100.0 * F.col("cf") / own - 100.0 * ocf / rest).alias("rel"),
    )


def scores(x: DataFrame) -> DataFrame:
    """Each player's score on each stat of positive weight: shrunk towards the pool by time, in its deviations, within 3, signed."""
    entry = lambda s, c, k, p, n, d, wf, wd: F.struct(
        F.lit(s).alias("stat"), F.lit(c).alias("category"), F.lit(d).alias("dir"), F.when(F.col("position") == "Forward", wf).otherwise(wd).alias("w"),
        F.when((F.col(n) > 0) & ((F.col("team") == 0) if s in OURS_ONLY else F.lit(True)), k * F.col(p) / F.col(n)).cast("double").alias("v"))
    l = x.select("player", "team", "position", "toi", "ok", F.explode(F.array(*[entry(*s) for s in STATS])).alias("e")).select("player", "team", "position", "toi", "ok", "e.*").filter("w > 0 and v is not null")
    mean, sd = pooled("v", ["position", "stat"])
    l = l.withColumn("m", mean).withColumn("sd", sd)
    z = F.col("toi") / (F.col("toi") + SHRINK_S) * (F.col("v") - F.col("m")) / F.col("sd")
    return l.withColumn("z", F.when(F.col("sd") > 1e-12, F.col("dir") * F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0))).otherwise(0.0))


def categories(l: DataFrame) -> DataFrame:
    """``player, team, position, ok, category, s``: the weighted mean of a category's scores."""
    return l.groupBy("player", "team", "position", "ok", "category").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("s"))


def overall(c: DataFrame, preset: str = "Recommended") -> DataFrame:
    """``player, team, position, ok, s``: the mean of the category scores by a preset's weights."""
    forward, defence = PRESETS[preset]
    weight = F.lit(0.0)
    for name, f, d in zip(CATEGORIES, forward, defence):
        weight = F.when(F.col("category") == name, F.when(F.col("position") == "Forward", f).otherwise(d)).otherwise(weight)
    c = c.withColumn("w", weight)
    return c.groupBy("player", "team", "position", "ok").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("s"))


def graded(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with ``grade``: its score ``s`` on a scale of 50 and 15 points a deviation of the pool; without spread the score itself counts
    as deviations."""
    mean, sd = pooled("s", keys)
    df = df.withColumn("m", mean).withColumn("sd", sd)
    z = F.when(F.col("sd") > 1e-12, (F.col("s") - F.col("m")) / F.col("sd")).otherwise(F.col("s"))
    return df.withColumn("grade", F.greatest(F.least(50 + 15 * z, F.lit(100.0)), F.lit(0.0)))


@query(f", {RATED} SELECT player, stat, category, round(v, 6) AS value, round(z, 6) AS score FROM l3")
def rating_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nineteen stats of every skater, with the score that each gets in its pool."""
    return scores(inputs(rebuilt(spark, sf_dir))).select("player", "stat", "category", F.round("v", 6).alias("value"), F.round("z", 6).alias("score"))


def _grade_sql(source: str, keys: str) -> str:
    pool = lambda f: f"CASE WHEN count(*) FILTER (WHERE ok = 1) OVER p >= 3 THEN {f}(s) FILTER (WHERE ok = 1) OVER p ELSE {f}(s) OVER p END"
    return f"SELECT *, greatest(least(50 + 15 * CASE WHEN sd > 1e-12 THEN (s - m) / sd ELSE s END, 100), 0) AS grade FROM (SELECT *, {pool('avg')} AS m, {pool('stddev_samp')} AS sd FROM {source} WINDOW p AS (PARTITION BY {keys}))"


@query(f", {RATED} SELECT player, category, round(s, 6) AS score, round(grade, 4) AS grade FROM ({_grade_sql('ca0', 'position, category')})")
def category_grades(spark, sf_dir):
    """Offence, defence and puck play of every skater on the scale of the pool."""
    c = graded(categories(scores(inputs(rebuilt(spark, sf_dir)))), ["position", "category"])
    return c.select("player", "category", F.round("s", 6).alias("score"), F.round("grade", 4).alias("grade"))


_WEIGHTS = " UNION ALL ".join(f"SELECT '{n}' AS preset, '{c}' AS category, '{pos}' AS position, {w}::DOUBLE AS pw" for n, both in PRESETS.items() for pos, ws in zip(("Forward", "Defence"), both) for c, w in zip(CATEGORIES, ws))


@query(f", {RATED}, pw AS ({_WEIGHTS}), ov AS (SELECT preset, player, ca0.position, ok, sum(pw * s) / sum(pw) AS s FROM ca0 JOIN pw ON pw.category = ca0.category AND pw.position = ca0.position GROUP BY preset, player, ca0.position, ok) SELECT preset, player, position, round(grade, 4) AS rating FROM ({_grade_sql('ov', 'preset, position')})")
def preset_ratings(spark, sf_dir):
    """The rating of every skater under each of the five presets."""
    from functools import reduce

    from stintlake.session import written

    c = written(categories(scores(inputs(rebuilt(spark, sf_dir)))), "categories")
    each = [graded(overall(c, p), ["position"]).withColumn("preset", F.lit(p)) for p in PRESETS]
    return reduce(DataFrame.unionByName, each).select("preset", "player", "position", F.round("grade", 4).alias("rating"))


@query(f""", {RATED}, ov AS (SELECT player, position, ok, sum(CASE category WHEN 'Offence' THEN CASE position WHEN 'Forward' THEN 1.5 ELSE 1.0 END WHEN 'Defence' THEN CASE position WHEN 'Forward' THEN 1.0 ELSE 1.5 END ELSE 1.0 END * s) / sum(CASE category WHEN 'Offence' THEN CASE position WHEN 'Forward' THEN 1.5 ELSE 1.0 END WHEN 'Defence' THEN CASE position WHEN 'Forward' THEN 1.0 ELSE 1.5 END ELSE 1.0 END) AS s FROM ca0 GROUP BY player, position, ok),
gr AS ({_grade_sql('ov', 'position')}), ps AS (SELECT position, avg(grade) AS mean, CAST(count(*) AS BIGINT) AS n FROM gr WHERE ok = 1 GROUP BY position) SELECT position, n, round(mean, 4) AS mean, CASE WHEN mean >= 53 THEN 'above' WHEN mean <= 47 THEN 'below' ELSE 'about level with' END AS verdict FROM ps""")
def pool_verdicts(spark, sf_dir):
    """Where the qualified players of a position stand on average against the typical one."""
    g = graded(overall(categories(scores(inputs(rebuilt(spark, sf_dir))))), ["position"]).filter("ok = 1")
    p = g.groupBy("position").agg(F.count("*").alias("n"), F.avg("grade").alias("mean"))
    return p.select("position", "n", F.round("mean", 4).alias("mean"), F.when(F.col("mean") >= 53, "above").when(F.col("mean") <= 47, "below").otherwise("about level with").alias("verdict"))


@query(f", {RATED}, im AS (SELECT position, stat, avg(abs(w * z)) AS effect FROM l3 WHERE ok = 1 GROUP BY position, stat) SELECT position, stat, round(effect, 6) AS effect, CAST(row_number() OVER (PARTITION BY position ORDER BY round(effect, 6) DESC, stat) AS INTEGER) AS place FROM im WHERE effect > 0")
def rating_drivers(spark, sf_dir):
    """Which stats move the ratings of a position most: the mean size of their weighted scores among the qualified."""
    l = scores(inputs(rebuilt(spark, sf_dir))).filter("ok = 1")
    i = l.groupBy("position", "stat").agg(F.avg(F.abs(F.col("w") * F.col("z"))).alias("effect")).filter("effect > 0").withColumn("effect", F.round("effect", 6))
    return i.select("position", "stat", "effect", F.row_number().over(Window.partitionBy("position").orderBy(F.desc("effect"), "stat")).alias("place"))
