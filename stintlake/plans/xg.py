"""A chance of scoring for every placed shot, fitted to printed totals, and what is reckoned with it: values, finishing, goals saved."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.functions import rink
from stintlake.functions import totals_fit as T
from stintlake.operators import aggregates as A
from stintlake.plans import distributions as D
from stintlake.plans import game as G
from stintlake.plans.adapter import GAME_SQL
from stintlake.plans.rink_game import GOALIE_SQL, rebuilt
from stintlake.plans.season import placed
from stintlake.session import written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {GAME_SQL}{sql}"
        return f

    return add


FEATURES, GROUP = ["ln_d", "angle"], ["game", "player"]


def shots(spark, sf_dir) -> DataFrame:
    """Placed attempts with log distance, angle, and the total that their group (day and player) is printed with."""
    s = placed(spark, sf_dir).filter("action in ('view', 'purchase')")
    s = s.select("event_id", "game", "player", "along", "across", F.ln(rink.distance(F.col("along"), F.col("across"))).alias("ln_d"), rink.angle(F.col("along"), F.col("across")).alias("angle"), (F.col("action") == "purchase").cast("int").alias("goal"))
    true = 1 / (1 + F.exp(-(2.0 - 1.2 * F.col("ln_d") - 0.5 * F.col("angle"))))
    return s.withColumn("printed", F.round(F.sum(true).over(Window.partitionBy(*GROUP)), 2))


@dataclass
class ShotModel:
    shots: DataFrame
    beta: np.ndarray | None
    without: list[tuple]

    def chance(self, ln_d, angle):
        """A shot's chance from its place; null where nothing could be fitted."""
        return F.lit(None).cast("double") if self.beta is None else T.chance(list(self.beta), [ln_d, angle])

    def valued(self) -> DataFrame:
        """The shots with ``p``, their chance."""
        return self.shots.withColumn("p", self.chance(F.col("ln_d"), F.col("angle")))


_MODELS: dict[tuple[str, str], ShotModel] = {}


def shot_model(spark, sf_dir) -> ShotModel:
    """The model of all days and those without each day, fitted once a session and folder for all queries that use them."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _MODELS:
        s = written(shots(spark, sf_dir), "shots")
        _MODELS[key] = ShotModel(s, *T.without_each_fold(s, FEATURES, GROUP, "printed", "game"))
    return _MODELS[key]


@query()
def xg_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shot model's coefficients, the share of the groups' spread that it explains, how far off it is on days that it was fitted
    without (and how far a flat mean a shot is), and its curve every five feet, straight on and from 45 degrees. No rows where nothing can be fitted."""
    m = shot_model(spark, sf_dir)
    kept = "distance double, straight double, wide double"
    if m.beta is None:
        return spark.createDataFrame([], kept + ", r2 double, folds long, model_error double, flat_error double, intercept double, slope_distance double, slope_angle double")
    r2 = T.explained(m.shots, FEATURES, GROUP, "printed", m.beta)
    held = T.holdout(m.shots, FEATURES, GROUP, "printed", "game", m.without)
    curve = [(5.0 * i, *(float(1 / (1 + math.exp(-(m.beta[0] + m.beta[1] * math.log(max(5.0 * i, 3)) + m.beta[2] * a)))) for a in (0.0, math.pi / 4))) for i in range(1, 17)]
    out = spark.createDataFrame(curve, kept).crossJoin(F.broadcast(r2)).crossJoin(F.broadcast(held))  # one row each
    return out.select("*", *[F.lit(float(b)).alias(n) for b, n in zip(m.beta, ("intercept", "slope_distance", "slope_angle"))])


@query()
def xg_calibration(spark, sf_dir):
    """Every player-day's printed total beside what place alone gives, by the model of all days and by that without the day."""
    m = shot_model(spark, sf_dir)
    k = len(FEATURES) + 1
    fits = spark.createDataFrame([(f, None if b is None else [float(v) for v in b]) for f, _, b in m.without], f"game {m.shots.schema['game'].dataType.simpleString()}, _b array<double>")
    s = m.valued().join(fits, "game").withColumn("q", T.chance([F.col("_b")[i] for i in range(k)], [F.col(c) for c in FEATURES]))
    return s.groupBy(*GROUP).agg(F.count("*").alias("shots"), F.max("printed").alias("printed"), F.sum("p").alias("model"), F.sum("q").alias("without_day"))


#: The same fit in SQL: undamped steps from near the optimum, each from the groups' sums. ``P`` is the chance of a place (ld, an).
P, STEPS = "1 / (1 + exp(-(b0 + b1 * ld + b2 * an)))", 8
FIT = f"""sq AS (SELECT event_id, game, player, action = 'purchase' AS goal, ln(greatest(sqrt((89 - along) ** 2 + across ** 2), 3)) AS ld, atan2(abs(across), 89 - along) AS an FROM (SELECT *, CAST((place % 178) - 89 AS DOUBLE) AS along, CAST((place * 7 % 85) - 42 AS DOUBLE) AS across FROM act WHERE place IS NOT NULL AND action IN ('view', 'purchase'))),
sr AS (SELECT *, round(sum(1 / (1 + exp(-(2.0 - 1.2 * ld - 0.5 * an)))) OVER (PARTITION BY game, player), 2) AS printed FROM sq),
it AS (SELECT 0 AS step, 2.0::DOUBLE AS b0, -1.2::DOUBLE AS b1, -0.5::DOUBLE AS b2 UNION ALL
 SELECT step + 1, b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det, b1 + (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det, b2 + (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
 FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
  SELECT step, b0, b1, b2, sum(w * m * j0) AS g0, sum(w * m * j1) - {T.SLOPE_RIDGE} * b1 AS g1, sum(w * m * j2) - {T.SLOPE_RIDGE} * b2 AS g2, sum(w * j0 * j0) AS h00, sum(w * j0 * j1) AS h01, sum(w * j0 * j2) AS h02, sum(w * j1 * j1) + {T.SLOPE_RIDGE} AS h11, sum(w * j1 * j2) AS h12, sum(w * j2 * j2) + {T.SLOPE_RIDGE} AS h22 FROM (
   SELECT step, b0, b1, b2, 1 / (max(printed) + {T.WEIGHT_FLOOR}) AS w, max(printed) - sum(p) AS m, sum(p * (1 - p)) AS j0, sum(p * (1 - p) * ld) AS j1, sum(p * (1 - p) * an) AS j2 FROM (SELECT it.*, sr.*, {P} AS p FROM it, sr WHERE step < {STEPS}) GROUP BY step, b0, b1, b2, game, player) GROUP BY step, b0, b1, b2))),
beta AS (SELECT b0, b1, b2 FROM it WHERE step = {STEPS}), sv AS (SELECT sr.*, {P} AS p FROM sr, beta)"""


@query(f", {FIT} SELECT event_id, round(p * printed / sum(p) OVER (PARTITION BY game, player), 6) AS xg FROM sv")
def shot_values(spark, sf_dir):
    """The fitted chances scaled within each group so that they add up to its printed total."""
    return scaled(shot_model(spark, sf_dir).valued(), GROUP, "p", "printed").select("event_id", F.round("xg", 6).alias("xg"))


def scaled(rows: DataFrame, group: list[str], value: str, total: str) -> DataFrame:
    """rows with ``xg``: the value times what makes its group add up to the total; unchanged where there is no total or nothing to scale."""
    s = F.sum(value).over(Window.partitionBy(*group))
    return rows.withColumn("xg", F.when(F.col(total).isNotNull() & (s > 0), F.col(value) * F.col(total) / s).otherwise(F.col(value)))


@query(f""", {FIT} SELECT player, CAST(count(*) AS BIGINT) AS shots, CAST(count(*) FILTER (WHERE goal) AS BIGINT) AS goals, round(sum(p), 4) AS xg, round(count(*) FILTER (WHERE goal) - sum(p), 4) AS above, round(exp(sum(ln(1 - p))), 5) AS none FROM sv GROUP BY player""")
def finishing(spark, sf_dir):
    """Goals against what the shots' fitted chances let expect, and the chance of none; see ``finishing_chances`` for the tails."""
    s = shot_model(spark, sf_dir).valued()
    return s.groupBy("player").agg(F.count("*").alias("shots"), F.sum("goal").alias("goals"), F.round(F.sum("p"), 4).alias("xg"), F.round(F.sum("goal") - F.sum("p"), 4).alias("above"), F.round(F.exp(F.sum(F.log1p(-F.col("p")))), 5).alias("none"))


@query()
def finishing_chances(spark, sf_dir):
    """How likely so many goals or more, and so few or fewer, were for each player, from the whole distribution of their shots."""
    return finishing_tails(shot_model(spark, sf_dir).valued())


def finishing_tails(shots: DataFrame) -> DataFrame:
    """``player, at_least, at_most`` of shots (player, p, goal 0 or 1)."""
    goals = shots.groupBy("player").agg(F.sum("goal").cast("int").alias("goals"))
    d = D.success_distributions(shots, ["player"], "p").join(goals, "player")
    high, low = F.slice("d", F.col("goals") + 1, F.size("d")), F.slice("d", F.lit(1), F.col("goals") + 1)
    return d.select("player", D.total(high).alias("at_least"), D.total(low).alias("at_most"))


@query(f""", {GOALIE_SQL}, {FIT}, plx AS (SELECT game, team, ln(greatest(sqrt((89 - along) ** 2 + across ** 2), 3)) AS ld, atan2(abs(across), 89 - along) AS an FROM (SELECT *, CAST((place % 178) - 89 AS DOUBLE) AS along, CAST((place * 7 % 85) - 42 AS DOUBLE) AS across FROM gm WHERE action = 'Shots' AND place IS NOT NULL)), xs AS (SELECT game, team, sum({P}) AS xg FROM plx, beta GROUP BY game, team),
gs0 AS (SELECT gb.game, gb.team, gb.player, goals_against, xg * shots_against / nullif(sum(shots_against) OVER (PARTITION BY gb.game, gb.team), 0) AS xga FROM gb JOIN xs ON xs.game = gb.game AND xs.team = 1 - gb.team) SELECT game, team, player, round(xga, 5) AS xga, round(xga - goals_against, 5) AS saved FROM gs0""")
def goals_saved(spark, sf_dir):
    """What the other side's shots let expect by the fitted model, shared among a side's goalkeepers by the shots that they faced, less their goals against."""
    rows, m = rebuilt(spark, sf_dir), shot_model(spark, sf_dir)
    along, across = ((F.col("place") % 178) - 89).cast("double"), ((F.col("place") * 7 % 85) - 42).cast("double")
    p = m.chance(F.ln(rink.distance(along, across)), rink.angle(along, across))
    xg = rows.filter("action = 'Shots' and place is not null").groupBy("file", (1 - F.col("team")).alias("team")).agg(F.sum(p).alias("xg"))
    g = G.goalie_box(rows).join(xg, ["file", "team"])
    xga = F.col("xg") * A.ratio(F.col("shots_against"), F.sum("shots_against").over(Window.partitionBy("file", "team")))
    return g.select(F.col("file").alias("game"), "team", F.col("player_id").alias("player"), F.round(xga, 5).alias("xga"), F.round(xga - F.col("goals_against"), 5).alias("saved"))
