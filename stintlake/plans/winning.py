"""What goes with winning: each game's shares against its result, one at a time and together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.functions import regression as R
from stintlake.functions import rink
from stintlake.functions import special as S
from stintlake.functions.firth_fits import FirthFit, leave_one_out, run_fits
from stintlake.operators import aggregates as A
from stintlake.plans import game as G
from stintlake.plans.rink_game import rebuilt
from stintlake.plans.xg import shot_model
from stintlake.session import written

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Column, name and unit of a predictor, and how much of it is one unit (fixed values).
PREDICTORS = (
    ("even_share", "Even-strength shot share (CF%)", "5 percentage points", 5.0),
    ("xg_share", "Expected-goals share (xG%)", "5 percentage points", 5.0),
    ("on_goal_share", "Shots on goal share", "5 percentage points", 5.0),
    ("power_plays", "Power plays minus times short-handed", "1 extra power play", 1.0),
    ("faceoffs", "Faceoff win %", "5 percentage points", 5.0),
    ("possession", "Puck possession %", "5 percentage points", 5.0),
)
#: Games from which the single and the joint model are fitted, and the predictors of the joint one (fixed values).
SINGLE_GAMES, JOINT_GAMES, JOINT = 10, 15, (0, 1, 3)


def game_shares(rows: DataFrame, chance, possession: DataFrame | None = None) -> DataFrame:
    """``game, won, difference`` of side 0 and its predictors, in units; null where the game doesn't say.

    rows: rebuilt games; chance: a column that gives the chance of a placed shot; possession: (game, possession in per cent) from
    printed reports, if any.
    """
    on_goal, faceoffs = (sum(F.col(c) for c in cs) for cs in ([f"on_goal_p{p}" for p in (1, 2, 3)], ["faceoffs_won_dz", "faceoffs_won_nz", "faceoffs_won_oz"]))
    t = G.team_summary(rows).select("file", "team", F.col("shots_even").alias("even"), on_goal.alias("on_goal"), faceoffs.alias("faceoffs_won"), "power_plays")
    x = rows.filter("action = 'Shots' and place is not null").groupBy("file", "team").agg(F.sum(chance).alias("xg"))
    g = rows.filter("action = 'Goals'").groupBy("file", "team").agg(F.count("*").alias("goals"))
    side = t.join(x, ["file", "team"], "left").join(g, ["file", "team"], "left").na.fill(0, ["goals"])
    both = side.groupBy(F.col("file").alias("game")).agg(*[F.max(F.when(F.col("team") == s, F.col(c))).alias(f"{c}{s}") for c in ("even", "on_goal", "faceoffs_won", "power_plays", "xg", "goals") for s in (0, 1)])
    counted = [f"{c}{s}" for c in ("even", "on_goal", "faceoffs_won", "power_plays", "goals") for s in (0, 1)]
    both = both.na.fill(0, counted)
    both = both.join(possession, "game", "left") if possession is not None else both.withColumn("possession", F.lit(None).cast("double"))
    share = lambda c: A.ratio(F.col(f"{c}0"), F.col(f"{c}0") + F.col(f"{c}1"), 100.0)
    values = {"even_share": share("even"), "xg_share": share("xg"), "on_goal_share": share("on_goal"), "power_plays": F.col("power_plays0") - F.col("power_plays1"), "faceoffs": share("faceoffs_won"), "possession": F.col("possession")}
    return both.select("game", (F.col("goals0") > F.col("goals1")).cast("double").alias("won"), (F.col("goals0") - F.col("goals1")).cast("double").alias("difference"), F.lit(1.0).alias("one"), *[(values[c] / size).cast("double").alias(c) for c, _, _, size in PREDICTORS])


def shares(spark, sf_dir) -> DataFrame:
    rows, m = rebuilt(spark, sf_dir), shot_model(spark, sf_dir)
    along, across = ((F.col("place") % 178) - 89).cast("double"), ((F.col("place") * 7 % 85) - 42).cast("double")
    return written(game_shares(rows, m.chance(F.ln(rink.distance(along, across)), rink.angle(along, across))), "shares")


COLUMNS = "predictor string, unit string, games long, odds_ratio double, odds_low double, odds_high double, odds_p double, slope double, slope_p double, r2 double"


def single_models(games: DataFrame) -> DataFrame:
    """A row a predictor: the odds of winning for one unit more (Firth's logistic regression, Wald interval and p) and the goal difference
    for it (least squares). Nulls from fewer than ten games, or where nothing can be fitted; no rows from fewer than ten games in all."""
    spark, names = games.sparkSession, [c for c, *_ in PREDICTORS]
    counts = games.agg(F.count("*"), *[F.count(c) for c in names]).first()
    if counts[0] < SINGLE_GAMES:
        return spark.createDataFrame([], COLUMNS)
    ready = [i for i, n in enumerate(counts[1:]) if n >= SINGLE_GAMES]
    fits = {i: FirthFit((0, i + 1)) for i in ready}
    run_fits(games, ["one", *names], "won", "game", list(fits.values()))
    out = []
    for i, (c, name, unit, _) in enumerate(PREDICTORS):
        f, line = fits.get(i), R.ols(games.dropna(subset=[c]), [F.col(c)], F.col("difference")) if i in fits else None
        odds = (None,) * 4
        if f and f.beta is not None:
            b, se = float(f.beta[1]), float(f.se[1])
            odds = (math.exp(b), math.exp(b - 1.96 * se), math.exp(b + 1.96 * se), float(f.p[1]))
        ols = (float(line["beta"][1]), S.t_two_sided(float(line["t"][1]), float(line["df"])), float(line["r2"])) if line else (None,) * 3
        out.append((name, unit, counts[1 + i], *odds, *ols))
    return spark.createDataFrame(out, COLUMNS)


JOINT_COLUMNS = "term string, games long, estimate double, se double, p double, r2 double, adjusted double, f double, f_p double, loo_accuracy double"


def joint_model(games: DataFrame) -> DataFrame:
    """The goal difference by three predictors at once (least squares), and the share of games whose winner Firth's logistic regression of
    the same predictors tells from all other games. No rows from too few games, or where the predictors depend on each other."""
    spark, names = games.sparkSession, [PREDICTORS[i][0] for i in JOINT]
    full = games.dropna(subset=names)
    fit = R.ols(full, [F.col(c) for c in names], F.col("difference")) if full.count() >= JOINT_GAMES else None
    if fit is None:
        return spark.createDataFrame([], JOINT_COLUMNS)
    right, n = leave_one_out(full, ["one", *names], "won", "game")
    shared = (float(fit["r2"]), float(fit["adjusted"]), float(fit["f"]), S.f_sf(float(fit["f"]), float(len(names)), float(fit["df"])), right / n)
    terms = zip(("Intercept", *[PREDICTORS[i][1] for i in JOINT]), fit["beta"], fit["se"], fit["t"])
    return spark.createDataFrame([(t, n, float(b), float(s), S.t_two_sided(float(v), float(fit["df"])), *shared) for t, b, s, v in terms], JOINT_COLUMNS)


@query
def win_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a game's shares go with winning it, each on its own."""
    return single_models(shares(spark, sf_dir))


@query
def win_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shot share, expected-goals share and power plays together, with the accuracy on games left out."""
    return joint_model(shares(spark, sf_dir))
