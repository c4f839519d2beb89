"""Games rebuilt from rows: strength, goals, stints, units, box scores of skaters, goalkeepers and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.functions import rink
from stintlake.operators import aggregates as A
from stintlake.operators import intervals as I
from stintlake.operators import joins as J
from stintlake.plans import game as G
from stintlake.plans.adapter import GAME_SQL, GOALIE, game_rows
from stintlake.session import written

QUERIES, ORACLES = {}, {}
_REBUILT: dict[tuple[str, str], DataFrame] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {GAME_SQL}{sql}"
        return f

    return add


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows on the game clock, written once a session and folder for all queries that share them."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _REBUILT:
        _REBUILT[key] = written(G.on_clock(written(game_rows(spark, sf_dir), "rows")), "clocked")
    return _REBUILT[key]


def merged_sql(name: str, source: str, keys: str, gap: float = 1) -> str:
    """CTE text: spans (s, e) of ``source`` merged by ``keys`` when less than ``gap`` apart."""
    return f"""{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN p IS NULL OR s - p >= {gap} THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {source}))) GROUP BY {keys}, island)"""


def strength_sql(at: str, side: str, row: str) -> str:
    return f"coalesce((SELECT arg_min(CASE WHEN adv.team = {side} THEN 'PowerPlay' ELSE 'ShortHanded' END, (adv.s, CASE WHEN adv.team = {side} THEN 0 ELSE 1 END)) FROM adv WHERE adv.game = {row}.game AND adv.s < {at} AND {at} <= adv.e), 'Even')"


ADV = f"""pps AS (SELECT * FROM gs WHERE action = 'Power play shifts'), {merged_sql('adv', 'pps', 'game, team')},
gk AS (SELECT DISTINCT game, team, player FROM gm WHERE action IN ('Saves', 'Shots against', 'Goals against')),
ss AS (SELECT * FROM gs WHERE action = 'All shifts' AND (game, team, player) NOT IN (SELECT game, team, player FROM gk)), {merged_sql('sh', 'ss', 'game, team, player, period')}, sides AS (SELECT unnest([0::BIGINT, 1::BIGINT]) AS side)"""
GOALS = f"""{ADV}, g0 AS (SELECT game, period, row_no, team AS by, player, t, side AS team, team = side AS scored FROM gm, sides WHERE action = 'Goals'),
gl AS (SELECT *, count(*) FILTER (WHERE scored) OVER w AS score_for, count(*) FILTER (WHERE NOT scored) OVER w AS score_against, {strength_sql('g0.t - 0.25', 'g0.team', 'g0')} AS strength FROM g0 WINDOW w AS (PARTITION BY game, team ORDER BY t, row_no ROWS UNBOUNDED PRECEDING)),
gon AS (SELECT gl.*, sh.player AS who FROM gl JOIN sh ON sh.game = gl.game AND sh.team = gl.team AND sh.s < gl.t - 0.25 AND gl.t - 0.25 <= sh.e)"""
ATTEMPTS = f"at0 AS (SELECT game, row_no, t, side AS team, team = side AS mine FROM gm, sides WHERE action = 'Shots'), att AS (SELECT * FROM at0 WHERE {strength_sql('at0.t', 'at0.team', 'at0')} = 'Even')"


@query(f", {ADV} SELECT game, team, round(s, 3) AS start_s, round(e, 3) AS end_s FROM adv")
def man_advantages(spark, sf_dir):
    """Each side's power plays on the game clock."""
    return G.advantages(rebuilt(spark, sf_dir)).select(F.col("file").alias("game"), F.col("by").alias("team"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@query(f", {GOALS} SELECT gl.game, gl.team, gl.row_no, round(gl.t, 3) AS clock_s, gl.scored, gl.strength, CAST(score_for AS BIGINT) AS score_for, CAST(score_against AS BIGINT) AS score_against, (SELECT CAST(count(DISTINCT who) AS INTEGER) FROM gon WHERE gon.game = gl.game AND gon.team = gl.team AND gon.row_no = gl.row_no) AS skaters FROM gl")
def goal_strengths(spark, sf_dir):
    """Every goal from both sides: running score, strength and how many skaters were on."""
    g = G.skater_counts(rebuilt(spark, sf_dir))
    return g.select(F.col("file").alias("game"), "team", "row_no", F.round("clock_s", 3).alias("clock_s"), "scored", "strength", "score_for", "score_against", F.col("skaters").cast("int").alias("skaters"))


PM = "pm AS (SELECT game, team, who AS player, sum(CASE WHEN scored AND strength <> 'PowerPlay' THEN 1 WHEN NOT scored AND strength <> 'ShortHanded' THEN -1 ELSE 0 END) AS plus_minus FROM (SELECT DISTINCT game, team, row_no, scored, strength, who FROM gon) GROUP BY ALL)"


@query(f", {GOALS}, {PM} SELECT game, team, player, CAST(plus_minus AS BIGINT) AS plus_minus FROM pm")
def plus_minus_rules(spark, sf_dir):
    """Plus-minus without own power-play goals and goals against while short-handed."""
    return G.plus_minus_of(rebuilt(spark, sf_dir)).select(F.col("file").alias("game"), "team", F.col("player_id").alias("player"), "plus_minus")


def _n(action: str) -> str:
    return f"CAST(count(*) FILTER (WHERE action = '{action}') AS BIGINT)"


def _tally(name: str, a: str, b: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN action = '{a}' THEN 1 END), 0) AS BIGINT) AS {name}, CAST(coalesce(sum(CASE WHEN action = '{a}' AND list_contains(names, '{b}') THEN 1 END), 0) AS BIGINT) AS {name}_won"


BOX = f"""{GOALS}, {PM}, {ATTEMPTS}, m AS (SELECT *, list(action) OVER (PARTITION BY game, team, player, period, at_ms) AS names FROM gm WHERE (game, team, player) NOT IN (SELECT game, team, player FROM gk)),
c AS (SELECT game, team, player, {', '.join(f'{_n(a)} AS {n}' for n, a in G.COUNTS.items())}, {_n('Penalties')} * 120 AS penalty_s, {', '.join(_tally(n, a, b) for n, (a, b) in G.TALLIES.items())} FROM m GROUP BY ALL),
l AS (SELECT game, team, player, CAST(sum(CASE WHEN action = 'All shifts' THEN e_ms - s_ms ELSE 0 END) AS BIGINT) AS toi_ms, CAST(sum(CASE WHEN action = 'Power play shifts' THEN e_ms - s_ms ELSE 0 END) AS BIGINT) AS pp_ms FROM gs WHERE (game, team, player) NOT IN (SELECT game, team, player FROM gk) GROUP BY ALL),
k AS (SELECT game, team, player FROM c UNION SELECT game, team, player FROM l), ns AS (SELECT game, team, player, count(*) AS shifts FROM sh GROUP BY ALL),
co AS (SELECT sh.game, sh.team, sh.player, count(*) FILTER (WHERE mine) AS corsi_for, count(*) FILTER (WHERE NOT mine) AS corsi_against FROM att JOIN sh ON sh.game = att.game AND sh.team = att.team AND sh.s < att.t AND att.t <= sh.e GROUP BY ALL)
SELECT game, team, player, {', '.join(f'coalesce({n}, 0) AS {n}' for n in [*G.COUNTS, *(x for t in G.TALLIES for x in (t, t + '_won')), 'penalty_s', 'toi_ms', 'pp_ms'])}, CAST(0 AS BIGINT) AS sh_ms,
 {', '.join(f'CAST(coalesce({n}, 0) AS BIGINT) AS {n}' for n in ('shifts', 'corsi_for', 'corsi_against', 'plus_minus'))}
FROM k LEFT JOIN c USING (game, team, player) LEFT JOIN l USING (game, team, player) LEFT JOIN ns USING (game, team, player) LEFT JOIN co USING (game, team, player) LEFT JOIN pm USING (game, team, player)"""


@query(f", {BOX}")
def skater_box(spark, sf_dir):
    """The whole box score of every skater and game."""
    return G.box(rebuilt(spark, sf_dir)).withColumnsRenamed({"file": "game", "player_id": "player"})


GOALIE_SQL = f"""{ADV}, gx AS (SELECT *, max(CASE WHEN action = 'Saves' THEN 1 ELSE 0 END) OVER (PARTITION BY game, team, player, period, at_ms) AS saved FROM gm WHERE player >= {GOALIE}),
gy AS (SELECT *, CASE WHEN action = 'Shots against' THEN {strength_sql('gx.t', 'gx.team', 'gx')} END AS strength FROM gx),
gb AS (SELECT game, team, player, CAST(count(*) FILTER (WHERE action = 'Shots against') AS BIGINT) AS shots_against, CAST(count(*) FILTER (WHERE action = 'Saves') AS BIGINT) AS saves, CAST(count(*) FILTER (WHERE action = 'Goals against') AS BIGINT) AS goals_against,
 CAST(count(*) FILTER (WHERE strength = 'Even') AS BIGINT) AS ev_faced, CAST(count(*) FILTER (WHERE strength = 'Even' AND saved = 1) AS BIGINT) AS ev_saved, CAST(count(*) FILTER (WHERE strength = 'ShortHanded') AS BIGINT) AS sh_faced, CAST(count(*) FILTER (WHERE strength = 'ShortHanded' AND saved = 1) AS BIGINT) AS sh_saved,
 (SELECT CAST(sum(e_ms - s_ms) AS BIGINT) FROM gs WHERE gs.game = gy.game AND gs.team = gy.team AND gs.player = gy.player AND gs.action = 'All shifts') AS toi_ms FROM gy GROUP BY game, team, player)"""


@query(f", {GOALIE_SQL} SELECT * FROM gb")
def goalie_box(spark, sf_dir):
    """Goalkeepers' games with the split by strength."""
    return G.goalie_box(rebuilt(spark, sf_dir)).withColumnsRenamed({"file": "game", "player_id": "player"})


@query(f""", {GOALIE_SQL}, t AS (SELECT player, sum(shots_against) AS sa, sum(saves) AS sv, sum(goals_against) AS ga, sum(toi_ms) / 1000.0 AS toi, sum(ev_faced) AS ef, sum(ev_saved) AS es, sum(sh_faced) AS hf, sum(sh_saved) AS hs, CAST(count(*) AS BIGINT) AS games FROM gb WHERE toi_ms > 0 GROUP BY player),
w AS (SELECT *, sv / sa AS p, 1.959963984540054 AS z FROM t)
SELECT player, games, round(100 * p, 6) AS save_pct, round(100 * greatest((p + z * z / (2 * sa)) / (1 + z * z / sa) - z / (1 + z * z / sa) * sqrt(p * (1 - p) / sa + z * z / (4 * sa * sa)), 0), 6) AS low, round(100 * least((p + z * z / (2 * sa)) / (1 + z * z / sa) + z / (1 + z * z / sa) * sqrt(p * (1 - p) / sa + z * z / (4 * sa * sa)), 1), 6) AS high,
 round(CASE WHEN ef > 0 THEN 100 * es / ef END, 6) AS ev_pct, round(CASE WHEN hf > 0 THEN 100 * hs / hf END, 6) AS sh_pct, round(3600 * ga / toi, 6) AS against_60 FROM w""")
def goalie_report(spark, sf_dir):
    """A season's save percentages with intervals, by strength, and goals against per 60 minutes."""
    b = G.goalie_box(rebuilt(spark, sf_dir)).filter("toi_ms > 0")
    names = ("shots_against", "saves", "goals_against", "toi_ms", "ev_faced", "ev_saved", "sh_faced", "sh_saved")
    t = b.groupBy(F.col("player_id").alias("player")).agg(F.count("*").alias("games"), *[F.sum(c).alias(c) for c in names])
    low, high = A.wilson(F.col("saves"), F.col("shots_against"))
    share = lambda a, n: F.round(A.ratio(F.col(a), F.col(n), 100.0), 6)
    return t.select("player", "games", share("saves", "shots_against").alias("save_pct"), F.round(100 * low, 6).alias("low"), F.round(100 * high, 6).alias("high"), share("ev_saved", "ev_faced").alias("ev_pct"), share("sh_saved", "sh_faced").alias("sh_pct"), F.round(A.ratio(F.col("goals_against"), F.col("toi_ms") / 1000.0, 3600.0), 6).alias("against_60"))


CUTS = f"""len AS (SELECT game, greatest(CASE WHEN max(period) >= 3 THEN 3600 ELSE max(period) * 1200 END, max(e)) AS len FROM gs GROUP BY game),
c0 AS (SELECT game, team, s AS a FROM sh UNION SELECT game, team, e FROM sh UNION SELECT game, side, s FROM adv, sides UNION SELECT game, side, e FROM adv, sides UNION SELECT game, side, len FROM len, sides"""
STINTS = f"""{GOALS}, {CUTS} UNION SELECT game, side, 0.0 FROM len, sides UNION SELECT game, side, i * 1200.0 FROM len, sides, (SELECT unnest(range(1, 21)) AS i) WHERE i * 1200.0 < len),
c1 AS (SELECT *, (a + b) / 2 AS mid FROM (SELECT *, lead(a) OVER (PARTITION BY game, team ORDER BY a) AS b FROM c0) WHERE b - a > 0.05),
stn AS (SELECT c1.*, {strength_sql('c1.mid', 'c1.team', 'c1')} AS strength, coalesce((SELECT array_to_string(list_sort(list(DISTINCT player)), ',') FROM sh WHERE sh.game = c1.game AND sh.team = c1.team AND sh.s <= c1.mid AND c1.mid < sh.e), '') AS players,
 (SELECT count(*) FROM gl WHERE gl.game = c1.game AND gl.team = c1.team AND scored AND c1.a <= gl.t - 0.25 AND gl.t - 0.25 < c1.b) AS gf, (SELECT count(*) FROM gl WHERE gl.game = c1.game AND gl.team = c1.team AND NOT scored AND c1.a <= gl.t - 0.25 AND gl.t - 0.25 < c1.b) AS ga FROM c1)"""


@query(f", {STINTS} SELECT game, team, round(a, 3) AS a, round(b, 3) AS b, strength, players, CAST(gf AS BIGINT) AS goals_for, CAST(ga AS BIGINT) AS goals_against FROM stn")
def full_stints(spark, sf_dir):
    """Stints with strength and goals."""
    joined = F.array_join(F.transform("players", lambda x: x.cast("string")), ",")
    return G.stints(rebuilt(spark, sf_dir)).select(F.col("file").alias("game"), "team", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "strength", joined.alias("players"), "goals_for", "goals_against")


def defenders(rows: DataFrame) -> DataFrame:
    """Two of every five players."""
    return rows.filter("player_id is not null").select("player_id").distinct().filter((F.floor(F.col("player_id") / 2) % 5) < 2)


UNITS = f"""{GOALS}, {ATTEMPTS}, {CUTS}), c1 AS (SELECT *, (a + b) / 2 AS mid FROM (SELECT *, lead(a) OVER (PARTITION BY game, team ORDER BY a) AS b FROM c0) WHERE b - a > 0.05),
u0 AS (SELECT c1.game, c1.team, c1.a, c1.b, c1.mid, list_sort(list(DISTINCT player)) AS p, coalesce(list_sort(list(DISTINCT player) FILTER (WHERE player // 2 % 5 < 2)), []) AS d, coalesce(list_sort(list(DISTINCT player) FILTER (WHERE player // 2 % 5 >= 2)), []) AS f FROM c1 JOIN sh ON sh.game = c1.game AND sh.team = c1.team AND sh.s < c1.mid AND c1.mid <= sh.e GROUP BY ALL),
u1 AS (SELECT *, {strength_sql('u0.mid', 'u0.team', 'u0')} AS strength, (SELECT count(*) FROM gl WHERE gl.game = u0.game AND gl.team = u0.team AND scored AND u0.a < gl.t - 0.25 AND gl.t - 0.25 <= u0.b) AS gf, (SELECT count(*) FROM gl WHERE gl.game = u0.game AND gl.team = u0.team AND NOT scored AND u0.a < gl.t - 0.25 AND gl.t - 0.25 <= u0.b) AS ga,
 (SELECT count(*) FROM att WHERE att.game = u0.game AND att.team = u0.team AND mine AND u0.a < att.t AND att.t <= u0.b) AS cf, (SELECT count(*) FROM att WHERE att.game = u0.game AND att.team = u0.team AND NOT mine AND u0.a < att.t AND att.t <= u0.b) AS ca FROM u0),
u2 AS (SELECT *, 'FullUnit' AS kind, p AS m FROM u1 WHERE strength = 'Even' AND len(d) = 2 AND len(f) = 3 UNION ALL SELECT *, 'DefencePair', d FROM u1 WHERE strength = 'Even' AND len(d) = 2 UNION ALL SELECT *, 'ForwardLine', f FROM u1 WHERE strength = 'Even' AND len(f) = 3
 UNION ALL SELECT *, CASE WHEN strength = 'PowerPlay' THEN 'PowerPlay' ELSE 'PenaltyKill' END, p FROM u1 WHERE strength <> 'Even'),
un AS (SELECT game, team, kind, array_to_string(m, ',') AS members, sum(b - a) AS seconds, sum(gf) AS goals_for, sum(ga) AS goals_against, sum(cf) AS corsi_for, sum(ca) AS corsi_against FROM u2 GROUP BY ALL)"""
SUMS = ("goals_for", "goals_against", "corsi_for", "corsi_against")


@query(f", {UNITS} SELECT game, team, kind, members, round(seconds, 3) AS seconds, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in SUMS)} FROM un")
def game_units(spark, sf_dir):
    """Pairs, lines, full and special units of each game with their goals and attempts."""
    rows = rebuilt(spark, sf_dir)
    joined = F.array_join(F.transform("members", lambda x: x.cast("string")), ",")
    return G.units(rows, defenders(rows)).select(F.col("file").alias("game"), "team", "kind", joined.alias("members"), F.round("seconds", 3).alias("seconds"), *SUMS)


@query(f""", {UNITS}, s AS (SELECT team, kind, members, sum(seconds) AS seconds, CAST(count(DISTINCT game) AS BIGINT) AS games, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in SUMS)} FROM un GROUP BY ALL)
SELECT team, kind, members, games, round(seconds, 3) AS seconds, {', '.join(SUMS)}, round(CASE WHEN corsi_for + corsi_against > 0 THEN 100.0 * corsi_for / (corsi_for + corsi_against) END, 6) AS share, seconds < 600 AS small_sample FROM s""")
def unit_seasons(spark, sf_dir):
    """Units over all games; under ten minutes the sample is called small."""
    rows = rebuilt(spark, sf_dir)
    u = G.units(rows, defenders(rows)).groupBy("team", "kind", "members").agg(F.sum("seconds").alias("seconds"), F.countDistinct("file").alias("games"), *[F.sum(c).alias(c) for c in SUMS])
    share = A.ratio(F.col("corsi_for"), F.col("corsi_for") + F.col("corsi_against"), 100.0)
    return u.select("team", "kind", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "games", F.round("seconds", 3).alias("seconds"), *SUMS, F.round(share, 6).alias("share"), (F.col("seconds") < 600).alias("small_sample"))


@query(f""", {UNITS}, pr AS (SELECT DISTINCT x.team, x.p AS a, y.p AS b FROM (SELECT team, unnest(m) AS p, array_to_string(m, ',') AS mm, kind FROM u2 WHERE kind IN ('DefencePair', 'ForwardLine')) x JOIN (SELECT team, unnest(m) AS p, array_to_string(m, ',') AS mm, kind FROM u2 WHERE kind IN ('DefencePair', 'ForwardLine')) y ON x.team = y.team AND x.mm = y.mm AND x.p < y.p)
SELECT pr.team, a, b, round(sum(seconds), 3) AS seconds, CAST(sum(corsi_for) AS BIGINT) AS corsi_for, CAST(sum(corsi_against) AS BIGINT) AS corsi_against FROM pr JOIN un ON un.team = pr.team AND kind IN ('DefencePair', 'ForwardLine') AND list_contains(string_split(members, ','), CAST(a AS VARCHAR)) AND list_contains(string_split(members, ','), CAST(b AS VARCHAR)) GROUP BY pr.team, a, b""")
def pair_in_units(spark, sf_dir):
    """Attempts of two players in all pairs and lines that hold both: each unit gives its own pairs, no pair meets all units."""
    rows = rebuilt(spark, sf_dir)
    u = G.units(rows, defenders(rows)).filter("kind in ('DefencePair', 'ForwardLine')")
    pairs = F.flatten(F.transform("members", lambda a: F.transform(F.filter("members", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return u.select("team", F.explode(pairs).alias("p"), "seconds", "corsi_for", "corsi_against").groupBy("team", "p.a", "p.b").agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("corsi_for").alias("corsi_for"), F.sum("corsi_against").alias("corsi_against"))


def _where(name: str, condition: str) -> str:
    parts = (("shots", "true"), ("on_goal", "on_goal"), ("goals", "goal"))
    return ", ".join(f"CAST(count(*) FILTER (WHERE {condition} AND {c}) AS BIGINT) AS {k}_{name}" for k, c in parts)


SUMMARY = f"""{GOALS}, mm AS (SELECT *, bool_or(action = 'Shots on goal') OVER w AS on_goal, bool_or(action = 'Goals') OVER w AS goal, bool_or(action = 'Faceoffs won') OVER w AS won FROM gm WINDOW w AS (PARTITION BY game, team, period, at_ms)),
sx AS (SELECT *, {strength_sql('mm.t', 'mm.team', 'mm')} AS strength FROM mm WHERE action = 'Shots'),
t1 AS (SELECT game, team, CAST(count(*) AS BIGINT) AS shots, {', '.join(_where(n, c) for n, c in (('p1', 'period = 1'), ('p2', 'period = 2'), ('p3', 'period = 3'), ('even', "strength = 'Even'"), ('pp', "strength = 'PowerPlay'")))} FROM sx GROUP BY ALL),
t2 AS (SELECT game, team, {', '.join(f"CAST(count(*) FILTER (WHERE action = 'Faceoffs in {z}' AND won) AS BIGINT) AS faceoffs_won_{z.lower()}" for z in ('DZ', 'NZ', 'OZ'))}, {', '.join(f'{_n(a)} AS {n}' for n, a in (('hits', 'Hits'), ('penalties', 'Penalties'), ('battles_won', 'Puck battles won'), ('entries_pass', 'Entries via pass'), ('entries_carry', 'Entries via stickhandling'), ('losses', 'Puck losses'), ('recoveries', 'Puck recoveries'), ('recoveries_oz', 'Puck recoveries in OZ')))} FROM mm GROUP BY ALL),
t3 AS (SELECT game, team, CAST(count(*) AS BIGINT) AS power_plays, sum(e - s) AS pp_seconds FROM adv GROUP BY ALL), t4 AS (SELECT game, team, CAST(count(*) FILTER (WHERE strength = 'PowerPlay') AS BIGINT) AS pp_goals_scored FROM gl WHERE scored GROUP BY ALL)"""
SUMMARY_COLUMNS = ["shots", *(f"{k}_{n}" for n in ("p1", "p2", "p3", "even", "pp") for k in ("shots", "on_goal", "goals")), "faceoffs_won_dz", "faceoffs_won_nz", "faceoffs_won_oz", "hits", "penalties", "battles_won", "entries_pass", "entries_carry", "losses", "recoveries", "recoveries_oz", "power_plays", "pp_goals_scored"]


@query(f", {SUMMARY} SELECT game, team, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SUMMARY_COLUMNS)}, round(coalesce(pp_seconds, 0), 3) AS pp_seconds FROM t2 LEFT JOIN t1 USING (game, team) LEFT JOIN t3 USING (game, team) LEFT JOIN t4 USING (game, team)")
def team_summaries(spark, sf_dir):
    """Each side's game: triples by period and strength, faceoffs by zone, power plays, play counts."""
    return G.team_summary(rebuilt(spark, sf_dir)).select(F.col("file").alias("game"), "team", *SUMMARY_COLUMNS, F.round("pp_seconds", 3).alias("pp_seconds"))


@query(f", {GOALS} SELECT team, s AS strength, CAST(count(*) FILTER (WHERE scored AND strength = s) AS BIGINT) AS goals_for, CAST(count(*) FILTER (WHERE NOT scored AND CASE strength WHEN 'PowerPlay' THEN 'ShortHanded' WHEN 'ShortHanded' THEN 'PowerPlay' ELSE 'Even' END = s) AS BIGINT) AS goals_against FROM gl, (SELECT unnest(['Even', 'PowerPlay', 'ShortHanded']) AS s) GROUP BY ALL")
def strength_goals(spark, sf_dir):
    """Goals by the strength of the side that scored them."""
    g = G.goals(rebuilt(spark, sf_dir))
    turned = F.when(F.col("scored"), F.col("strength")).otherwise(opposite(F.col("strength")))
    kinds = F.explode(F.array(F.lit("Even"), F.lit("PowerPlay"), F.lit("ShortHanded")))
    n = g.groupBy("team", turned.alias("strength")).agg(F.count_if("scored").alias("goals_for"), F.count_if(~F.col("scored")).alias("goals_against"))
    return g.select("team").distinct().select("team", kinds.alias("strength")).join(n, ["team", "strength"], "left").na.fill(0)


def opposite(strength):
    """A strength as the other side sees it."""
    return F.when(strength == "PowerPlay", "ShortHanded").when(strength == "ShortHanded", "PowerPlay").otherwise("Even")


@query(f""", {SUMMARY}, z AS (SELECT game, team, unnest([0, 1, 2]) AS zone, unnest([faceoffs_won_dz, faceoffs_won_nz, faceoffs_won_oz]) AS won FROM t2)
SELECT a.team, a.zone, CAST(sum(a.won) AS BIGINT) AS won, CAST(sum(b.won) AS BIGINT) AS lost, round(CASE WHEN sum(a.won) + sum(b.won) > 0 THEN 100.0 * sum(a.won) / (sum(a.won) + sum(b.won)) END, 6) AS share FROM z a JOIN z b ON a.game = b.game AND b.team = 1 - a.team AND b.zone = 2 - a.zone GROUP BY ALL""")
def zone_faceoffs(spark, sf_dir):
    """Faceoffs won and lost by zone: those lost in one's own zone are those that the other side won in its attacking zone."""
    t = G.team_summary(rebuilt(spark, sf_dir))
    z = t.select("file", "team", F.posexplode(F.array(*[f"faceoffs_won_{z}" for z in ("dz", "nz", "oz")])).alias("zone", "won"))
    o = z.select("file", (1 - F.col("team")).alias("team"), (2 - F.col("zone")).alias("zone"), F.col("won").alias("lost"))
    s = z.join(o, ["file", "team", "zone"]).groupBy("team", "zone").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    return s.withColumn("share", F.round(A.ratio(F.col("won"), F.col("won") + F.col("lost"), 100.0), 6))


@query(f""", {SUMMARY}, q AS (SELECT game, team, unnest([1, 2, 3]) AS period, unnest([shots_p1, shots_p2, shots_p3]) AS shots, unnest([on_goal_p1, on_goal_p2, on_goal_p3]) AS on_goal FROM t1),
gp AS (SELECT team, period, count(*) FILTER (WHERE scored) AS gf, count(*) FILTER (WHERE NOT scored) AS ga FROM gl GROUP BY ALL), qs AS (SELECT team, period, sum(shots) AS shots, sum(on_goal) AS on_goal FROM q GROUP BY ALL)
SELECT a.team, CAST(a.period AS INTEGER) AS period, CAST(a.shots AS BIGINT) AS attempts_for, CAST(b.shots AS BIGINT) AS attempts_against, CAST(a.on_goal AS BIGINT) AS on_goal_for, CAST(b.on_goal AS BIGINT) AS on_goal_against, CAST(coalesce(gf, 0) AS BIGINT) AS goals_for, CAST(coalesce(ga, 0) AS BIGINT) AS goals_against FROM qs a JOIN qs b ON b.team = 1 - a.team AND a.period = b.period LEFT JOIN gp ON gp.team = a.team AND gp.period = a.period""")
def period_splits(spark, sf_dir):
    """Attempts, shots on goal and goals of both sides by period."""
    rows = rebuilt(spark, sf_dir)
    t = G.team_summary(rows)
    q = t.select("team", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"shots_p{p}").alias("shots"), F.col(f"on_goal_p{p}").alias("on_goal")) for p in (1, 2, 3)])).alias("q"))
    q = q.groupBy("team", "q.period").agg(F.sum("q.shots").alias("attempts_for"), F.sum("q.on_goal").alias("on_goal_for"))
    o = q.select((1 - F.col("team")).alias("team"), "period", F.col("attempts_for").alias("attempts_against"), F.col("on_goal_for").alias("on_goal_against"))
    g = G.goals(rows).groupBy("team", "period").agg(F.count_if("scored").alias("goals_for"), F.count_if(~F.col("scored")).alias("goals_against"))
    return q.join(o, ["team", "period"]).join(g, ["team", "period"], "left").na.fill(0).select("team", "period", "attempts_for", "attempts_against", "on_goal_for", "on_goal_against", "goals_for", "goals_against")


LEAD = "lead0 AS (SELECT stn.game, stn.team, stn.a, stn.b, stn.strength, stn.players, coalesce((SELECT arg_max(score_for - score_against, (gl.t, gl.row_no)) FROM gl WHERE gl.game = stn.game AND gl.team = stn.team AND gl.t <= stn.a), 0) AS lead FROM stn)"
SITUATIONS = {"leading": "lead > 0", "tied": "lead = 0", "trailing": "lead < 0", "late_close": "a >= 3300 and a < 3600 and abs(lead) <= 1", "power_play": "strength = 'PowerPlay'", "short_handed": "strength = 'ShortHanded'"}


def led(rows: DataFrame) -> DataFrame:
    """Stints with ``lead``: a side's goals less the other's at the stint's start, by an as-of join."""
    g = G.goals(rows).select("file", "team", F.col("clock_s").alias("at"), F.struct("row_no", (F.col("score_for") - F.col("score_against")).alias("lead")).alias("s"))
    st = G.stints(rows).withColumn("at", F.col("a"))
    return J.asof_backward(st, g, ["file", "team"], "at", ["s"]).withColumn("lead", F.coalesce("s.lead", F.lit(0))).drop("s")


@query(f", {STINTS}, {LEAD} SELECT team, {', '.join(f'round(coalesce(sum(CASE WHEN {c} THEN b - a END), 0), 3) AS {n}' for n, c in SITUATIONS.items())} FROM lead0 GROUP BY team")
def team_situations(spark, sf_dir):
    """Seconds of each side by lead, late and close, and strength."""
    return led(rebuilt(spark, sf_dir)).groupBy("team").agg(*[F.round(F.coalesce(F.sum(F.when(F.expr(c), F.col("b") - F.col("a"))), F.lit(0.0)), 3).alias(n) for n, c in SITUATIONS.items()])


@query(f", {STINTS}, {LEAD}, e AS (SELECT *, unnest(string_split(players, ',')) AS p FROM lead0 WHERE players <> '') SELECT team, CAST(p AS BIGINT) AS player, {', '.join(f'round(coalesce(sum(CASE WHEN {c} THEN b - a END), 0), 3) AS {n}' for n, c in SITUATIONS.items())} FROM e GROUP BY team, p")
def player_situations(spark, sf_dir):
    """The same seconds for each skater."""
    e = led(rebuilt(spark, sf_dir)).select("team", "a", "b", "strength", "lead", F.explode("players").alias("player"))
    return e.groupBy("team", "player").agg(*[F.round(F.coalesce(F.sum(F.when(F.expr(c), F.col("b") - F.col("a"))), F.lit(0.0)), 3).alias(n) for n, c in SITUATIONS.items()])


@query(f""", {STINTS}, x AS (SELECT stn.game, stn.team, stn.a, avg(greatest(stn.a - sh.s, 0)) AS age FROM stn JOIN sh ON sh.game = stn.game AND sh.team = stn.team AND sh.s <= stn.mid AND stn.mid < sh.e GROUP BY ALL)
SELECT team, least(CAST(floor(age / 15) AS INTEGER), 4) AS bin, CAST(count(*) AS BIGINT) AS stints, round(avg(age), 5) AS mean_age FROM x GROUP BY ALL""")
def shift_age_at_stint(spark, sf_dir):
    """How long the skaters of a stint have been on when it starts, by bins of a quarter minute."""
    rows = rebuilt(spark, sf_dir)
    st = G.stints(rows).select("file", "team", "a", ((F.col("a") + F.col("b")) / 2).alias("mid"))
    on = I.point_in_interval(st, G.shifts(rows, True).select("file", "team", "start_s", "end_s"), ["file", "team"], "mid", "start_s", "end_s", width=60)
    x = on.groupBy("file", "team", "a").agg(F.avg(F.greatest(F.col("a") - F.col("start_s"), F.lit(0.0))).alias("age"))
    return x.groupBy("team", F.least(F.floor(F.col("age") / 15).cast("int"), F.lit(4)).alias("bin")).agg(F.count("*").alias("stints"), F.round(F.avg("age"), 5).alias("mean_age"))


@query(f""", {GOALS}, ends AS (SELECT game, side AS team, p * 1200 AS at, p AS period FROM (SELECT DISTINCT game FROM gm), sides, (SELECT unnest([1, 2, 3]) AS p))
SELECT game, team, CAST(period AS INTEGER) AS period, CAST(coalesce((SELECT arg_max(score_for - score_against, (t, row_no)) FROM gl WHERE gl.game = ends.game AND gl.team = ends.team AND t <= ends.at), 0) AS BIGINT) AS lead FROM ends""")
def lead_at_breaks(spark, sf_dir):
    """The lead at each period's end, from the last goal before it."""
    rows = rebuilt(spark, sf_dir)
    ends = rows.select("file", "team").distinct().select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("period")).withColumn("at", (F.col("period") * 1200).cast("double"))
    g = G.goals(rows).select("file", "team", F.col("clock_s").alias("at"), F.struct("row_no", (F.col("score_for") - F.col("score_against")).alias("lead")).alias("s"))
    return J.asof_backward(ends, g, ["file", "team"], "at", ["s"]).select(F.col("file").alias("game"), "team", "period", F.coalesce("s.lead", F.lit(0).cast("long")).alias("lead"))


@query(""", o AS (SELECT game, period, team, player, at_ms, action, row_no FROM gm WHERE action IN ('Puck battles won', 'Puck battles lost')),
f AS (SELECT a.game, a.team, a.player, b.player AS opponent, a.action = 'Puck battles won' AS won, a.row_no FROM o a JOIN o b ON a.game = b.game AND a.period = b.period AND a.at_ms = b.at_ms AND b.team = 1 - a.team AND a.action <> b.action QUALIFY row_number() OVER (PARTITION BY a.game, a.row_no ORDER BY b.row_no) = 1)
SELECT game, team, player, opponent, CAST(count(*) FILTER (WHERE won) AS BIGINT) AS won, CAST(count(*) FILTER (WHERE NOT won) AS BIGINT) AS lost, CAST(row_number() OVER (PARTITION BY game, team ORDER BY count(*) DESC, min(row_no)) AS INTEGER) AS place FROM f GROUP BY game, team, player, opponent""")
def game_matchups(spark, sf_dir):
    """Head-to-head battles of a game, the busiest pairs first and ties by first appearance."""
    m = rebuilt(spark, sf_dir).filter(F.col("action").isin("Puck battles won", "Puck battles lost")).select("file", "period", "team", "player_id", "at_ms", "action", "row_no")
    o = m.select("file", "period", "at_ms", (1 - F.col("team")).alias("team"), F.col("player_id").alias("opponent"), F.col("action").alias("theirs"), F.col("row_no").alias("other"))
    f = J.first_match(m.join(o, ["file", "period", "at_ms", "team"]).filter("action <> theirs"), ["file", "row_no"], ["other"])
    won = F.col("action") == "Puck battles won"
    c = f.groupBy("file", "team", "player_id", "opponent").agg(F.count_if(won).alias("won"), F.count_if(~won).alias("lost"), F.min("row_no").alias("first"))
    order = Window.partitionBy("file", "team").orderBy(F.desc(F.col("won") + F.col("lost")), "first")
    return c.select(F.col("file").alias("game"), "team", F.col("player_id").alias("player"), "opponent", "won", "lost", F.row_number().over(order).alias("place"))




@query(f""", {ADV}, d AS (SELECT *, CAST((place % 178) - 89 AS DOUBLE) AS along, CAST((place * 7 % 85) - 42 AS DOUBLE) AS across, bool_or(action = 'Shots on goal') OVER w AS on_goal, bool_or(action = 'Goals') OVER w AS goal FROM gm WINDOW w AS (PARTITION BY game, team, period, at_ms, player))
SELECT game, team, player, row_no, along, across, CASE WHEN goal THEN 'Goal' WHEN on_goal THEN 'OnGoal' ELSE 'Attempt' END AS result, {strength_sql('d.t', 'd.team', 'd')} AS strength, round(greatest(sqrt((89 - along) ** 2 + across ** 2), 3), 6) AS distance, round(atan2(abs(across), 89 - along), 6) AS angle FROM d WHERE action = 'Shots' AND place IS NOT NULL""")
def shot_dots(spark, sf_dir):
    """Every shot with its place, result, strength, distance and angle."""
    rows = rebuilt(spark, sf_dir)
    w = Window.partitionBy("file", "team", "period", "at_ms", "player_id")
    d = rows.filter("kind = 'moment'").withColumn("on_goal", F.max(F.col("action") == "Shots on goal").over(w)).withColumn("goal", F.max(F.col("action") == "Goals").over(w)).filter("action = 'Shots' and place is not null")
    d = d.select("file", "team", "player_id", "row_no", "clock_s", "on_goal", "goal", ((F.col("place") % 178) - 89).cast("double").alias("along"), ((F.col("place") * 7 % 85) - 42).cast("double").alias("across"))
    s = G.with_strength(d, G.advantages(rows), "clock_s")
    along, across = F.col("along"), F.col("across")
    return s.select(F.col("file").alias("game"), "team", F.col("player_id").alias("player"), "row_no", "along", "across", F.when(F.col("goal"), "Goal").when(F.col("on_goal"), "OnGoal").otherwise("Attempt").alias("result"), "strength", F.round(rink.distance(along, across), 6).alias("distance"), F.round(rink.angle(along, across), 6).alias("angle"))


@query(f""", {GOALS} SELECT game, team, 'shift' AS what, player AS who, round(s, 3) AS from_s, round(e, 3) AS to_s FROM sh UNION ALL SELECT game, team, 'advantage', NULL, round(s, 3), round(e, 3) FROM adv UNION ALL SELECT game, team, 'goal', player, round(t, 3), round(t, 3) FROM gl WHERE scored""")
def timelines(spark, sf_dir):
    """What a shift chart shows: shifts, man advantages and goals of every game in one table."""
    rows = rebuilt(spark, sf_dir)
    at = lambda a, b: [F.round(a, 3).alias("from_s"), F.round(b, 3).alias("to_s")]
    s = G.shifts(rows, True).select(F.col("file").alias("game"), "team", F.lit("shift").alias("what"), F.col("player_id").alias("who"), *at("start_s", "end_s"))
    v = G.advantages(rows).select(F.col("file").alias("game"), F.col("by").alias("team"), F.lit("advantage").alias("what"), F.lit(None).cast("long").alias("who"), *at("start_s", "end_s"))
    g = G.goals(rows).filter("scored").select(F.col("file").alias("game"), "team", F.lit("goal").alias("what"), F.col("player_id").alias("who"), *at("clock_s", "clock_s"))
    return s.unionByName(v).unionByName(g)


@query(f""", l AS (SELECT game, min(t) AS first_s, max(t) AS last_s, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE action = 'Goals' AND team = 0) AS BIGINT) AS goals_for, CAST(count(*) FILTER (WHERE action = 'Goals' AND team = 1) AS BIGINT) AS goals_against FROM gm GROUP BY game)
SELECT game, round(first_s, 3) AS first_s, round(last_s, 3) AS last_s, rows, goals_for, goals_against, CASE WHEN goals_for > goals_against THEN 'Win' WHEN goals_for = goals_against THEN 'Tie' WHEN game % 3 = 0 THEN 'OvertimeLoss' ELSE 'Loss' END AS outcome, CAST(CASE WHEN goals_for > goals_against THEN 2 WHEN goals_for = goals_against OR game % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS points FROM l""")
def game_listing(spark, sf_dir):
    """All games with score, result and points; every third is taken to have gone into overtime."""
    goal = F.col("action") == "Goals"
    l = rebuilt(spark, sf_dir).filter("kind = 'moment'").groupBy(F.col("file").alias("game")).agg(F.min("clock_s").alias("first_s"), F.max("clock_s").alias("last_s"), F.count("*").alias("rows"), F.count_if(goal & (F.col("team") == 0)).alias("goals_for"), F.count_if(goal & (F.col("team") == 1)).alias("goals_against"))
    o = outcome(F.col("goals_for"), F.col("goals_against"), F.when(F.col("game") % 3 == 0, 3900).otherwise(3600))
    return l.select("game", F.round("first_s", 3).alias("first_s"), F.round("last_s", 3).alias("last_s"), "rows", "goals_for", "goals_against", o.alias("outcome"), points(o).alias("points"))


def outcome(goals_for, goals_against, length_s):
    """Win, Tie, Loss, or OvertimeLoss when a lost game went past three periods."""
    return F.when(goals_for > goals_against, "Win").when(goals_for == goals_against, "Tie").when(length_s > 3601, "OvertimeLoss").otherwise("Loss")


def points(result):
    """Two for a win, one for a tie or a loss in overtime."""
    return F.when(result == "Win", 2).when(result.isin("Tie", "OvertimeLoss"), 1).otherwise(0)
