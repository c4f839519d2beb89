"""Clock, shifts, stints and moments: queries on the action stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.operators import aggregates as A
from stintlake.operators import intervals as I
from stintlake.operators import joins as J
from stintlake.operators import ordered as O
from stintlake.plans.adapter import HOUR, SQL, actions, shifts, union_sql

MINUTE = 60_000_000
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL (CTEs of the adapter come before it)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}"
        return f

    return add


@query(f""", {union_sql('u', 'shift', 'player')},
t AS (SELECT player, CAST(count(*) AS BIGINT) AS stretches, CAST(sum(end_us - start_us) // 1000000 AS BIGINT) AS active_sec FROM u GROUP BY player),
n AS (SELECT player, CAST(count(*) AS BIGINT) AS n FROM act GROUP BY player)
SELECT player, stretches, active_sec, n, round(CASE WHEN active_sec > 0 THEN 3600.0 * n / active_sec END, 6) AS per_60,
       rank() OVER (ORDER BY active_sec) + (count(*) OVER (PARTITION BY active_sec) - 1) / 2 AS mid
FROM t JOIN n USING (player)""")
def active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's active time, stretches, actions per 60 minutes and the midrank of the time."""
    s = shifts(spark, sf_dir)
    t = I.interval_union(s, ["player"]).groupBy("player").agg(F.count("*").alias("stretches"), F.expr("sum(end_us - start_us) div 1000000").alias("active_sec"))
    n = s.groupBy("player").agg(F.count("*").alias("n"))
    out = t.join(n, "player").withColumn("per_60", F.round(A.ratio(F.col("n"), F.col("active_sec"), 3600.0), 6))
    return O.with_midranks(out, {"active_sec": "mid"})


@query(f", {union_sql('u', 'shift', 'team, game')} SELECT team, game, start_us, end_us, CAST(parts AS BIGINT) AS parts FROM u")
def interval_union(spark, sf_dir):
    """Shifts of a team and day merged."""
    return I.interval_union(shifts(spark, sf_dir), ["team", "game"])


@query(f", {union_sql('u', 'shift', 'player', 30 * MINUTE)} SELECT player, start_us, end_us, CAST(parts AS BIGINT) AS parts FROM u")
def interval_union_gap(spark, sf_dir):
    """A player's shifts merged when less than half an hour apart."""
    return I.interval_union(shifts(spark, sf_dir), ["player"], gap=30 * MINUTE)


@query(f""", {union_sql('u', 'shift', 'team, game')}, b AS (SELECT *, unnest(range(start_us // {HOUR}, (end_us - 1) // {HOUR} + 1)) AS bucket FROM u)
SELECT team, game, bucket - game * 24 AS block, CAST(sum(least(end_us, (bucket + 1) * {HOUR}) - greatest(start_us, bucket * {HOUR})) AS BIGINT) AS us
FROM b WHERE end_us > start_us GROUP BY team, game, bucket""")
def interval_overlap_seconds(spark, sf_dir):
    """How long each team is active in each hour from a day's beginning on."""
    u = I.in_buckets(I.interval_union(shifts(spark, sf_dir), ["team", "game"]), "start_us", "end_us", HOUR)
    u = u.withColumn("block", F.col("_bucket") - F.col("game") * 24)
    length = I.overlap(F.col("start_us"), F.col("end_us"), F.col("_bucket") * HOUR, (F.col("_bucket") + 1) * HOUR)
    return u.withColumn("us", length).filter("us > 0").groupBy("team", "game", "block").agg(F.sum("us").alias("us"))


CLOCK = f""", {union_sql('u', 'shift', 'game, period')},
c AS (SELECT game, period, CAST(sum(end_us - start_us) AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS stretches FROM u GROUP BY game, period)"""


@query(CLOCK + f""" SELECT game, period, run, stretches,
  round(CASE WHEN period <= 3 AND abs(run - 8 * {HOUR}) <= 2 * {HOUR} THEN 8.0 * {HOUR} / run ELSE 1.0 END, 9) AS scale, abs(run - 8 * {HOUR}) > {HOUR} AS irregular FROM c""")
def clock_scale(spark, sf_dir):
    """Running time of each period, the factor that makes it a whole period if it is near one, and a flag."""
    c = I.interval_union(shifts(spark, sf_dir), ["game", "period"]).groupBy("game", "period").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("run"), F.count("*").alias("stretches"))
    away = F.abs(F.col("run") - 8 * HOUR)
    return c.withColumn("scale", F.round(F.when((F.col("period") <= 3) & (away <= 2 * HOUR), 8.0 * HOUR / F.col("run")).otherwise(1.0), 9)).withColumn("irregular", away > HOUR)


@query(f""", {union_sql('u', 'shift', 'game, period')}, p AS (SELECT event_id, game, period, at_us FROM act WHERE action = 'error')
SELECT p.event_id, p.game, p.period, CAST(coalesce(sum(greatest(least(p.at_us, end_us) - start_us, 0)), 0) AS BIGINT) AS clock
FROM p LEFT JOIN u ON u.game = p.game AND u.period = p.period GROUP BY ALL""")
def clock_transform(spark, sf_dir):
    """The running clock at each error: the active time of its period before it."""
    s = shifts(spark, sf_dir)
    p = s.filter("action = 'error'").select("event_id", "game", "period", "at_us")
    return I.run_clock(p, I.interval_union(s, ["game", "period"]), ["game", "period"]).select("event_id", "game", "period", "clock")


STINT = f"""ps AS (SELECT * FROM shift WHERE action = 'purchase'),
cut AS (SELECT DISTINCT team, game, unnest([start_us, end_us]) AS start_us FROM ps),
st AS (SELECT * FROM (SELECT *, lead(start_us) OVER (PARTITION BY team, game ORDER BY start_us) AS end_us FROM cut) WHERE end_us - start_us >= 1000000)"""


def stints(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stints of each team and day over the shifts of purchases, and those shifts."""
    ps = shifts(spark, sf_dir).filter("action = 'purchase'")
    return I.boundary_split(ps, ["team", "game"], shortest=1_000_000), ps


@query(f", {STINT} SELECT team, game, start_us, end_us FROM st")
def stint_split(spark, sf_dir):
    """Spans in which a team's set of active players doesn't change."""
    return stints(spark, sf_dir)[0]


def stint_sets(spark, sf_dir) -> DataFrame:
    st, ps = stints(spark, sf_dir)
    st = st.withColumn("mid_us", F.expr("(start_us + end_us) div 2"))
    on = I.point_in_interval(st.withColumnsRenamed({"start_us": "from_us", "end_us": "to_us"}), ps.select("team", "game", "player", "start_us", "end_us"), ["team", "game"], "mid_us", how="left")
    return on.groupBy("team", "game", "from_us", "to_us").agg(F.array_join(F.transform(F.array_sort(F.collect_set("player")), lambda x: x.cast("string")), ",").alias("members"), F.countDistinct("player").alias("on_ice"))


SETS = f"""{STINT}, sm AS (
  SELECT st.team, st.game, st.start_us AS from_us, st.end_us AS to_us, coalesce(array_to_string(list_sort(list(DISTINCT player) FILTER (WHERE player IS NOT NULL)), ','), '') AS members, CAST(count(DISTINCT player) AS BIGINT) AS on_ice
  FROM st LEFT JOIN ps ON ps.team = st.team AND ps.game = st.game AND (st.start_us + st.end_us) // 2 >= ps.start_us AND (st.start_us + st.end_us) // 2 < ps.end_us GROUP BY ALL)"""


@query(f", {SETS} SELECT * FROM sm")
def stint_members(spark, sf_dir):
    """The players active in each stint."""
    return stint_sets(spark, sf_dir)


@query(f", {SETS} SELECT team, members, CAST(count(*) AS BIGINT) AS stints, CAST(count(DISTINCT game) AS BIGINT) AS games, CAST(sum(to_us - from_us) AS BIGINT) AS us FROM sm WHERE on_ice BETWEEN 1 AND 3 GROUP BY team, members")
def unit_rollup(spark, sf_dir):
    """Time of each set of one to three players that were active together."""
    return stint_sets(spark, sf_dir).filter("on_ice between 1 and 3").groupBy("team", "members").agg(F.count("*").alias("stints"), F.countDistinct("game").alias("games"), F.sum(F.col("to_us") - F.col("from_us")).alias("us"))


@query(""", p AS (SELECT event_id, team, game, at_us FROM act WHERE action = 'error'), q AS (SELECT * FROM shift WHERE action = 'purchase')
SELECT p.event_id, CAST(count(q.event_id) AS BIGINT) AS active, min(q.start_us) AS first_start FROM p LEFT JOIN q ON q.team = p.team AND q.game = p.game AND p.at_us >= q.start_us AND p.at_us < q.end_us GROUP BY p.event_id""")
def point_in_interval(spark, sf_dir):
    """How many purchase shifts of its team hold each error, and the first start of them."""
    s = shifts(spark, sf_dir)
    p, q = s.filter("action = 'error'").select("event_id", "team", "game", "at_us"), s.filter("action = 'purchase'").select("team", "game", "start_us", "end_us")
    return I.point_in_interval(p, q, ["team", "game"], how="left").groupBy("event_id").agg(F.count("start_us").alias("active"), F.min("start_us").alias("first_start"))


@query(""", p AS (SELECT event_id, team, game, at_us FROM act WHERE action = 'signup'), q AS (SELECT * FROM shift WHERE action = 'purchase')
SELECT p.event_id, array_to_string(list_sort(list(DISTINCT q.player)), ',') AS on_ice FROM p JOIN q ON q.team = p.team AND q.game = p.game AND p.at_us > q.start_us AND p.at_us <= q.end_us GROUP BY p.event_id""")
def on_ice_sets(spark, sf_dir):
    """The players whose purchase shifts hold each sign-up (start excluded, end included)."""
    s = shifts(spark, sf_dir)
    p, q = s.filter("action = 'signup'").select("event_id", "team", "game", "at_us"), s.filter("action = 'purchase'").select("team", "game", "player", "start_us", "end_us")
    j = I.point_in_interval(p, q, ["team", "game"], closed="right")
    return j.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("player")), lambda x: x.cast("string")), ",").alias("on_ice"))


RECEIVE = f"""ps AS (SELECT event_id, player, team, at_us FROM act WHERE action IN ('click', 'view')),
rc AS (
  SELECT p.event_id, p.player, p.team, r.player AS receiver, r.at_us - p.at_us AS wait_us
  FROM ps p JOIN ps r ON r.team = p.team AND r.at_us > p.at_us AND r.at_us - p.at_us <= {10 * MINUTE} AND r.player <> p.player
  QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY r.at_us, r.event_id) = 1)"""


def receivers(spark, sf_dir) -> DataFrame:
    ps = actions(spark, sf_dir).filter("action in ('click', 'view')").select("event_id", "player", "team", "at_us")
    found = J.next_of_another(ps, ["team"], "player", "at_us", "event_id", 10 * MINUTE, []).filter("next is not null")
    found = J.first_match(found, ["event_id"], ["next.at_us", "next.event_id"])
    return found.select("event_id", "player", "team", F.col("next.player").alias("receiver"), (F.col("next.at_us") - F.col("at_us")).alias("wait_us"))


@query(f", {RECEIVE} SELECT * FROM rc")
def pass_receivers(spark, sf_dir):
    """Who of the team acts next, within ten minutes of each click or view."""
    return receivers(spark, sf_dir)


@query(f", {RECEIVE} SELECT team, player, receiver, CAST(count(*) AS BIGINT) AS passes FROM rc GROUP BY ALL")
def pass_matrix(spark, sf_dir):
    """How often each player is followed by each other."""
    return receivers(spark, sf_dir).groupBy("team", "player", "receiver").agg(F.count("*").alias("passes"))


@query(f""", {RECEIVE}, m AS (SELECT team, player, receiver, count(*) AS n FROM rc GROUP BY ALL)
SELECT a.team, CAST(sum(a.n) AS BIGINT) AS passes, round(sum(least(a.n, coalesce(b.n, 0))) / sum(a.n), 9) AS reciprocity
FROM m a LEFT JOIN m b ON a.team = b.team AND a.player = b.receiver AND a.receiver = b.player GROUP BY a.team""")
def pass_reciprocity(spark, sf_dir):
    """The share of each team's passes that are returned."""
    m = pass_matrix(spark, sf_dir)
    back = m.select("team", F.col("player").alias("receiver"), F.col("receiver").alias("player"), F.col("passes").alias("back"))
    j = m.join(back, ["team", "player", "receiver"], "left")
    return j.groupBy("team").agg(F.sum("passes").alias("passes"), F.round(F.sum(F.least("passes", F.coalesce("back", F.lit(0)))) / F.sum("passes"), 9).alias("reciprocity"))


@query(f""", m AS (SELECT *, at_us // {HOUR} AS moment FROM act)
SELECT player, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m s WHERE s.player = m.player AND s.moment = m.moment AND s.action = 'purchase')) AS BIGINT) AS succeeded
FROM m WHERE action = 'click' GROUP BY player""")
def same_moment_tally(spark, sf_dir):
    """Each player's clicks, and those with a purchase in the same hour."""
    m = actions(spark, sf_dir).withColumn("moment", F.floor(F.col("at_us") / HOUR))
    won = m.filter("action = 'purchase'").select("player", "moment").distinct().withColumn("won", F.lit(1))
    return m.filter("action = 'click'").join(won, ["player", "moment"], "left").groupBy("player").agg(F.count("*").alias("total"), F.count("won").alias("succeeded"))


@query(f""", m AS (SELECT *, at_us // {HOUR} AS moment FROM act)
SELECT a.event_id, a.player AS winner, b.player AS loser FROM m a JOIN m b ON a.moment = b.moment AND a.team = 0 AND b.team = 1 AND a.action = 'click' AND b.action = 'view'
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_id) = 1""")
def contested_pairs(spark, sf_dir):
    """The first opponent that views in the hour of each click of team 0."""
    m = actions(spark, sf_dir).withColumn("moment", F.floor(F.col("at_us") / HOUR))
    ours = m.filter("team = 0 and action = 'click'").select("event_id", "moment", F.col("player").alias("winner"))
    first = m.filter("team = 1 and action = 'view'").groupBy("moment").agg(F.min_by("player", "event_id").alias("loser"))
    return ours.join(first, "moment").select("event_id", "winner", "loser")


@query(""", g AS (SELECT event_id, team, game, at_us FROM act WHERE action = 'purchase'), d AS (SELECT team, game, at_us FROM act WHERE action = 'signup'),
s AS (SELECT g.*, (SELECT max(d.at_us) FROM d WHERE d.team = g.team AND d.game = g.game AND d.at_us <= g.at_us) AS draw_us FROM g)
SELECT s.event_id, s.draw_us, CAST(count(a.event_id) AS BIGINT) AS moves, s.at_us - s.draw_us AS build_us
FROM s LEFT JOIN act a ON a.team = s.team AND a.game = s.game AND a.at_us >= s.draw_us AND a.at_us <= s.at_us GROUP BY ALL""")
def goal_buildup(spark, sf_dir):
    """Each purchase with its team's last sign-up of the day before it, and the actions from then on."""
    a = actions(spark, sf_dir)
    order = Window.partitionBy("team", "game").orderBy("at_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    draw = F.max(F.when(F.col("action") == "signup", F.col("at_us"))).over(order)
    upto = F.count("*").over(order)
    # actions up to a purchase less those before its draw: two running counts in place of a range join
    marked = a.withColumn("draw_us", draw).withColumn("upto", upto)
    before = F.count("*").over(Window.partitionBy("team", "game").orderBy("at_us").rangeBetween(Window.unboundedPreceding, -1))
    starts = a.withColumn("before", before).filter("action = 'signup'").groupBy("team", "game", F.col("at_us").alias("draw_us")).agg(F.min("before").alias("before"))
    g = marked.filter("action = 'purchase'").join(starts, ["team", "game", "draw_us"], "left")
    return g.select("event_id", "draw_us", F.coalesce(F.col("upto") - F.col("before"), F.lit(0)).alias("moves"), (F.col("at_us") - F.col("draw_us")).alias("build_us"))


def _since(kind: str, keys: list[str]):
    """Time since the last action of a kind, of the same keys, strictly before."""
    order = Window.partitionBy(*keys).orderBy("at_us").rangeBetween(Window.unboundedPreceding, -1)
    return F.col("at_us") - F.max(F.when(F.col("action") == kind, F.col("at_us"))).over(order)


SINCE = "at_us - max(CASE WHEN action = '{0}' THEN at_us END) OVER (PARTITION BY team, game ORDER BY at_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_{0}"
ORIGIN = ", s AS (SELECT *, " + ", ".join(SINCE.format(k) for k in ("signup", "click", "view")) + " FROM act)"


@query(ORIGIN + f""" SELECT event_id, CASE WHEN since_signup <= {30 * MINUTE} THEN 'Faceoff' WHEN since_click <= {30 * MINUTE} THEN 'Turnover' WHEN since_view <= {30 * MINUTE} THEN 'Rush' ELSE 'Sustained' END AS origin FROM s WHERE action = 'purchase'""")
def goal_origin(spark, sf_dir):
    """What led to each purchase: the first of three kinds of action that lies within half an hour."""
    s = actions(spark, sf_dir)
    near = [F.coalesce(_since(k, ["team", "game"]) <= 30 * MINUTE, F.lit(False)) for k in ("signup", "click", "view")]
    origin = F.when(near[0], "Faceoff").when(near[1], "Turnover").when(near[2], "Rush").otherwise("Sustained")
    return s.withColumn("origin", origin).filter("action = 'purchase'").select("event_id", "origin")


@query(ORIGIN + f" SELECT event_id, coalesce(since_click <= {10 * MINUTE}, false) AS rebound FROM s WHERE action = 'purchase'")
def rebound_flag(spark, sf_dir):
    """Whether a click of the team lies strictly before each purchase, by ten minutes at most."""
    s = actions(spark, sf_dir).withColumn("rebound", F.coalesce(_since("click", ["team", "game"]) <= 10 * MINUTE, F.lit(False)))
    return s.filter("action = 'purchase'").select("event_id", "rebound")


@query(f""", w0 AS (SELECT game, at_us AS start_us, least(at_us + {30 * MINUTE}, (game + 1) * {24 * HOUR}) AS end_us FROM act WHERE action = 'purchase'), {union_sql('w', 'w0', 'game')},
t AS (SELECT game, CAST(sum(end_us - start_us) AS BIGINT) AS inside_us FROM w GROUP BY game),
n AS (SELECT a.game, count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM w WHERE w.game = a.game AND a.at_us >= w.start_us AND a.at_us < w.end_us)) AS inside FROM act a WHERE action = 'click' GROUP BY a.game)
SELECT t.game, inside_us, {24 * HOUR} - inside_us AS outside_us, CAST(inside AS BIGINT) AS inside, CAST(total - inside AS BIGINT) AS outside FROM t JOIN n USING (game)""")
def momentum_windows(spark, sf_dir):
    """Clicks within half an hour after a purchase of the day, and the length of those windows, against the rest."""
    a = actions(spark, sf_dir)
    w = a.filter("action = 'purchase'").select("game", F.col("at_us").alias("start_us"), F.least(F.col("at_us") + 30 * MINUTE, (F.col("game") + 1) * 24 * HOUR).alias("end_us"))
    w = I.interval_union(w, ["game"])
    t = w.groupBy("game").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("inside_us"))
    c = I.point_in_interval(a.filter("action = 'click'").select("game", "at_us"), w, ["game"], how="left")
    n = c.groupBy("game").agg(F.count("start_us").alias("inside"), F.count_if(F.col("start_us").isNull()).alias("outside"))
    return t.join(n, "game").select("game", "inside_us", (24 * HOUR - F.col("inside_us")).alias("outside_us"), "inside", "outside")


LEAD = f"""g AS (SELECT game, period, at_us, event_id, CASE WHEN team = 0 THEN 1 ELSE -1 END AS d FROM act WHERE action = 'purchase'),
r AS (SELECT *, CAST(sum(d) OVER (PARTITION BY game ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lead, coalesce(lead(at_us) OVER (PARTITION BY game ORDER BY at_us, event_id), (game + 1) * {24 * HOUR}) AS next_us FROM g)"""


def leads(spark, sf_dir) -> DataFrame:
    g = actions(spark, sf_dir).filter("action = 'purchase'").withColumn("d", F.when(F.col("team") == 0, 1).otherwise(-1))
    order = Window.partitionBy("game").orderBy("at_us", "event_id")
    return g.select("game", "period", "at_us", "event_id", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"), F.coalesce(F.lead("at_us").over(order), (F.col("game") + 1) * 24 * HOUR).alias("next_us"))


@query(f""", {LEAD} SELECT game, CAST(sum(CASE WHEN lead > 0 THEN next_us - at_us ELSE 0 END) AS BIGINT) AS leading_us, CAST(sum(CASE WHEN lead = 0 THEN next_us - at_us ELSE 0 END) AS BIGINT) AS tied_us, CAST(sum(CASE WHEN lead < 0 THEN next_us - at_us ELSE 0 END) AS BIGINT) AS trailing_us, max(lead) AS best FROM r GROUP BY game""")
def score_states(spark, sf_dir):
    """How long team 0 leads, is level and trails on each day."""
    r, span = leads(spark, sf_dir), F.col("next_us") - F.col("at_us")
    sums = [F.sum(F.when(c, span).otherwise(0)).alias(n) for c, n in ((F.col("lead") > 0, "leading_us"), (F.col("lead") == 0, "tied_us"), (F.col("lead") < 0, "trailing_us"))]
    return r.groupBy("game").agg(*sums, F.max("lead").alias("best"))


@query(f", {LEAD} SELECT game, period, arg_max(lead, (at_us, event_id)) AS lead FROM r GROUP BY game, period")
def lead_after_period(spark, sf_dir):
    """Team 0's lead after the last purchase of each period."""
    return leads(spark, sf_dir).groupBy("game", "period").agg(F.max_by("lead", F.struct("at_us", "event_id")).alias("lead"))


@query(f""" SELECT segment, CAST(count(*) FILTER (WHERE team = 0) AS BIGINT) AS goals_for, CAST(count(*) FILTER (WHERE team = 1) AS BIGINT) AS goals_against
FROM (SELECT team, CAST(least((at_us - game * {24 * HOUR}) // {2 * HOUR}, 10) AS BIGINT) AS segment FROM act WHERE action = 'purchase') GROUP BY segment""")
def goal_segments(spark, sf_dir):
    """Purchases of both teams by two-hour segments of the day, the last four hours as one."""
    seg = F.least(F.floor((F.col("at_us") - F.col("game") * 24 * HOUR) / (2 * HOUR)), F.lit(10)).alias("segment")
    return actions(spark, sf_dir).filter("action = 'purchase'").groupBy(seg).agg(F.count_if(F.col("team") == 0).alias("goals_for"), F.count_if(F.col("team") == 1).alias("goals_against"))


@query(f""", {union_sql('u', 'shift', 'player, game, period')}, r AS (SELECT *, lead(start_us) OVER (PARTITION BY player, game, period ORDER BY start_us) - end_us AS rest FROM u)
SELECT player, CAST(count(*) AS BIGINT) AS rests, CAST(sum(rest) AS BIGINT) AS rest_us, CAST(max(rest) AS BIGINT) AS longest_us FROM r WHERE rest >= {5 * MINUTE} GROUP BY player""")
def rest_between_shifts(spark, sf_dir):
    """Rests of five minutes or more between a player's shifts of one period."""
    u = I.interval_union(shifts(spark, sf_dir), ["player", "game", "period"])
    r = u.withColumn("rest", F.lead("start_us").over(Window.partitionBy("player", "game", "period").orderBy("start_us")) - F.col("end_us"))
    return r.filter(F.col("rest") >= 5 * MINUTE).groupBy("player").agg(F.count("*").alias("rests"), F.sum("rest").alias("rest_us"), F.max("rest").alias("longest_us"))


@query(f""", b AS (SELECT CAST(a AS INTEGER) AS low, CAST(z AS BIGINT) AS high FROM (VALUES (0, 15), (15, 30), (30, 45), (45, 60), (60, 100000)) AS v(a, z))
SELECT team, low, CAST(sum(greatest(least(end_us - start_us, high * {MINUTE}) - CAST(low AS BIGINT) * {MINUTE}, 0)) AS BIGINT) AS us, CAST(count(*) FILTER (WHERE end_us - start_us >= CAST(low AS BIGINT) * {MINUTE} AND end_us - start_us < high * {MINUTE}) AS BIGINT) AS ended
FROM shift, b GROUP BY team, low""")
def shift_age_buckets(spark, sf_dir):
    """Shift time by the shift's age, in quarter hours and the rest, and the shifts that ended at that age."""
    s = shifts(spark, sf_dir).withColumn("len", F.col("end_us") - F.col("start_us"))
    ages = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).cast("long").alias("high")) for a, b in ((0, 15), (15, 30), (30, 45), (45, 60), (60, 100_000))])
    e = s.select("team", "len", F.explode(ages).alias("b")).select("team", "len", "b.low", "b.high")
    us = F.greatest(F.least(F.col("len"), F.col("high") * MINUTE) - F.col("low").cast("long") * MINUTE, F.lit(0))
    return e.groupBy("team", "low").agg(F.sum(us).alias("us"), F.count_if((F.col("len") >= F.col("low").cast("long") * MINUTE) & (F.col("len") < F.col("high") * MINUTE)).alias("ended"))
