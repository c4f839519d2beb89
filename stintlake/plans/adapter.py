"""The driver tables in the vocabulary of the operators: an action stream, shifts and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, player, team, game (day number), period (1 to 3), at_us, action, value, place."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.col("user_id").alias("player"), (F.col("user_id") % 2).alias("team"), F.floor(at / DAY).alias("game"),
        (F.floor(F.floor(at / HOUR) % 24 / 8) + 1).cast("int").alias("period"), at.alias("at_us"), F.col("event_type").alias("action"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("place"),
    )


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shift of each event: from its time on for six seconds a unit of its value, as start_us and end_us."""
    a = actions(spark, sf_dir)
    return a.select("*", F.col("at_us").alias("start_us"), (F.col("at_us") + F.floor(F.col("value") * 6) * 1_000_000).alias("end_us"))


def skater_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, o_orderkey, order_day, quantity, returned, discount: order lines as a customer's game log."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("customer"), "o_orderkey", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / DAY).alias("order_day"),
        "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.col("l_discount").alias("discount"), F.col("l_suppkey").alias("supplier"),
    )


#: The same for the SQL side.
SQL = """act AS (
  SELECT event_id, user_id AS player, user_id % 2 AS team, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS game,
         CAST(floor((epoch_us(ts) // 3600000000) % 24 / 8) AS INTEGER) + 1 AS period, epoch_us(ts) AS at_us, event_type AS action, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS place
  FROM events),
shift AS (SELECT *, at_us AS start_us, at_us + CAST(floor(value * 6) AS BIGINT) * 1000000 AS end_us FROM act),
log AS (
  SELECT o_custkey AS customer, o_orderkey, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS order_day, l_linenumber,
         l_quantity AS quantity, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, l_discount AS discount, l_suppkey AS supplier
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def union_sql(name: str, source: str, keys: str, gap: int = 0) -> str:
    """CTE text: intervals of ``source`` merged by ``keys``."""
    apart = "> 0" if gap == 0 else f">= {gap}"
    return f"""{name} AS (
  SELECT {keys}, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS parts FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN p IS NULL OR start_us - p {apart} THEN 1 ELSE 0 END AS fresh FROM (
        SELECT *, max(end_us) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {source})))
  GROUP BY {keys}, island)"""

#: A period of a rebuilt game in milliseconds of its own clock, and the goalkeepers' numbers less the team's.
PERIOD_MS, GOALIE = 1_200_000, 1_000_000


def game_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each day as the rows of a game export, in the columns of ``sources.event_csv.read_events``.

    Every event is a shift of its player, and what its kind and place number make of it: shots (with the goalkeeper's rows on
    the other side), goals, battles with an opponent, faceoffs, penalties with the other team's power play, entries,
    recoveries, losses, passes. The goalkeepers' shifts cover each period, so the clock runs all the time.
    """
    a = actions(spark, sf_dir).withColumn("k", F.coalesce("place", F.lit(0)))
    ms = F.floor((F.col("at_us") - F.col("game") * DAY - (F.col("period") - 1) * 8 * HOUR) / 24_000)
    a = a.withColumn("ms", ms).withColumn("end", F.least(F.col("ms") + F.floor(F.col("value") * 250), F.lit(PERIOD_MS)))
    kind, k, me, us = F.col("action"), F.col("k"), F.col("player"), F.col("team")
    them, goalie = 1 - us, GOALIE + 1 - us
    on_goal = (kind == "purchase") | ((kind == "view") & (k % 3 == 0))

    def row(when, team, player, action, span_end=None):
        moment = span_end is None
        return F.when(when, F.struct(team.cast("long").alias("team"), player.cast("long").alias("player"), F.lit(action).alias("action"), F.lit("moment" if moment else "span").alias("kind"), (F.col("ms") if moment else span_end).alias("end")))

    purchase, view, click, signup, error = (kind == c for c in ("purchase", "view", "click", "signup", "error"))
    rows = [
        row(F.lit(True), us, me, "All shifts", F.col("end")), row(error, them, me + 1, "Power play shifts", F.least(F.col("ms") + 120_000, F.lit(PERIOD_MS))),
        row(view | purchase, us, me, "Shots"), row(on_goal, us, me, "Shots on goal"), row(purchase, us, me, "Goals"), row(purchase & (k % 2 == 0), us, me + 2, "Assists"),
        row(on_goal, them, goalie, "Shots against"), row(on_goal & view, them, goalie, "Saves"), row(purchase, them, goalie, "Goals against"),
        row(click, us, me, "Puck battles"), row(click & (k % 2 == 0), us, me, "Puck battles won"), row(click & (k % 2 == 1), us, me, "Puck battles lost"),
        row(click & (k % 2 == 0), them, me + 1, "Puck battles lost"), row(click & (k % 2 == 1), them, me + 1, "Puck battles won"),
        row(signup, us, me, "Faceoffs"), row(signup & (k % 2 == 0), us, me, "Faceoffs won"), row(signup & (k % 2 == 1), us, me, "Faceoffs lost"),
        row(signup & (k % 3 == 0), us, me, "Faceoffs in DZ"), row(signup & (k % 3 == 1), us, me, "Faceoffs in NZ"), row(signup & (k % 3 == 2), us, me, "Faceoffs in OZ"),
        row(error, us, me, "Penalties"), row(error & (k % 2 == 0), us, me, "Hits"), row(error & (k % 3 == 0), us, me, "Shots blocking"), row(view & (k % 7 == 0), us, me, "Blocked shots"),
        row(view & (k % 5 <= 1), us, me, "Entries"), row(view & (k % 5 == 0), us, me, "Entries via pass"), row(view & (k % 5 == 1), us, me, "Entries via stickhandling"),
        row(click & (k % 4 == 0), us, me, "Puck recoveries"), row(click & (k % 8 == 0), us, me, "Puck recoveries in OZ"), row(click & (k % 4 == 1), us, me, "Puck losses"), row(click & (k % 8 == 1), us, me, "Puck losses in DZ"),
        row(view & (k % 2 == 1), us, me, "Accurate passes"),
    ]
    e = a.select("event_id", "game", "period", "ms", "place", F.posexplode(F.array(*rows)).alias("n", "r")).filter("r is not null")
    out = e.select(F.col("game").alias("file"), (F.col("event_id") * 100 + F.col("n")).alias("row_no"), "r.kind", F.col("ms").alias("start_ms"), F.col("r.end").alias("end_ms"), F.col("ms").alias("at_ms"), "place", F.col("r.player").alias("player_id"), "r.team", "r.action", "period")
    keep = a.select(F.col("game").alias("file"), "period").distinct().select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("team"))
    whole = keep.select("file", (-1 - F.col("team") - 2 * F.col("period") - 10 * F.col("file")).alias("row_no"), F.lit("span").alias("kind"), F.lit(0).cast("long").alias("start_ms"), F.lit(PERIOD_MS).cast("long").alias("end_ms"), F.lit(0).cast("long").alias("at_ms"), F.lit(None).cast("int").alias("place"), (GOALIE + F.col("team")).cast("long").alias("player_id"), "team", F.lit("All shifts").alias("action"), "period")
    return out.unionByName(whole)


_K = "coalesce(place, 0)"
_ON = f"(action = 'purchase' OR (action = 'view' AND {_K} % 3 = 0))"
#: (condition, team, player, action, end of a span or nothing) of the rows above.
_ROWS = (
    ("true", "team", "player", "All shifts", "e_ms"), ("action = 'error'", "1 - team", "player + 1", "Power play shifts", f"least(ms + 120000, {PERIOD_MS})"),
    ("action IN ('view', 'purchase')", "team", "player", "Shots", ""), (_ON, "team", "player", "Shots on goal", ""), ("action = 'purchase'", "team", "player", "Goals", ""), (f"action = 'purchase' AND {_K} % 2 = 0", "team", "player + 2", "Assists", ""),
    (_ON, "1 - team", f"{GOALIE} + 1 - team", "Shots against", ""), (f"{_ON} AND action = 'view'", "1 - team", f"{GOALIE} + 1 - team", "Saves", ""), ("action = 'purchase'", "1 - team", f"{GOALIE} + 1 - team", "Goals against", ""),
    ("action = 'click'", "team", "player", "Puck battles", ""), (f"action = 'click' AND {_K} % 2 = 0", "team", "player", "Puck battles won", ""), (f"action = 'click' AND {_K} % 2 = 1", "team", "player", "Puck battles lost", ""),
    (f"action = 'click' AND {_K} % 2 = 0", "1 - team", "player + 1", "Puck battles lost", ""), (f"action = 'click' AND {_K} % 2 = 1", "1 - team", "player + 1", "Puck battles won", ""),
    ("action = 'signup'", "team", "player", "Faceoffs", ""), (f"action = 'signup' AND {_K} % 2 = 0", "team", "player", "Faceoffs won", ""), (f"action = 'signup' AND {_K} % 2 = 1", "team", "player", "Faceoffs lost", ""),
    (f"action = 'signup' AND {_K} % 3 = 0", "team", "player", "Faceoffs in DZ", ""), (f"action = 'signup' AND {_K} % 3 = 1", "team", "player", "Faceoffs in NZ", ""), (f"action = 'signup' AND {_K} % 3 = 2", "team", "player", "Faceoffs in OZ", ""),
    ("action = 'error'", "team", "player", "Penalties", ""), (f"action = 'error' AND {_K} % 2 = 0", "team", "player", "Hits", ""), (f"action = 'error' AND {_K} % 3 = 0", "team", "player", "Shots blocking", ""), (f"action = 'view' AND {_K} % 7 = 0", "team", "player", "Blocked shots", ""),
    (f"action = 'view' AND {_K} % 5 <= 1", "team", "player", "Entries", ""), (f"action = 'view' AND {_K} % 5 = 0", "team", "player", "Entries via pass", ""), (f"action = 'view' AND {_K} % 5 = 1", "team", "player", "Entries via stickhandling", ""),
    (f"action = 'click' AND {_K} % 4 = 0", "team", "player", "Puck recoveries", ""), (f"action = 'click' AND {_K} % 8 = 0", "team", "player", "Puck recoveries in OZ", ""), (f"action = 'click' AND {_K} % 4 = 1", "team", "player", "Puck losses", ""), (f"action = 'click' AND {_K} % 8 = 1", "team", "player", "Puck losses in DZ", ""),
    (f"action = 'view' AND {_K} % 2 = 1", "team", "player", "Accurate passes", ""),
)
#: The same rows for the SQL side, on the game clock: gm (moments, with t) and gs (spans, with s and e), in seconds.
GAME_SQL = SQL + f""", ev AS (SELECT *, CAST((at_us - game * {DAY} - (period - 1) * 8 * {HOUR}) // 24000 AS BIGINT) AS ms FROM act),
ev2 AS (SELECT *, least(ms + CAST(floor(value * 250) AS BIGINT), {PERIOD_MS}) AS e_ms FROM ev),
gm AS (SELECT *, (period - 1) * 1200 + at_ms / 1000.0::DOUBLE AS t FROM (""" + " UNION ALL ".join(
    f"SELECT game, period, event_id * 100 + {n} AS row_no, {team} AS team, {player} AS player, '{action}' AS action, ms AS at_ms, place FROM ev2 WHERE {when}" for n, (when, team, player, action, end) in enumerate(_ROWS) if not end
) + """)),
gs AS (SELECT *, (period - 1) * 1200 + s_ms / 1000.0::DOUBLE AS s, (period - 1) * 1200 + e_ms / 1000.0::DOUBLE AS e FROM (""" + " UNION ALL ".join(
    f"SELECT game, period, {team} AS team, {player} AS player, '{action}' AS action, ms AS s_ms, {end} AS e_ms FROM ev2 WHERE {when}" for when, team, player, action, end in _ROWS if end
) + f""" UNION ALL SELECT DISTINCT game, period, t.team, {GOALIE} + t.team, 'All shifts', 0, {PERIOD_MS} FROM act, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS team) t))
"""
