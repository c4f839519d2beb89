"""Small report operators: scopes, outcomes, labels, cell readings, orders, standings, tones and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.functions import rink
from stintlake.functions import text as T
from stintlake.operators import aggregates as A
from stintlake.operators import joins as J
from stintlake.operators import ordered as O
from stintlake.plans.adapter import SQL, actions, shifts, table
from stintlake.plans.rink_game import outcome
from stintlake.plans.season import DUELS, LEAGUE, TOI, duels, ice_time, league

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}"
        return f

    return add


def in_scope(games: DataFrame, wanted: list[int], col: str = "game") -> DataFrame:
    """The games of a request: those listed, or all for an empty list."""
    return games.filter(F.col(col).isin(*wanted)) if wanted else games


def focus(games: DataFrame, game: int, col: str = "game") -> DataFrame:
    """Games with ``focus``: whether it is the one that is compared with the rest. One outside the scope is an error."""
    marked = games.withColumn("focus", F.col(col) == game)
    found = marked.agg(F.coalesce(F.max("focus"), F.lit(False)).alias("_found"))
    return marked.crossJoin(F.broadcast(found)).withColumn("focus", F.when(F.col("_found"), F.col("focus")).otherwise(F.raise_error(F.lit("the focus game is not in scope")).cast("boolean"))).drop("_found")


@query(" SELECT game, CAST(count(*) AS BIGINT) AS n, game = 19727 AS focus FROM act WHERE game IN (19725, 19727, 19729, 19731) GROUP BY game")
def scope_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games of a request, one of them in focus."""
    g = actions(spark, sf_dir).groupBy("game").agg(F.count("*").alias("n"))
    return focus(in_scope(g, [19725, 19727, 19729, 19731]), 19727)


@query(f""", {DUELS}, x AS (SELECT *, CASE WHEN period = 3 THEN 3900 ELSE 3600 END AS len FROM o), r AS (SELECT game, period, len, CASE WHEN gf > ga THEN 'Win' WHEN gf = ga THEN 'Tie' WHEN len > 3601 THEN 'OvertimeLoss' ELSE 'Loss' END AS ours FROM x)
SELECT game, period, ours, CASE WHEN ours = 'Win' AND len > 3601 THEN 'OvertimeLoss' WHEN ours = 'Win' THEN 'Loss' WHEN ours = 'Tie' THEN 'Tie' ELSE 'Win' END AS theirs FROM r""")
def outcomes(spark, sf_dir):
    """Each duel's result from both sides; those of the third period are taken as played into overtime."""
    d = duels(spark, sf_dir).withColumn("len", F.when(F.col("period") == 3, 3900).otherwise(3600))
    d = d.withColumn("ours", outcome(F.col("gf"), F.col("ga"), F.col("len")))
    return d.select("game", "period", "ours", mirrored(F.col("ours"), F.col("len")).alias("theirs"))


def mirrored(result: Column, length_s: Column) -> Column:
    """The other side's result: a win in overtime is its overtime loss."""
    return F.when((result == "Win") & (length_s > 3601), "OvertimeLoss").when(result == "Win", "Loss").when(result == "Tie", "Tie").otherwise("Win")


def league_outcome(goals_for: Column, goals_against: Column, regulation_for: Column, regulation_against: Column) -> Column:
    """A league side's result: level after three periods and then beaten is an overtime loss."""
    return F.when(goals_for > goals_against, "Win").when(goals_for == goals_against, "Tie").when(regulation_for == regulation_against, "OvertimeLoss").otherwise("Loss")


@query(""", g AS (SELECT game, count(*) FILTER (WHERE team = 0) AS gf, count(*) FILTER (WHERE team = 1) AS ga, count(*) FILTER (WHERE team = 0 AND period < 3) AS rf, count(*) FILTER (WHERE team = 1 AND period < 3) AS ra FROM act WHERE action = 'purchase' GROUP BY game)
SELECT game, CASE WHEN gf > ga THEN 'Win' WHEN gf = ga THEN 'Tie' WHEN rf = ra THEN 'OvertimeLoss' ELSE 'Loss' END AS result FROM g""")
def league_outcomes(spark, sf_dir):
    """A league game's result by its regulation goals."""
    n = lambda t, p: F.count_if((F.col("team") == t) & p)
    g = actions(spark, sf_dir).filter("action = 'purchase'").groupBy("game").agg(n(0, F.lit(True)).alias("gf"), n(1, F.lit(True)).alias("ga"), n(0, F.col("period") < 3).alias("rf"), n(1, F.col("period") < 3).alias("ra"))
    return g.select("game", league_outcome(*[F.col(c) for c in ("gf", "ga", "rf", "ra")]).alias("result"))


def verdict(p: Column) -> Column:
    """What an adjusted p-value is called."""
    return F.when(p.isNull(), "NotEnoughData").when(p < 0.05, "LikelyReal").when(p < 0.20, "Maybe").otherwise("CouldBeNoise")


@query(" SELECT DISTINCT player, CASE WHEN player % 10 = 0 THEN 'NotEnoughData' WHEN (player * 7919 % 1000) / 1000.0 < 0.05 THEN 'LikelyReal' WHEN (player * 7919 % 1000) / 1000.0 < 0.2 THEN 'Maybe' ELSE 'CouldBeNoise' END AS verdict FROM act")
def verdicts(spark, sf_dir):
    """Verdicts on made-up p-values, some of them missing."""
    p = F.when(F.col("player") % 10 != 0, (F.col("player") * 7919 % 1000) / 1000.0)
    return actions(spark, sf_dir).select("player").distinct().select("player", verdict(p).alias("verdict"))


def pair_kind(a: Column, b: Column) -> Column:
    """DefenceDefence, ForwardForward, ForwardDefence or Other, of two positions."""
    both = F.array_sort(F.array(a, b))
    of = lambda x, y: (both[0] == x) & (both[1] == y)
    return F.when(of("Defence", "Defence"), "DefenceDefence").when(of("Forward", "Forward"), "ForwardForward").when(of("Defence", "Forward"), "ForwardDefence").otherwise("Other")


def corsi_source(kind: Column) -> Column:
    """The kind of unit whose table holds the attempts of a kind of pair; null for others."""
    return F.when(kind == "DefenceDefence", "DefencePair").when(kind == "ForwardForward", "ForwardLine").when(kind == "ForwardDefence", "FullUnit")


POSITION = "CASE player % 4 WHEN 0 THEN 'Defence' WHEN 1 THEN 'Forward' WHEN 2 THEN 'Goalie' ELSE 'Unknown' END"


@query(f""", p AS (SELECT DISTINCT player, {POSITION} AS pos FROM act), k AS (SELECT a.pos AS a, b.pos AS b, CASE WHEN a.pos = 'Defence' AND b.pos = 'Defence' THEN 'DefenceDefence' WHEN a.pos = 'Forward' AND b.pos = 'Forward' THEN 'ForwardForward' WHEN a.pos IN ('Defence', 'Forward') AND b.pos IN ('Defence', 'Forward') THEN 'ForwardDefence' ELSE 'Other' END AS kind FROM p a JOIN p b ON b.player = a.player + 1)
SELECT kind, CASE kind WHEN 'DefenceDefence' THEN 'DefencePair' WHEN 'ForwardForward' THEN 'ForwardLine' WHEN 'ForwardDefence' THEN 'FullUnit' END AS source, CAST(count(*) AS BIGINT) AS pairs FROM k GROUP BY ALL""")
def pair_kinds(spark, sf_dir):
    """Kinds of the pairs of neighbouring players."""
    p = actions(spark, sf_dir).select("player").distinct().select("player", F.expr(POSITION).alias("pos"))
    k = pair_kind(F.col("pos"), F.col("other"))
    return p.join(p.select((F.col("player") - 1).alias("player"), F.col("pos").alias("other")), "player").select(k.alias("kind")).groupBy("kind").agg(F.count("*").alias("pairs")).select("kind", corsi_source(F.col("kind")).alias("source"), "pairs")


def our_index(teams: Column, prefix: str) -> Column:
    """Which of a title's two teams starts with the prefix, in any case; an error unless exactly one does."""
    ours = F.transform(teams, lambda t: F.upper(t).startswith(prefix.upper()))
    return F.when(ours[0] & ~ours[1], 0).when(ours[1] & ~ours[0], 1).otherwise(F.raise_error(F.concat(F.lit("not exactly one of our teams: "), F.array_join(teams, " vs "))).cast("int"))


@query(" SELECT o_orderkey, CAST(o_orderkey % 2 AS INTEGER) AS ours FROM orders")
def team_index(spark, sf_dir):
    """Our side in titles that list it first or second."""
    teams = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("LIONS U15"), F.concat(F.lit("TEAM "), "o_custkey"))).otherwise(F.array(F.concat(F.lit("TEAM "), "o_custkey"), F.lit("Lions u15")))
    return table(spark, sf_dir, "orders").select("o_orderkey", our_index(teams, "lions").alias("ours"))


@query(f""", {TOI} SELECT player, greatest(toi - clicks * 3600 - views * 1800, 0) AS ev_toi, round(CASE WHEN clicks * clicks + views * views > 0 THEN clicks * clicks / (clicks * clicks + views * views) END, 8) AS pythagorean FROM t""")
def even_time_and_expectation(spark, sf_dir):
    """Time at even strength, never under zero, and the share of wins that goals for and against let expect."""
    t = ice_time(spark, sf_dir)
    return t.select("player", F.greatest(F.col("toi") - F.col("clicks") * 3600 - F.col("views") * 1800, F.lit(0)).alias("ev_toi"), F.round(pythagorean(F.col("clicks"), F.col("views")), 8).alias("pythagorean"))


def pythagorean(scored: Column, allowed: Column) -> Column:
    """s^2 / (s^2 + a^2)."""
    return A.ratio(scored * scored, scored * scored + allowed * allowed)


#: Printed forms of a number q by line number: text and the readings that the SQL side expects.
FORMS = (("{q}", "Int"), ("{q}:46", "Clock"), ("{q}.25", "Decimal"), ("{q} 40%", "CountShare"), ("{q} / 1 33%", "Ratio"), ("-{q}", "Int"), ("—", "Empty"))


def printed_cells(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    form = F.element_at(F.array(*[F.concat(*[q if x == "{q}" else F.lit(x) for x in f.replace("{q}", "\0{q}\0").split("\0") if x]) for f, _ in FORMS]), F.col("l_linenumber").cast("int"))
    return table(spark, sf_dir, "lineitem").filter("l_linenumber <= 7").select("l_orderkey", "l_linenumber", form.alias("printed"))


_Q, _L = "CAST(CAST(l_quantity AS INTEGER) AS DOUBLE)", "l_linenumber"


@query(f""" SELECT l_orderkey, l_linenumber, CASE WHEN {_L} IN (1, 4) THEN {_Q} WHEN {_L} = 7 THEN 0.0 END AS count, CASE {_L} WHEN 1 THEN {_Q} WHEN 6 THEN -{_Q} WHEN 7 THEN 0.0 END AS signed, CASE {_L} WHEN 2 THEN {_Q} * 60 + 46 WHEN 7 THEN 0.0 END AS seconds,
 CASE {_L} WHEN 3 THEN {_Q} + 0.25 WHEN 1 THEN {_Q} WHEN 6 THEN -{_Q} WHEN 7 THEN 0.0 END AS "decimal", CASE {_L} WHEN 5 THEN {_Q} WHEN 7 THEN 0.0 END AS ratio, CASE {_L} WHEN 4 THEN 40.0::DOUBLE END AS percent,
 CASE {_L} WHEN 2 THEN {_Q} * 60 + 46 WHEN 3 THEN {_Q} + 0.25 WHEN 6 THEN -{_Q} WHEN 7 THEN 0.0 ELSE {_Q} END AS number FROM lineitem WHERE l_linenumber <= 7""")
def cell_accessors(spark, sf_dir):
    """Printed cells read as counts, signed numbers, seconds, decimals, ratios, percentages and plain numbers."""
    c = printed_cells(spark, sf_dir).withColumn("c", T.cell(F.col("printed")))
    return c.select("l_orderkey", "l_linenumber", *[T.cell_as(F.col("c"), w).alias(w) for w in ("count", "signed", "seconds", "decimal", "ratio", "percent")], T.cell_number(F.col("c")).alias("number"))


@query(r""" SELECT p_partkey, array_to_string(list_transform(string_split(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""")
def title_cased(spark, sf_dir):
    """Part names in title case."""
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("title"))


@query(""", d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1997-06-15' AS r FROM orders)
SELECT o_orderkey, CAST(CASE WHEN make_date(1997, month(d), least(day(d), 28)) <= r + 1 THEN 1997 ELSE 1996 END AS INTEGER) AS year FROM d""")
def inferred_years(spark, sf_dir):
    """The year of dates printed without one, as seen on a day in June 1997."""
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(T.infer_year(F.least(F.day(d), F.lit(28)), F.month(d), F.to_date(F.lit("1997-06-15")))).alias("year"))


@query(""" SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'é+' || page_id || ' ok' END AS decoded FROM pages""")
def percent_decoded(spark, sf_dir):
    """Escaped texts decoded strictly; every third has a broken escape."""
    x = F.concat(F.lit("%C3%A9+"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 2, "%2").otherwise("%20"), F.lit("ok"))
    return table(spark, sf_dir, "pages").select("page_id", T.percent_decode(x).alias("decoded"))


XY = "((coalesce(place, 0) * 13) % 61) AS x, ((coalesce(place, 0) * 7) % 26) AS y"


@query(f""", p AS (SELECT event_id, action, {XY} FROM act), q AS (SELECT *, action IN ('view', 'click') AS won FROM p), r AS (SELECT event_id, (CASE WHEN won THEN x ELSE 60.96 - x END) / 0.3048 - 100 AS along, 12.96 / 0.3048 - (CASE WHEN won THEN y ELSE 25.92 - y END) / 0.3048 AS across FROM q)
SELECT event_id, round(along, 6) AS along, round(across, 6) AS across, CASE WHEN along < -92 THEN 'BehindOwnGoal' WHEN along < -69 THEN CASE WHEN abs(across) <= 9 THEN 'OwnSlot' ELSE 'OwnCorners' END WHEN along < -25 THEN 'OwnBlueLine' WHEN along <= 25 THEN 'NeutralZone' WHEN along <= 69 THEN 'OppBlueLine' WHEN along <= 92 THEN CASE WHEN abs(across) <= 9 THEN 'OppSlot' ELSE 'OppCorners' END ELSE 'BehindOppGoal' END AS area,
 round(ln(greatest(sqrt((89 - along) ** 2 + across ** 2), 3)), 8) AS ln_distance, round(atan2(abs(across), 89 - along), 8) AS angle FROM r""")
def contested_places(spark, sf_dir):
    """Contested places in the acting team's frame, their battle area and shot features."""
    p = actions(spark, sf_dir).withColumn("x", F.expr(XY.split(" AS x")[0]).cast("double")).withColumn("y", F.expr("(coalesce(place, 0) * 7) % 26").cast("double"))
    along, across = rink.contested(F.col("x"), F.col("y"), F.col("action").isin("view", "click"))
    p = p.select("event_id", along.alias("along"), across.alias("across"))
    f = rink.shot_features(F.col("along"), F.col("across"))
    return p.select("event_id", F.round("along", 6).alias("along"), F.round("across", 6).alias("across"), rink.battle_area(F.col("along"), F.col("across")).alias("area"), F.round(f[1], 8).alias("ln_distance"), F.round(f[2], 8).alias("angle"))


@query(""", c AS (SELECT player, count(*) FILTER (WHERE action = 'click') AS s, count(*) AS n FROM act GROUP BY player), r AS (SELECT player, s / n AS p, row_number() OVER (ORDER BY s DESC, player) AS place FROM c)
SELECT player, CASE WHEN p >= 0.9 THEN 'very likely above average' WHEN p >= 0.75 THEN 'probably above average' WHEN p <= 0.1 THEN 'very likely below average' WHEN p <= 0.25 THEN 'probably below average' ELSE 'can''t tell yet' END AS words,
 place || CASE WHEN place % 100 BETWEEN 11 AND 13 THEN 'th' WHEN place % 10 = 1 THEN 'st' WHEN place % 10 = 2 THEN 'nd' WHEN place % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM r""")
def words_and_ordinals(spark, sf_dir):
    """Chances in words and places as ordinals."""
    c = actions(spark, sf_dir).groupBy("player").agg(F.count_if(F.col("action") == "click").alias("s"), F.count("*").alias("n"))
    return O.numbered(c, [F.desc("s"), F.col("player")], "place").select("player", T.probability_words(F.col("s") / F.col("n")).alias("words"), T.ordinal(F.col("place")).alias("ordinal"))


@query(f""", {LEAGUE}, v AS (SELECT team, strength, CASE WHEN region % 2 = 0 THEN 1 ELSE -1 END AS better FROM n)
SELECT a.team, round(100.0 * (count(*) FILTER (WHERE a.better * (a.strength - b.strength) > 0 AND abs(a.strength - b.strength) >= 1e-12) + count(*) FILTER (WHERE abs(a.strength - b.strength) < 1e-12) / 2) / count(*), 6) AS percentile FROM v a JOIN v b ON a.team <> b.team GROUP BY a.team""")
def directional_percentile(spark, sf_dir):
    """The share of the other teams that each one beats, ties counted half; for some more is better, for others less."""
    v = league(spark, sf_dir).select("team", "strength", F.when(F.col("region") % 2 == 0, 1).otherwise(-1).alias("better"))
    w = Window.partitionBy(F.lit(0)).orderBy("strength")  # a row a team
    n, at = F.count("*").over(Window.partitionBy(F.lit(0))), F.count("*").over(Window.partitionBy("strength"))
    below = F.rank().over(w) - 1
    beaten = F.when(F.col("better") > 0, below).otherwise(n - below - at)
    return v.select("team", F.round(100.0 * (beaten + (at - 1) / 2) / (n - 1), 6).alias("percentile"))


@query(f", {TOI} SELECT player, CASE WHEN toi >= 20000 THEN CAST(row_number() OVER (PARTITION BY toi >= 20000 ORDER BY clicks DESC, player) AS INTEGER) END AS place FROM t")
def qualified_rank(spark, sf_dir):
    """Places among those with enough time; others have none."""
    t = ice_time(spark, sf_dir).withColumn("ok", F.col("toi") >= 20000)
    return t.select("player", F.when(F.col("ok"), F.row_number().over(Window.partitionBy("ok").orderBy(F.desc("clicks"), "player"))).alias("place"))


@query(""", v AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v, player FROM act)
SELECT event_id, CAST(row_number() OVER (PARTITION BY player ORDER BY v IS NULL, isnan(v) DESC, v DESC, event_id) AS INTEGER) AS down, CAST(row_number() OVER (PARTITION BY player ORDER BY v IS NULL, isnan(v), v, event_id) AS INTEGER) AS up FROM v""")
def nan_and_null_order(spark, sf_dir):
    """A total order of numbers with NaN above all, and nulls last whichever way it goes."""
    v = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    a = actions(spark, sf_dir).select("event_id", "player", v.alias("v"))
    place = lambda o: F.row_number().over(Window.partitionBy("player").orderBy(o, "event_id"))
    return a.select("event_id", place(F.desc_nulls_last("v")).alias("down"), place(F.asc_nulls_last("v")).alias("up"))


@query(" SELECT team, player, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, min(event_id)) AS INTEGER) AS place FROM act GROUP BY team, player")
def busiest_first(spark, sf_dir):
    """Players by how much they do; of equals the one that appears first."""
    c = actions(spark, sf_dir).groupBy("team", "player").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.select("team", "player", "n", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("n"), "first")).alias("place"))


@query(f""", {TOI}, z AS (SELECT player, (clicks - avg(clicks) OVER ()) / nullif(stddev_samp(clicks) OVER (), 0) AS up, -(views - avg(views) OVER ()) / nullif(stddev_samp(views) OVER (), 0) AS down FROM t)
SELECT player, CASE WHEN abs(up) >= 0.35 THEN round(sign(up) * least(1, abs(up) / 2) * 30, 5) ELSE 0 END AS clicks_tone, CASE WHEN abs(down) >= 0.35 THEN round(sign(down) * least(1, abs(down) / 2) * 30, 5) ELSE 0 END AS views_tone FROM z""")
def column_tones(spark, sf_dir):
    """How strongly a table's cells are tinted: by their distance from the column's mean, green for the better side."""
    t = ice_time(spark, sf_dir)
    s = t.agg(*[f(c).alias(f"{n}_{c}") for c in ("clicks", "views") for n, f in (("m", F.avg), ("s", F.stddev_samp))])  # one row

    def tone(c: str, sign: int) -> Column:
        z = sign * (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))
        return F.when(F.abs(z) >= 0.35, F.round(F.signum(z) * F.least(F.lit(1.0), F.abs(z) / 2) * 30, 5)).otherwise(0.0).alias(f"{c}_tone")

    return t.crossJoin(F.broadcast(s)).select("player", tone("clicks", 1), tone("views", -1))


@query(f", {LEAGUE} SELECT a.team, round((a.strength - avg(b.strength)) / stddev_samp(b.strength), 6) AS sds FROM n a JOIN n b ON a.team <> b.team GROUP BY a.team, a.strength HAVING count(*) >= 2 AND stddev_samp(b.strength) > 0")
def team_standing(spark, sf_dir):
    """How many standard deviations of the other teams each one lies from their mean, from sums over all teams."""
    l = league(spark, sf_dir).select("team", F.col("strength").alias("x"))
    s = l.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    l = l.crossJoin(F.broadcast(s)).filter("n >= 3")
    n = F.col("n") - 1
    mean = (F.col("m") * F.col("n") - F.col("x")) / n
    var = (F.col("n") * F.col("v") - (F.col("x") - F.col("m")) ** 2 * F.col("n") / n) / (n - 1)
    return l.filter(var > 1e-9).select("team", F.round((F.col("x") - mean) / F.sqrt(var), 6).alias("sds"))


@query(""", z AS (SELECT player, count(*) FILTER (WHERE place % 3 = 0) AS dz, count(*) FILTER (WHERE place % 3 = 2) AS oz, count(*) AS n, count(*) FILTER (WHERE place % 2 = 0 AND place % 3 = 0) AS wd, count(*) FILTER (WHERE place % 2 = 0 AND place % 3 = 2) AS wo, count(*) FILTER (WHERE place % 2 = 0) AS w FROM act WHERE action = 'signup' AND place IS NOT NULL GROUP BY player)
SELECT player, CAST(n - dz - oz AS BIGINT) AS neutral, CAST(w - wd - wo AS BIGINT) AS won, round(CASE WHEN n - dz - oz > 0 THEN 100.0 * (w - wd - wo) / (n - dz - oz) END, 6) AS share FROM z""")
def neutral_faceoffs(spark, sf_dir):
    """Faceoffs in the neutral zone: what is left of all after the other two zones."""
    k, won = F.col("place"), F.col("place") % 2 == 0
    z = actions(spark, sf_dir).filter("action = 'signup' and place is not null").groupBy("player").agg(
        F.count("*").alias("n"), F.count_if(k % 3 == 0).alias("dz"), F.count_if(k % 3 == 2).alias("oz"), F.count_if(won).alias("w"), F.count_if(won & (k % 3 == 0)).alias("wd"), F.count_if(won & (k % 3 == 2)).alias("wo"))
    n, w = F.col("n") - F.col("dz") - F.col("oz"), F.col("w") - F.col("wd") - F.col("wo")
    return z.select("player", n.alias("neutral"), w.alias("won"), F.round(A.ratio(w, n, 100.0), 6).alias("share"))


@query(f""", {TOI}, w AS (SELECT player % 2 AS team, sum(CASE WHEN toi > 0 THEN 3600.0 * clicks / toi * toi END) / sum(CASE WHEN toi > 0 THEN toi END) AS rate FROM t GROUP BY 1) SELECT team, round(rate, 6) AS rate FROM w""")
def weighted_rates(spark, sf_dir):
    """A team's rate as the mean of its players' rates weighted by time."""
    t = ice_time(spark, sf_dir).select((F.col("player") % 2).alias("team"), "toi", A.ratio(F.col("clicks"), F.col("toi"), 3600.0).alias("rate"))
    return t.groupBy("team").agg(F.round(A.weighted_mean("rate", "toi"), 6).alias("rate"))


@query(""", e AS (SELECT event_id, team, at_us FROM act WHERE action = 'error'), p AS (SELECT team, at_us, event_id FROM act WHERE action = 'purchase')
SELECT event_id, (SELECT arg_max(p.event_id, (p.at_us, p.event_id)) FROM p WHERE p.team = e.team AND p.at_us <= e.at_us) AS last FROM e""")
def asof_last(spark, sf_dir):
    """The last purchase of its team at or before each error."""
    a = actions(spark, sf_dir)
    e, p = a.filter("action = 'error'").select("event_id", "team", "at_us"), a.filter("action = 'purchase'").select("team", "at_us", F.col("event_id").alias("last"))
    return J.asof_backward(e, p, ["team"], "at_us", ["last"]).select("event_id", "last")


@query(""", s AS (SELECT *, CAST(floor(CAST(at_us - game * 86400000000 AS DOUBLE) / 1e6 / 24) AS BIGINT) AS sec FROM act) SELECT CAST(floor(greatest(sec, 0) / 1200) + 1 AS INTEGER) AS period, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def clock_periods(spark, sf_dir):
    """The period of game-clock seconds."""
    sec = F.floor((F.col("at_us") - F.col("game") * 86_400_000_000) / 1e6 / 24)
    return actions(spark, sf_dir).groupBy(rink.period_of(sec).alias("period")).agg(F.count("*").alias("n"))


def fuzzy_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, how``: entries of left (l, id, surname, jersey, seconds) matched with those of right (r and the same): by id, else by a
    surname that only one entry of right has, else by jersey with times within five seconds, if only one fits."""
    by_id = left.join(right.select("r", "id"), "id").select("l", "r", F.lit("id").alias("how"))
    rest = left.join(by_id, "l", "left_anti")
    single = right.groupBy("surname").agg(F.count("*").alias("n"), F.min("r").alias("r")).filter("n = 1")
    by_name = rest.join(single, "surname").select("l", "r", F.lit("surname").alias("how"))
    rest = rest.join(by_name, "l", "left_anti")
    near = rest.join(right.select("r", "jersey", F.col("seconds").alias("other")), "jersey").filter(F.abs(F.col("seconds") - F.col("other")) <= 5)
    by_jersey = near.groupBy("l").agg(F.count("*").alias("n"), F.min("r").alias("r")).filter("n = 1").select("l", "r", F.lit("jersey").alias("how"))
    return by_id.unionByName(by_name).unionByName(by_jersey)


@query(f""", {TOI}, x AS (SELECT player, 'NAME' || (player % 40) AS surname, player % 25 AS jersey, toi FROM t), r AS (SELECT player AS r, CASE WHEN player % 3 = 0 THEN player ELSE -player END AS id, surname, jersey, toi + player % 9 AS seconds FROM x WHERE player % 5 <> 0),
i AS (SELECT x.player AS l, r.r, 'id' AS how FROM x JOIN r ON x.player = r.id), u AS (SELECT surname, min(r) AS r FROM r GROUP BY surname HAVING count(*) = 1), n AS (SELECT x.player AS l, u.r, 'surname' AS how FROM x JOIN u USING (surname) WHERE x.player NOT IN (SELECT l FROM i)),
j AS (SELECT x.player AS l, min(r.r) AS r, 'jersey' AS how FROM x JOIN r ON x.jersey = r.jersey AND abs(x.toi - r.seconds) <= 5 WHERE x.player NOT IN (SELECT l FROM i UNION ALL SELECT l FROM n) GROUP BY x.player HAVING count(*) = 1)
SELECT * FROM i UNION ALL SELECT * FROM n UNION ALL SELECT * FROM j""")
def report_matches(spark, sf_dir):
    """Players of a report matched with those of the events: by id, by a surname of their own, by jersey and time."""
    x = ice_time(spark, sf_dir).select("player", F.concat(F.lit("NAME"), (F.col("player") % 40).cast("string")).alias("surname"), (F.col("player") % 25).alias("jersey"), "toi")
    left = x.select(F.col("player").alias("l"), F.col("player").alias("id"), "surname", "jersey", F.col("toi").alias("seconds"))
    right = x.filter("player % 5 <> 0").select(F.col("player").alias("r"), F.when(F.col("player") % 3 == 0, F.col("player")).otherwise(-F.col("player")).alias("id"), "surname", "jersey", (F.col("toi") + F.col("player") % 9).alias("seconds"))
    return fuzzy_match(left, right)
