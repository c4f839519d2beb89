"""A game from its event rows: running clock, shifts, goals with the players on the ice, box scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.operators import intervals as I

REGULATION_S = 1200


def stretches(events: DataFrame) -> DataFrame:
    """``file, period, start_ms, end_ms, scale, run_s``: when the clock ran, from all shifts of both teams.

    A regulation period within 30 seconds of 20 minutes is scaled to them.
    """
    s = I.interval_union(events.filter("action = 'All shifts'"), ["file", "period"], "start_ms", "end_ms")
    run = F.sum(F.col("end_ms") - F.col("start_ms")).over(Window.partitionBy("file", "period")) / 1000
    near = (F.col("period") <= 3) & (F.abs(run - REGULATION_S) <= 30)
    return s.select("file", "period", "start_ms", "end_ms", F.when(near, REGULATION_S / run).otherwise(1.0).alias("scale"), run.alias("run_s"))


def periods(events: DataFrame) -> DataFrame:
    """``file, period, length_s, before_s, irregular``: before_s is the game clock at the period's start."""
    p = stretches(events).groupBy("file", "period").agg((F.max("run_s") * F.max("scale")).alias("length_s"))
    earlier = Window.partitionBy("file").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.coalesce(F.sum(F.when(F.col("period") > 3, F.col("length_s")).otherwise(0.0)).over(earlier), F.lit(0.0))
    before = F.least(F.col("period") - 1, F.lit(3)) * REGULATION_S + extra
    return p.select("file", "period", "length_s", before.cast("double").alias("before_s"), (F.abs(F.col("length_s") - REGULATION_S) > 1).alias("irregular"))


def with_clock(events: DataFrame, moments: DataFrame, at: str = "at_ms") -> DataFrame:
    """Moments with ``clock_s``, the game clock."""
    s = stretches(events)
    run = I.run_clock(moments, s, ["file", "period"], at, "start_ms", "end_ms")
    scale = s.groupBy("file", "period").agg(F.max("scale").alias("_scale")).join(periods(events).select("file", "period", F.col("before_s").alias("_before")), ["file", "period"])
    return run.join(scale, ["file", "period"], "left").withColumn("clock_s", F.coalesce("_before", F.lit(0.0)) + F.col("clock") / 1000 * F.coalesce("_scale", F.lit(1.0))).drop("clock", "_scale", "_before")


#: How long before a goal the players on the ice are looked up, and the shortest stint, in seconds.
PROBE_S, SHORTEST_S = 0.25, 0.05
GOALIE_ACTIONS = ("Saves", "Shots against", "Goals against")


def on_clock(events: DataFrame) -> DataFrame:
    """Events with ``start_s, end_s, clock_s`` on the game clock (clock_s is the moment of a clip's middle)."""
    out = events
    for at, name in (("start_ms", "start_s"), ("end_ms", "end_s"), ("at_ms", "clock_s")):
        out = with_clock(events, out, at).withColumnRenamed("clock_s", name)
    return out


def goalies(rows: DataFrame) -> DataFrame:
    """``file, team, player_id`` of everyone with a goalkeeper's action."""
    return rows.filter(F.col("action").isin(*GOALIE_ACTIONS) & F.col("player_id").isNotNull()).select("file", "team", "player_id").distinct()


def shifts(rows: DataFrame, skaters_only: bool = False) -> DataFrame:
    """``file, team, player_id, period, start_s, end_s``: a player's shifts; less than a second apart they are one."""
    s = rows.filter("action = 'All shifts' and player_id is not null")
    if skaters_only:
        s = s.join(goalies(rows), ["file", "team", "player_id"], "left_anti")
    return I.interval_union(s, ["file", "team", "player_id", "period"], "start_s", "end_s", gap=1).drop("parts")


def advantages(rows: DataFrame) -> DataFrame:
    """``file, by, start_s, end_s``: power plays of each side; of a game's team file if it has any, else of the players' shifts.

    Spans of one side that lie less than a second apart are one.
    """
    spans = rows.filter(F.col("action").isin("Power play", "Power play shifts"))
    of_file = F.max(F.col("action") == "Power play").over(Window.partitionBy("file"))
    spans = spans.withColumn("_file", of_file).filter((F.col("action") == "Power play") == F.col("_file"))
    return I.interval_union(spans.withColumnRenamed("team", "by"), ["file", "by"], "start_s", "end_s", gap=1).drop("parts")


def with_strength(points: DataFrame, adv: DataFrame, at: str, side: str = "team") -> DataFrame:
    """Points (``file``, a side, a time; rows are distinct) with ``strength`` of the side: of the advantages that hold the
    time (start excluded) the first by start, a side's own before the other's; else Even.
    """
    a = adv.select("file", F.col("by").alias("_by"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    j = I.point_in_interval(points, a, ["file"], at, "_s", "_e", width=60, closed="right", how="left")
    first = F.min(F.when(F.col("_s").isNotNull(), F.struct("_s", (F.col("_by") != F.col(side)).alias("other"))))
    return j.groupBy(*points.columns).agg(first.alias("_a")).withColumn("strength", F.when(F.col("_a").isNull(), "Even").when(F.col("_a.other"), "ShortHanded").otherwise("PowerPlay")).drop("_a")


def skaters(rows: DataFrame) -> DataFrame:
    """``file, team, player_id, start_s, end_s``: when each skater is on, periods that overlap on the clock included once."""
    return I.interval_union(shifts(rows, True), ["file", "team", "player_id"], "start_s", "end_s").drop("parts")


def scores(rows: DataFrame) -> DataFrame:
    """Goals in order, a row for each side: ``file, period, row_no, by, player_id, clock_s, probe_s, team, scored, score_for,
    score_against, strength``; strength is that at probe_s, a quarter second before."""
    g = rows.filter("action = 'Goals'").select("file", "period", "row_no", F.col("team").alias("by"), "player_id", "clock_s", (F.col("clock_s") - PROBE_S).alias("probe_s"))
    sides = rows.select("file", "team").distinct()
    g = g.join(sides, "file").withColumn("scored", F.col("by") == F.col("team"))
    order = Window.partitionBy("file", "team").orderBy("clock_s", "row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("score_for", F.count_if("scored").over(order)).withColumn("score_against", F.count_if(~F.col("scored")).over(order))
    return with_strength(g, advantages(rows), "probe_s")


def goals(rows: DataFrame) -> DataFrame:
    """Goals as ``scores`` (without probe_s) with ``on_ice``, the skaters a quarter second before: a list for each goal and side, so where
    only their number or their plus-minus is wanted, take ``skater_counts`` or ``plus_minus_of``."""
    g = scores(rows)
    s = shifts(rows, True).select("file", "team", F.col("player_id").alias("on"), "start_s", "end_s")
    on = I.point_in_interval(g, s, ["file", "team"], "probe_s", "start_s", "end_s", width=60, closed="right", how="left")
    return on.groupBy(*[c for c in g.columns if c != "probe_s"]).agg(F.array_sort(F.collect_set("on")).alias("on_ice"))


def skater_counts(rows: DataFrame) -> DataFrame:
    """Goals as ``scores`` with ``skaters``, how many were on."""
    return I.holding(scores(rows), skaters(rows), ["file", "team"], "probe_s", "start_s", "end_s", "skaters")


def worth() -> Column:
    """What a goal counts for the skaters of a side: own power-play goals and goals against while short-handed don't."""
    return F.when(F.col("scored") & (F.col("strength") != "PowerPlay"), 1).when(~F.col("scored") & (F.col("strength") != "ShortHanded"), -1).otherwise(0)


def plus_minus(found: DataFrame) -> DataFrame:
    """``file, team, player_id, plus_minus`` of the skaters listed by ``goals``."""
    return found.select("file", "team", worth().alias("w"), F.explode("on_ice").alias("player_id")).groupBy("file", "team", "player_id").agg(F.sum("w").alias("plus_minus"))


def plus_minus_of(rows: DataFrame) -> DataFrame:
    """The same without lists: what goals come to by the end of each of a skater's shifts, less what they had come to at its start.
    Skaters who were on for no goal have no row."""
    g = scores(rows).select("file", "team", F.lit(None).cast(rows.schema["player_id"].dataType).alias("player_id"), F.col("probe_s").alias("t"), F.lit(0).alias("sign"), worth().alias("w"))
    mark = lambda c, sign: F.struct(F.col(c).alias("t"), F.lit(sign).alias("sign"))
    m = skaters(rows).select("file", "team", "player_id", F.explode(F.array(mark("start_s", -1), mark("end_s", 1))).alias("m")).select("file", "team", "player_id", "m.*", F.lit(None).cast("int").alias("w"))
    order = Window.partitionBy("file", "team").orderBy("t", F.col("w").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = g.unionByName(m).select("*", F.coalesce(F.sum("w").over(order), F.lit(0)).alias("sum"), F.count("w").over(order).alias("n")).filter("sign <> 0")
    return run.groupBy("file", "team", "player_id").agg(F.sum(F.col("sign") * F.col("sum")).alias("plus_minus"), F.sum(F.col("sign") * F.col("n")).alias("n")).filter("n > 0").drop("n")


def attempts(rows: DataFrame) -> DataFrame:
    """``file, team, row_no, clock_s, mine``: shots at even strength, a row for each side."""
    s = rows.filter("action = 'Shots'").select("file", "row_no", F.col("team").alias("by"), "clock_s")
    s = s.join(rows.select("file", "team").distinct(), "file")
    s = with_strength(s, advantages(rows), "clock_s").filter("strength = 'Even'")
    return s.select("file", "team", "row_no", "clock_s", (F.col("by") == F.col("team")).alias("mine"))


#: Field of a skater's box score and the action that it counts (fixed values).
COUNTS = {
    "goals": "Goals", "assists": "Assists", "shots": "Shots", "shots_on_goal": "Shots on goal", "hits": "Hits", "faceoffs": "Faceoffs", "faceoffs_won": "Faceoffs won",
    "blocked_shots": "Shots blocking", "puck_battles": "Puck battles", "puck_battles_won": "Puck battles won", "puck_losses": "Puck losses", "puck_recoveries": "Puck recoveries",
    "entries": "Entries", "passes": "Accurate passes", "puck_losses_dz": "Puck losses in DZ", "puck_recoveries_oz": "Puck recoveries in OZ",
    "entries_pass": "Entries via pass", "entries_carry": "Entries via stickhandling", "entries_dump": "Entries via dump in",
}
#: Tally and the actions whose common moments it counts.
TALLIES = {"faceoffs_dz": ("Faceoffs in DZ", "Faceoffs won"), "faceoffs_oz": ("Faceoffs in OZ", "Faceoffs won"), "pp_shots": ("Power play shots", "Shots on goal"), "sh_shots": ("Short-handed shots", "Shots on goal")}
PENALTY_S = 120


def box(rows: DataFrame) -> DataFrame:
    """``file, team, player_id`` with all counts of a skater: COUNTS, TALLIES (and of them ``_won``), times in milliseconds,
    shifts, penalty seconds, plus-minus, and the even-strength attempts of both sides during their shifts.
    """
    by = ["file", "team", "player_id"]
    mine = rows.filter("player_id is not null").join(goalies(rows), by, "left_anti")
    names = F.col("action")
    length = lambda name: F.sum(F.when(names == name, F.col("end_ms") - F.col("start_ms")).otherwise(0))
    counts = mine.groupBy(*by).agg(
        *[F.count_if(names == a).alias(n) for n, a in COUNTS.items()], length("All shifts").alias("toi_ms"), length("Power play shifts").alias("pp_ms"), length("Penalty kill shifts").alias("sh_ms"),
        (F.count_if(names == "Penalties") * PENALTY_S).alias("penalty_s"),
    )
    moments = mine.filter("kind = 'moment'").groupBy(*by, "at_ms", "period").agg(*[x for n, (a, b) in TALLIES.items() for x in (F.count_if(names == a).alias(n), F.max(names == b).alias(f"{n}_b"))])
    tallies = moments.groupBy(*by).agg(*[x for n in TALLIES for x in (F.sum(n).alias(n), F.sum(F.when(F.col(f"{n}_b"), F.col(n)).otherwise(0)).alias(f"{n}_won"))])
    own = shifts(rows, True)
    on = I.point_in_interval(attempts(rows), own.select("file", "team", "player_id", "start_s", "end_s"), ["file", "team"], "clock_s", "start_s", "end_s", width=60, closed="right")
    corsi = on.groupBy(*by).agg(F.count_if("mine").alias("corsi_for"), F.count_if(~F.col("mine")).alias("corsi_against"))
    n = own.groupBy(*by).agg(F.count("*").alias("shifts"))
    out = counts.join(tallies, by, "left").join(n, by, "left").join(corsi, by, "left").join(plus_minus_of(rows), by, "left")
    return out.na.fill(0)


def goalie_box(rows: DataFrame) -> DataFrame:
    """``file, team, player_id``: a goalkeeper's time, shots against, saves, goals against, and shots faced and stopped at even
    strength and short-handed (by the save at the same moment)."""
    by = ["file", "team", "player_id"]
    g = goalies(rows)
    mine = rows.join(g, by, "left_semi")
    names = F.col("action")
    total = mine.groupBy(*by).agg(
        F.sum(F.when(names == "All shifts", F.col("end_ms") - F.col("start_ms")).otherwise(0)).alias("toi_ms"), F.count_if(names == "Shots against").alias("shots_against"),
        F.count_if(names == "Saves").alias("saves"), F.count_if(names == "Goals against").alias("goals_against"),
    )
    saved = F.max(names == "Saves").over(Window.partitionBy(*by, "period", "at_ms"))
    faced = mine.filter("kind = 'moment'").withColumn("saved", saved).filter("action = 'Shots against'").select(*by, "row_no", "clock_s", "saved")
    faced = with_strength(faced, advantages(rows), "clock_s")
    split = faced.groupBy(*by).agg(*[x for s, n in (("Even", "ev"), ("ShortHanded", "sh")) for x in (F.count_if(F.col("strength") == s).alias(f"{n}_faced"), F.count_if((F.col("strength") == s) & F.col("saved")).alias(f"{n}_saved"))])
    return total.join(split, by, "left").na.fill(0)


def cut_at(rows: DataFrame, ends: bool) -> DataFrame:
    """``file, team, a, b``: a side's time cut at its skaters' shifts and at all man advantages; with ends, also at the start, at
    period ends and at the game's end, else only at the game's end."""
    s, adv = shifts(rows, True), advantages(rows)
    sides = rows.select("file", "team").distinct()
    whole = rows.groupBy("file").agg(F.max(F.when(F.col("kind") == "span", F.col("end_s"))).alias("length"), F.max("period").alias("last"))
    length = F.greatest(F.when(F.col("last") >= 3, F.lit(3 * REGULATION_S)).otherwise(F.col("last") * REGULATION_S), F.col("length")).cast("double")
    marks = [length] + ([F.lit(0.0)] if ends else [])
    cuts = s.select("file", "team", F.explode(F.array("start_s", "end_s")).alias("a"))
    cuts = cuts.unionByName(adv.select("file", F.explode(F.array("start_s", "end_s")).alias("a")).join(sides, "file").select("file", "team", "a"))
    cuts = cuts.unionByName(whole.select("file", F.explode(F.array(*marks)).alias("a")).join(sides, "file").select("file", "team", "a"))
    if ends:
        breaks = F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: (i * REGULATION_S).cast("double")), lambda x: x < length)
        cuts = cuts.unionByName(whole.select("file", F.explode(breaks).alias("a")).join(sides, "file").select("file", "team", "a"))
    order = Window.partitionBy("file", "team").orderBy("a")
    return cuts.distinct().withColumn("b", F.lead("a").over(order)).filter(F.col("b") - F.col("a") > SHORTEST_S)


def stints(rows: DataFrame) -> DataFrame:
    """``file, team, a, b, strength, players, goals_for, goals_against``: spans in which neither a side's skaters nor the strength
    change; goals belong to the stint that holds the time a quarter second before them."""
    cuts = cut_at(rows, True).withColumn("mid", (F.col("a") + F.col("b")) / 2)
    s = shifts(rows, True).select("file", "team", "player_id", "start_s", "end_s")
    who = I.point_in_interval(with_strength(cuts, advantages(rows), "mid"), s, ["file", "team"], "mid", "start_s", "end_s", width=60, how="left")
    st = who.groupBy("file", "team", "a", "b", "strength").agg(F.array_sort(F.collect_set("player_id")).alias("players"))
    g = goals(rows).select("file", "team", "scored", "row_no", (F.col("clock_s") - PROBE_S).alias("at"))
    hit = I.point_in_interval(g, st.select("file", "team", "a", "b"), ["file", "team"], "at", "a", "b", width=60)
    n = hit.groupBy("file", "team", "a").agg(F.count_if("scored").alias("goals_for"), F.count_if(~F.col("scored")).alias("goals_against"))
    return st.join(n, ["file", "team", "a"], "left").na.fill(0, ["goals_for", "goals_against"])


def groups_on_ice(players: Column, defence: Column, strength: Column) -> Column:
    """The units that skaters form, as (kind, members): at even strength two defenders a pair, three forwards a line, both a full
    unit; else all are a power-play or a penalty-killing unit. defence: those of players who are defenders."""
    forwards = F.array_except(players, defence)
    pair, line = F.size(defence) == 2, F.size(forwards) == 3
    unit = lambda kind, members: F.struct(F.lit(kind).alias("kind"), members.alias("members"))
    even = F.array(F.when(pair & line, unit("FullUnit", players)), F.when(pair, unit("DefencePair", defence)), F.when(line, unit("ForwardLine", forwards)))
    special = F.array(F.when(F.size(players) > 0, F.when(strength == "PowerPlay", unit("PowerPlay", players)).otherwise(unit("PenaltyKill", players))))
    return F.array_compact(F.when(strength == "Even", even).otherwise(special))


def units(rows: DataFrame, defenders: DataFrame) -> DataFrame:
    """``file, team, kind, members, seconds, goals_for, goals_against, corsi_for, corsi_against``. defenders: distinct player_id."""
    cuts = cut_at(rows, False).withColumn("mid", (F.col("a") + F.col("b")) / 2)
    s = shifts(rows, True).join(defenders.withColumn("d", F.lit(True)), "player_id", "left").select("file", "team", "player_id", "d", "start_s", "end_s")
    who = I.point_in_interval(with_strength(cuts, advantages(rows), "mid"), s, ["file", "team"], "mid", "start_s", "end_s", width=60, closed="right")
    st = who.groupBy("file", "team", "a", "b", "strength").agg(F.array_sort(F.collect_set("player_id")).alias("players"), F.array_sort(F.collect_set(F.when(F.col("d"), F.col("player_id")))).alias("defence"))
    shots = attempts(rows).select("file", "team", F.lit("corsi").alias("what"), "mine", "row_no", F.col("clock_s").alias("at"))
    events = shots.unionByName(goals(rows).select("file", "team", F.lit("goals").alias("what"), F.col("scored").alias("mine"), "row_no", (F.col("clock_s") - PROBE_S).alias("at")))
    hit = I.point_in_interval(events, st.select("file", "team", "a", "b"), ["file", "team"], "at", "a", "b", width=60, closed="right")
    counts = [F.count_if((F.col("what") == w) & (F.col("mine") == m)).alias(f"{w}_{n}") for w in ("goals", "corsi") for m, n in ((True, "for"), (False, "against"))]
    st = st.join(hit.groupBy("file", "team", "a").agg(*counts), ["file", "team", "a"], "left").na.fill(0)
    u = st.select("*", F.explode(groups_on_ice(F.col("players"), F.col("defence"), F.col("strength"))).alias("u"))
    sums = [F.sum(c).alias(c) for c in ("goals_for", "goals_against", "corsi_for", "corsi_against")]
    return u.groupBy("file", "team", "u.kind", "u.members").agg(F.sum(F.col("b") - F.col("a")).alias("seconds"), *sums)


def team_summary(rows: DataFrame) -> DataFrame:
    """``file, team``: shots, those on goal and goals (by the moments of the shots) in all, by period, at even strength and on the
    power play; faceoffs won by zone; power plays, their seconds and goals; recoveries from the team file where a game has one."""
    by = ["file", "team"]
    names = F.col("action")
    moments = Window.partitionBy("file", "team", "period", "at_ms")
    m = rows.filter("kind = 'moment'").withColumn("on_goal", F.max(names == "Shots on goal").over(moments)).withColumn("goal", F.max(names == "Goals").over(moments)).withColumn("won", F.max(names == "Faceoffs won").over(moments))
    shots = with_strength(m.filter("action = 'Shots'").select(*by, "row_no", "period", "clock_s", "on_goal", "goal"), advantages(rows), "clock_s")
    places = {"p1": F.col("period") == 1, "p2": F.col("period") == 2, "p3": F.col("period") == 3, "even": F.col("strength") == "Even", "pp": F.col("strength") == "PowerPlay"}
    t = shots.groupBy(*by).agg(F.count("*").alias("shots"), *[F.count_if(w & c).alias(f"{k}_{n}") for n, w in places.items() for k, c in (("shots", F.lit(True)), ("on_goal", F.col("on_goal")), ("goals", F.col("goal")))])
    f = m.groupBy(*by).agg(*[F.count_if((names == f"Faceoffs in {z}") & F.col("won")).alias(f"faceoffs_won_{z.lower()}") for z in ("DZ", "NZ", "OZ")], *[F.count_if(names == a).alias(n) for n, a in (("hits", "Hits"), ("penalties", "Penalties"), ("battles_won", "Puck battles won"), ("entries_pass", "Entries via pass"), ("entries_carry", "Entries via stickhandling"), ("losses", "Puck losses"), ("recoveries", "Puck recoveries"), ("recoveries_oz", "Puck recoveries in OZ"))])
    pp = advantages(rows).groupBy("file", F.col("by").alias("team")).agg(F.count("*").alias("power_plays"), F.sum(F.col("end_s") - F.col("start_s")).alias("pp_seconds"))
    g = goals(rows).filter("scored").groupBy(*by).agg(F.count_if(F.col("strength") == "PowerPlay").alias("pp_goals_scored"))
    return t.join(f, by, "full").join(pp, by, "left").join(g, by, "left").na.fill(0)
