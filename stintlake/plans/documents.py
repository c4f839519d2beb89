"""Stored files and printed pages: queries on files made of orders and on words laid out from names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.plans.adapter import table
from stintlake.sources import layout as L
from stintlake.sources import library as S
from stintlake.sources.event_csv import HEADER

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A file of each order: teams, score, day, kind, and the order in which it arrives.
FILES = """fl AS (SELECT o_orderkey AS file, 'TEAM ' || (o_custkey % 20) AS team_a, 'SIDE ' || (o_custkey % 3) AS team_b, CAST(o_custkey % 4 AS INTEGER) AS goals_a, CAST(o_custkey % 2 AS INTEGER) AS goals_b, CAST(o_orderdate AS DATE) AS day,
 CASE o_orderkey % 5 WHEN 0 THEN 'match report' WHEN 1 THEN 'player report' WHEN 2 THEN 'team' ELSE 'players' END AS kind, (o_orderkey * 7919) % 100003 AS arrived FROM orders)"""
SAME = f"""{FILES}, dy AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b, goals_a, goals_b ORDER BY arrived, file) AS n FROM fl
 QUALIFY row_number() OVER (PARTITION BY team_a, team_b, goals_a, goals_b, day ORDER BY arrived, file) = 1),
d1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY team_a, team_b, goals_a, goals_b ORDER BY n) AS m FROM dy),
st AS (SELECT team_a, team_b, goals_a, goals_b, 0 AS m, CAST([] AS DATE[]) AS days FROM d1 WHERE m = 1
 UNION ALL SELECT st.team_a, st.team_b, st.goals_a, st.goals_b, st.m + 1, CASE WHEN len(list_filter(days, lambda x: abs(date_diff('day', x, d1.day)) <= 1)) > 0 THEN days ELSE list_append(days, d1.day) END
 FROM st JOIN d1 ON d1.team_a = st.team_a AND d1.team_b = st.team_b AND d1.goals_a = st.goals_a AND d1.goals_b = st.goals_b AND d1.m = st.m + 1),
kd AS (SELECT team_a, team_b, goals_a, goals_b, arg_max(days, m) AS days FROM st GROUP BY ALL),
f3 AS (SELECT fl.*, list_filter(days, lambda x: abs(date_diff('day', x, fl.day)) <= 1)[1] AS game_day FROM fl JOIN kd USING (team_a, team_b, goals_a, goals_b))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "orders"))


def as_files(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 5 == 0, "match report").when(k % 5 == 1, "player report").when(k % 5 == 2, "team").otherwise("players")
    return orders.select(
        k.alias("file"), F.concat(F.lit("TEAM "), (c % 20).cast("string")).alias("team_a"), F.concat(F.lit("SIDE "), (c % 3).cast("string")).alias("team_b"), (c % 4).cast("int").alias("goals_a"), (c % 2).cast("int").alias("goals_b"),
        F.to_date("o_orderdate").alias("day"), kind.alias("kind"), (k * 7919 % 100003).alias("arrived"),
    )


@query(f"WITH RECURSIVE {SAME} SELECT file, strftime(game_day, '%Y-%m-%d') AS game_day FROM f3")
def same_games(spark, sf_dir):
    """The game of each file: same teams and score, its day a day from the game's first at most."""
    return S.same_games(files(spark, sf_dir)).select("file", F.date_format("game_day", "yyyy-MM-dd").alias("game_day"))


@query(f"""WITH RECURSIVE {SAME}, p AS (SELECT *, coalesce(bool_or(kind = 'players') OVER (PARTITION BY team_a, team_b, goals_a, goals_b, game_day ORDER BY arrived, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS built, count(*) OVER (PARTITION BY team_a, team_b, goals_a, goals_b, game_day, kind ORDER BY arrived, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS again FROM f3)
SELECT file, CASE WHEN again > 0 THEN 'AlreadyLoaded' WHEN built THEN 'GameUpdated' WHEN kind = 'players' THEN 'GameAdded' ELSE 'Waiting' END AS state FROM p""")
def file_arrivals(spark, sf_dir):
    """What each arriving file does to its game."""
    return S.arrivals(files(spark, sf_dir)).select("file", "state")


_NAME = "CASE WHEN kind IN ('players', 'team') THEN team_a || ' ' || goals_a || ' _ ' || goals_b || ' ' || team_b || ' ' || strftime(day, '%d.%m.%Y') || CASE WHEN kind = 'team' THEN '-2' ELSE '' END || '.csv' ELSE strftime(day, '%Y-%m-%d') || '_' || regexp_replace(lower(team_a), '[^a-z0-9]', '-', 'g') || '_' || goals_a || '-' || goals_b || '_' || regexp_replace(lower(team_b), '[^a-z0-9]', '-', 'g') || CASE WHEN kind = 'match report' THEN '_match.pdf' ELSE '_players.pdf' END END"


def named(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).withColumn("stored", S.stored_name(*[F.col(c) for c in ("team_a", "goals_a", "goals_b", "team_b", "day", "kind")]))


@query(f"WITH {FILES}, n AS (SELECT *, {_NAME} AS stored FROM fl) SELECT file, stored FROM n WHERE file % 3 <> 0 AND stored NOT IN (SELECT stored FROM n WHERE file % 3 = 0) QUALIFY row_number() OVER (PARTITION BY stored ORDER BY arrived, file) = 1")
def kept_files(spark, sf_dir):
    """New files under their canonical names, those that are kept already left out."""
    n = named(spark, sf_dir)
    return S.new_files(n.filter("file % 3 <> 0"), n.filter("file % 3 = 0")).select("file", "stored")


@query("SELECT o_orderkey AS file FROM orders WHERE NOT (o_orderkey % 4 = 1 AND o_custkey % 3 <> 0)")
def orphan_files(spark, sf_dir):
    """Files to be read again: of no entry, or of one of an older version."""
    o = table(spark, sf_dir, "orders")
    entries = o.filter("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("file"), F.when(F.col("o_custkey") % 3 != 0, S.VERSION).otherwise(0).alias("version"))
    return S.orphans(o.select(F.col("o_orderkey").alias("file")), entries)


@query("SELECT o_orderkey AS file, CASE o_orderkey % 5 WHEN 0 THEN 'events' WHEN 1 THEN 'events' WHEN 2 THEN 'refused' WHEN 3 THEN 'match report' ELSE 'unknown' END AS kind FROM orders")
def sniffed_kinds(spark, sf_dir):
    """Kinds of files by their first characters and names."""
    k = F.col("o_orderkey") % 5
    head = F.when(k == 0, HEADER + "\n1,2").when(k == 1, "﻿" + HEADER).when(k == 3, "MATCH REPORT 12").otherwise("<xml>")
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(k == 2, ".XML").otherwise(".csv"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), S.kind_of(head, name).alias("kind"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"' || CASE WHEN n_nationkey % 2 = 0 THEN ',\"n_regionkey\":' || n_regionkey ELSE '' END || '}' AS json FROM nation")
def report_rows(spark, sf_dir):
    """A report's rows as JSON; missing values are left out."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"))
    return S.report_json(n, ["n_nationkey"]).select("n_nationkey", "json")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 1 OR c_custkey % 3 = 0")
def upserted(spark, sf_dir):
    """A stored table after new rows have come for a third of its keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return S.upsert(c.filter("c_custkey % 7 <> 1"), c.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("NEW")), ["c_custkey"])


#: Names of parts as printed lines: fifty to a page, twelve points apart, words in columns sixty points wide with small shifts.
PAGE = ["page"]
WORDS = """pw AS (SELECT p_partkey // 50 AS page, p_partkey AS k, string_split(p_name, ' ') AS ws, p_name FROM part), ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS INTEGER) AS line FROM pw),
wd AS (SELECT page, k, line, j, ws[j + 1] AS text, 40 + 60 * j + (k % 3) * 0.5::DOUBLE AS x0, 40 + 60 * j + (k % 3) * 0.5 + 8 * length(ws[j + 1])::DOUBLE AS x1, 20 + 12 * (k % 50) + (j % 3) * 0.6::DOUBLE AS mid FROM (SELECT *, unnest(range(0, len(ws))) AS j FROM ln))"""


def words(spark, sf_dir) -> DataFrame:
    k, j = F.col("p_partkey"), F.col("j")
    w = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("j", "text"))
    x0, mid = 40 + 60 * j + (k % 3) * 0.5, 20 + 12 * (k % 50) + (j % 3) * 0.6
    return w.select(F.floor(k / 50).alias("page"), "text", x0.alias("x0"), (x0 + 8 * F.length("text")).alias("x1"), (mid - 4).alias("top"), (mid + 4).alias("bottom"))


def lines(spark, sf_dir) -> DataFrame:
    return L.with_lines(words(spark, sf_dir), PAGE)


@query(f"WITH {WORDS} SELECT page, line, p_name AS text, round(20 + 12 * (k % 50), 3)::DOUBLE AS y FROM ln")
def page_lines(spark, sf_dir):
    """Words put into lines."""
    return lines(spark, sf_dir).groupBy("page", "line").agg(L.joined_text().alias("text"), F.round(F.max("y"), 3).alias("y"))


@query(f"WITH {WORDS} SELECT page, CAST(count(*) AS BIGINT) AS n FROM wd WHERE x0 >= 90 AND x0 < 170 AND mid >= 100 AND mid < 300.5 GROUP BY page")
def boxed_words(spark, sf_dir):
    """Words in a box of each page."""
    return L.words_in(words(spark, sf_dir), 90, 170, 100, 300.5).groupBy("page").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT page, line, string_agg(text, ' ' ORDER BY x0) AS text FROM wd WHERE x0 >= 95 AND x0 < 165 GROUP BY page, line")
def line_parts(spark, sf_dir):
    """The text between two edges of each line."""
    return L.text_between(lines(spark, sf_dir), PAGE, 95, 165)


@query(f"WITH {WORDS} SELECT a.page, a.line, min(a.x0) AS x0 FROM wd a JOIN wd b ON a.k = b.k AND b.j = a.j + 1 WHERE a.text = 'cold' AND b.text = 'widget' OR a.text = 'Cold' AND b.text = 'Widget' GROUP BY a.page, a.line")
def phrase_places(spark, sf_dir):
    """Where a phrase of two words stands, in either case."""
    l = lines(spark, sf_dir).withColumn("text", F.when(F.col("text").isin("Cold", "Widget"), F.lower("text")).otherwise(F.col("text")))
    return L.find_phrase(l, PAGE, "cold widget")


HEADS = f"""{WORDS}, hp AS (SELECT *, sum(f) OVER (PARTITION BY page, line ORDER BY j ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY j) <= 2 THEN 0 ELSE 1 END AS f FROM wd WHERE line < 2)),
ph AS (SELECT page, line, p, min(x0) AS x, min(j) AS j, string_agg(text, ' ' ORDER BY x0) AS name FROM hp GROUP BY page, line, p), hc AS (SELECT page, j, arg_min(x, line) AS x, string_agg(name, ' ' ORDER BY line) AS name FROM ph GROUP BY page, j)"""


@query(f"WITH {HEADS} SELECT page, x, name FROM hc")
def page_columns(spark, sf_dir):
    """Columns from the first two lines of each page."""
    return L.header_columns(lines(spark, sf_dir).filter("line < 2"), PAGE).select("page", "x", "name")


@query(f"WITH {HEADS}, ce AS (SELECT page, x - 3 AS a, coalesce(lead(x) OVER (PARTITION BY page ORDER BY x) - 3, 1e9) AS b, name FROM hc) SELECT wd.page, wd.line, ce.name, string_agg(text, ' ' ORDER BY x0) AS text FROM wd JOIN ce ON ce.page = wd.page AND x0 >= a AND x0 < b WHERE line >= 2 GROUP BY wd.page, wd.line, ce.name, ce.a")
def page_cells(spark, sf_dir):
    """The cells of each line below the header."""
    l = lines(spark, sf_dir)
    return L.cells(l.filter("line >= 2"), L.header_columns(l.filter("line < 2"), PAGE), PAGE).select("page", "line", "name", "text")


#: A table of players of every twenty suppliers: title, a header of two lines, a row each, and a total that ends it.
def stat_words(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / 20).alias("page"))
    word = lambda t, x, y: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), y.cast("double").alias("y"))
    k = F.col("s_suppkey")
    row = F.array(*[word(t, x, 100 + 12 * (k % 20)) for t, x in (((k % 97).cast("string"), 20), (F.lit("Van"), 40), (F.concat(F.lit("Name"), k.cast("string")), 70), (F.concat((k % 20 + 10).cast("string"), F.lit(":05")), 200), ((k % 6).cast("string"), 300))])
    fixed = F.array(*[word(F.lit(t), x, F.lit(y)) for t, x, y in (("TITLE", 20, 50), ("Time", 200, 70), ("on", 226, 70), ("ice", 236, 70), ("Goals", 300, 70), ("min", 200, 80), ("TOTAL", 20, 340), ("99", 300, 340), ("7", 20, 352), ("Late", 40, 352))])
    w = s.select("page", F.explode(row).alias("w")).unionByName(s.select("page").distinct().select("page", F.explode(fixed).alias("w")))
    return w.select("page", "w.text", "w.x0", (F.col("w.x0") + 8 * F.length("w.text")).alias("x1"), (F.col("w.y") - 4).alias("top"), (F.col("w.y") + 4).alias("bottom"))


@query("SELECT s_suppkey // 20 AS page, CAST(s_suppkey % 97 AS INTEGER) AS number, 'Van Name' || s_suppkey AS surname, CAST((s_suppkey % 20 + 10) * 60 + 5 AS DOUBLE) AS toi, CAST(s_suppkey % 6 AS DOUBLE) AS goals FROM supplier")
def printed_players(spark, sf_dir):
    """A printed table of players read back: labels, times, goals."""
    t = L.player_table(stat_words(spark, sf_dir), PAGE, 0, 500, 50)
    cell = lambda name, what: F.max(F.when(F.col("name").startswith(name), T.cell_as(T.cell(F.col("text")), what)))
    r = t.groupBy("page", "line", "label").agg(cell("Time on ice", "seconds").alias("toi"), cell("Goals", "count").alias("goals"))
    return r.withColumn("l", L.row_label(F.col("label"))).select("page", "l.number", "l.surname", "toi", "goals")


@query("SELECT s_suppkey, CAST(s_suppkey % 99 AS INTEGER) AS number, 'Brooks' AS surname FROM supplier UNION ALL SELECT s_suppkey, CAST(s_suppkey % 50 + 1 AS INTEGER), 'Van Horn' FROM supplier")
def printed_members(spark, sf_dir):
    """The players named in a unit's label."""
    k = F.col("s_suppkey")
    label = F.concat_ws(" ", (k % 99).cast("string"), F.lit("Brooks"), (k % 50 + 1).cast("string"), F.lit("Van  Horn"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(L.members(label)).alias("m")).select("s_suppkey", "m.number", "m.surname")


@query("""WITH u AS (SELECT s_suppkey AS k, 'DefencePair' AS kind, (k % 20 + 10) * 60 + 5 AS sec FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)), m AS (SELECT CAST(k % 9 AS INTEGER) AS number, 'Brooks' AS surname, kind, sec FROM u UNION ALL SELECT CAST(k % 5 + 10 AS INTEGER), 'Van Horn', kind, sec FROM u)
SELECT number, surname, kind, CAST(sum(sec) AS DOUBLE) AS toi FROM m GROUP BY ALL""")
def listed_players(spark, sf_dir):
    """Players by position with the time of all units that list them."""
    k = F.col("s_suppkey")
    label = F.concat_ws(" ", (k % 9).cast("string"), F.lit("Brooks"), (k % 5 + 10).cast("string"), F.lit("Van Horn"))
    time = F.concat((k % 20 + 10).cast("string"), F.lit(":05"))
    u = table(spark, sf_dir, "supplier").select(F.lit("DefencePair").alias("kind"), L.members(label).alias("m"), T.cell_as(T.cell(time), "seconds").alias("toi"))
    return u.select("kind", "toi", F.explode("m").alias("m")).groupBy("m.number", "m.surname", "kind").agg(F.sum("toi").alias("toi"))


GRID = "SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS value, ((l_orderkey + l_linenumber * 3) % 5) * 10 + l_linenumber + l_partkey / 1e6 AS x, ((l_orderkey * 3 + l_linenumber * 7) % 11) * 10 + l_linenumber + l_partkey / 1e6 AS y FROM lineitem"


@query(f"""WITH c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY y, x) AS down FROM ({GRID})) WHERE n = 7), d AS (SELECT *, down <= 4 AS upper, row_number() OVER (PARTITION BY k, down <= 4 ORDER BY x) AS j FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY k, upper AND j IN (2, 3) ORDER BY y, j) AS high FROM d)
SELECT k, CASE WHEN upper AND j IN (2, 3) THEN CASE WHEN high = 1 THEN 'Slot' ELSE 'Center' END WHEN upper THEN CASE WHEN j = 1 THEN 'LeftFlank' ELSE 'RightFlank' END ELSE ['BlueLineLeft', 'BlueLineCenter', 'BlueLineRight'][j] END AS area, value FROM e""")
def zone_diagrams(spark, sf_dir):
    """Diagrams of seven counts put on the zones of the rink. Lines with the same numbers and part lie at one place: they count in the order
    of the table, which the SQL leaves open."""
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    c = table(spark, sf_dir, "lineitem").select(k.alias("k"), F.col("l_quantity").alias("value"), (((k + i * 3) % 5) * 10 + i + F.col("l_partkey") / 1e6).alias("x"), (((k * 3 + i * 7) % 11) * 10 + i + F.col("l_partkey") / 1e6).alias("y"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return L.grid(c, ["k"], "zone", ("file", "place"))


@query("""WITH c AS (SELECT p_partkey // 9 AS k, p_size AS value, p_partkey % 9 AS i, count(*) OVER (PARTITION BY p_partkey // 9) AS n FROM part) SELECT k, ['TopLeft', 'Top', 'TopRight', 'MiddleLeft', 'Middle', 'MiddleRight', 'BottomLeft', 'Bottom', 'BottomRight'][i + 1] AS area, value FROM c WHERE n = 9""")
def net_diagrams(spark, sf_dir):
    """Diagrams of nine counts put on the areas of the net."""
    i = F.col("p_partkey") % 9
    c = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 9).alias("k"), F.col("p_size").alias("value"), (i % 3 * 20).cast("double").alias("x"), (F.floor(i / 3) * 20 + i % 3).cast("double").alias("y"))
    return L.grid(c, ["k"], "net")


@query("""WITH d AS (SELECT DISTINCT p_partkey // 40 AS page, i AS row, (i * 15 + i % 3 * 2)::DOUBLE AS y FROM part, (SELECT unnest(range(0, 8)) AS i)), w AS (SELECT p_partkey // 40 AS page, p_partkey AS x0, p_brand AS text, (p_partkey % 40 * 3)::DOUBLE AS y FROM part),
n AS (SELECT w.*, d.row, abs(w.y - d.y) AS far FROM w JOIN d USING (page) QUALIFY row_number() OVER (PARTITION BY w.x0 ORDER BY abs(w.y - d.y), d.y DESC) = 1)
SELECT page, row, string_agg(text, ' ' ORDER BY y, x0) AS text FROM n WHERE far < 7 GROUP BY page, row""")
def nearest_rows(spark, sf_dir):
    """Words given to the nearest dated row of their page."""
    p = table(spark, sf_dir, "part")
    page, k = F.floor(F.col("p_partkey") / 40), F.col("p_partkey")
    w = p.select(page.alias("page"), k.cast("double").alias("x0"), F.col("p_brand").alias("text"), (k % 40 * 3).cast("double").alias("y"))
    i = F.col("row")
    d = p.select(page.alias("page")).distinct().select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("row")).withColumn("y", (i * 15 + i % 3 * 2).cast("double"))
    return L.nearest_row(w, d, PAGE)


@query("SELECT o_orderkey AS page, 'LIONS ' || (o_custkey % 9) AS team_a, CAST(o_orderkey % 7 AS INTEGER) AS goals_a, CAST(o_orderkey % 5 AS INTEGER) AS goals_b, 'NORTH STARS' AS team_b, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders")
def report_covers(spark, sf_dir):
    """Teams, score and date read from the covers of match reports."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = lambda t, x, y: F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y"))
    score = F.concat((k % 7).cast("string"), F.lit(":"), (k % 5).cast("string"))
    w = F.array(word(F.lit("MATCH"), 20, 20), word(F.lit("REPORT"), 80, 20), word(F.lit("Lions"), 20, 60), word((c % 9).cast("string"), 70, 60.5), word(score, 100, 60), word(F.lit("North"), 140, 60), word(F.lit("Stars"), 190, 60.8), word(F.date_format("o_orderdate", "dd.MM.yyyy."), 20, 90), word(F.lit("20:15"), 120, 90))
    o = table(spark, sf_dir, "orders").select(k.alias("page"), F.explode(w).alias("w"))
    o = o.select("page", "w.text", "w.x0", (F.col("w.x0") + 8 * F.length("w.text")).alias("x1"), (F.col("w.y") - 4).alias("top"), (F.col("w.y") + 4).alias("bottom"))
    return L.cover(L.with_lines(o, PAGE), PAGE).select("page", "team_a", "goals_a", "goals_b", "team_b", F.date_format("day", "yyyy-MM-dd").alias("day"))
