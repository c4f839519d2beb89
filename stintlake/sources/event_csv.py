"""Event exports: one CSV file a game, one row an action or a span of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.functions.rink import to_feet

#: The header of an export (fixed value).
HEADER = "ID,start,end,duration,pos_x,pos_y,player,team,action,half"
#: Actions that are spans besides those whose names end in " shifts" (fixed values).
SPANS = ("Power play", "Short-handed", "Controlled breakouts")


def is_span(action: Column) -> Column:
    return action.endswith(" shifts") | action.isin(*SPANS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all exports under ``path``: file, row_no, kind (span or moment), start_ms, end_ms, at_ms, along, across, player, player_id, team, action, period.

    Lines are split at commas without quoting. A moment is the whole-number middle of its clip. A row is an error, at the
    time it is read and whichever columns are, if it hasn't ten columns, lacks both start and end, ends before it starts or has
    a time of another form.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"), F.regexp_replace("value", "^\\uFEFF", "").alias("line"))
    c = F.split("line", ",", -1)
    rows = lines.filter((F.trim("line") != "") & (F.col("line") != HEADER)).select("file", "row_no", "line", c.alias("c"))
    part = lambda i: F.nullif(F.trim(F.get("c", F.lit(i))), F.lit(""))
    start, end, length = (T.video_ms(part(i)) for i in (1, 2, 3))
    timed = [part(i).isNull() | T.video_ms(part(i)).isNotNull() for i in (1, 2, 3)]
    r = rows.select("file", "row_no", "line", F.size("c").alias("n"), (timed[0] & timed[1] & timed[2]).alias("timed"), F.coalesce(start, end - length).alias("start_ms"), F.coalesce(end, start + length).alias("end_ms"), part(4).cast("double").alias("x"), part(5).cast("double").alias("y"), part(6).alias("player"), T.normalise_name(part(7)).alias("team"), part(8).alias("action"), part(9).cast("int").alias("period"))
    good = (F.col("n") == 10) & F.col("timed") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms")) & F.col("team").isNotNull() & F.col("action").isNotNull() & F.col("period").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not an event row: "), F.col("line"))).cast("boolean")
    r = r.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(wrong))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    along, across = to_feet(F.col("x"), F.col("y"))
    return r.select(
        "file", "row_no", F.when(is_span(F.col("action")), "span").otherwise("moment").alias("kind"), "start_ms", "end_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"),
        F.when(placed, along).alias("along"), F.when(placed, across).alias("across"), "player", F.when(F.col("player").isNotNull(), T.player_id(F.col("team"), F.col("player"))).alias("player_id"), "team", "action", "period",
    )


def file_kinds(events: DataFrame) -> DataFrame:
    """``file, kind, title``: Players if a file has shifts, else Team if it has zone play; and its name's parts. A file with neither, or
    not of exactly two teams, or whose name gives other teams than its rows, is an error."""
    shifts, zone = F.max(F.col("action") == "All shifts"), F.max(F.col("action") == "OZ play")
    f = events.groupBy("file").agg(shifts.alias("_s"), zone.alias("_z"), F.array_sort(F.collect_set("team")).alias("_teams"))
    wrong = lambda why: F.raise_error(F.concat(F.lit(why), F.col("file"))).cast("string")
    f = f.withColumn("title", T.title_parts(F.try_url_decode(F.regexp_replace("file", r"\+", "%2B"))))
    named = F.array_sort(F.array("title.team_a", "title.team_b"))
    kind = F.when(F.size("_teams") != 2, wrong("not of two teams: ")).when(F.col("title.team_a").isNotNull() & (named != F.col("_teams")), wrong("its name gives other teams: ")).when(F.col("_s"), "Players").when(F.col("_z"), "Team").otherwise(wrong("neither shifts nor zone play: "))
    return f.select("file", kind.alias("kind"), "title")
