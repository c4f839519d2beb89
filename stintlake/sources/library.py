"""The store of games: files sorted by kind, canonical names, upserts of the same game, deletion, reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.operators import joins as J
from stintlake.sources.event_csv import HEADER

#: The version of stored games; others are read again.
VERSION = 1


def kind_of(first: Column, name: Column) -> Column:
    """What a file is by its first characters (after a byte-order mark) and its name: events, refused (XML), report, or unknown.

    A report is a document of words whose cover begins with its title.
    """
    head = F.regexp_replace(first, "^\\uFEFF", "")
    return (
        F.when(head.startswith(HEADER), "events").when(F.lower(name).endswith(".xml"), "refused")
        .when(head.startswith("MATCH REPORT"), "match report").when(head.startswith("PLAYERS REPORT"), "players report").otherwise("unknown")
    )


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, kind`` of all files under a path, from the first bytes of each."""
    f = spark.read.format("binaryFile").load(path)
    head = F.substring(F.col("content"), 1, 256).cast("string")
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), kind_of(head, name).alias("kind"))


def stored_name(team_a: Column, goals_a: Column, goals_b: Column, team_b: Column, day: Column, kind: Column) -> Column:
    """The name under which a file is kept: an export's own form, as its date and score are read from it; else a key and the kind."""
    dotted, iso = F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "yyyy-MM-dd")
    export = F.concat(team_a, F.lit(" "), goals_a.cast("string"), F.lit(" _ "), goals_b.cast("string"), F.lit(" "), team_b, F.lit(" "), dotted, F.when(kind == "team", "-2").otherwise(""), F.lit(".csv"))
    key = F.concat_ws("_", iso, T.slug(team_a), F.concat_ws("-", goals_a.cast("string"), goals_b.cast("string")), T.slug(team_b))
    return F.when(kind.isin("players", "team"), export).otherwise(F.concat(key, F.when(kind == "match report", "_match.pdf").otherwise("_players.pdf")))


def same_games(files: DataFrame) -> DataFrame:
    """files (file, team_a, team_b, goals_a, goals_b, day, arrived) with ``game_day``: the day under which its game is stored.

    A file is of the first stored game with its teams, in order, and its score whose day is near its own; else it starts one,
    under its own day. Whether a day starts a game is decided by its neighbours that arrived before it: a day without such
    starts one, one with a single such neighbour does as that one does not, and so on in turn along the days whose arrivals
    follow one another; a day with two such neighbours starts one only if neither did.
    """
    keys = ["team_a", "team_b", "goals_a", "goals_b"]
    days = files.groupBy(*keys, "day").agg(F.min(F.struct("arrived", "file")).alias("at"))
    order = Window.partitionBy(*keys).orderBy("day")
    near = lambda f, sign: F.when(F.datediff(f("day").over(order), F.col("day")) == sign, f("at").over(order))
    days = days.withColumn("left", near(F.lag, -1)).withColumn("right", near(F.lead, 1)).withColumn("n", F.row_number().over(order))
    follows = lambda side: F.coalesce(F.col(side) < F.col("at"), F.lit(False))
    days = days.withColumn("by_left", follows("left")).withColumn("by_right", follows("right"))
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    steps = {  # days since the first of those that follow one another from the left, and from the right
        "from_left": F.col("n") - F.max(F.when(~F.col("by_left"), F.col("n"))).over(before),
        "from_right": F.min(F.when(~F.col("by_right"), F.col("n"))).over(after) - F.col("n"),
    }
    for name, value in steps.items():
        days = days.withColumn(name, value)
    days = days.withColumn("starts", (F.col("from_left") % 2 == 0) & (F.col("from_right") % 2 == 0))
    started = lambda f, side: F.when(F.col(side).isNotNull() & f("starts").over(order), F.struct(F.col(side).alias("at"), f("day").over(order).alias("day")))
    first = F.least(started(F.lag, "left"), started(F.lead, "right"))["day"]
    days = days.withColumn("game_day", F.when(F.col("starts"), F.col("day")).otherwise(first))
    return files.join(days.select(*keys, "day", "game_day"), [*keys, "day"])


def arrivals(files: DataFrame) -> DataFrame:
    """files (also kind, arrived) with ``game_day, state`` in order of arrival: AlreadyLoaded if the game has a file of that kind,
    Waiting while it has no players' export, GameAdded when it gets one, GameUpdated after that."""
    g = same_games(files)
    keys = ["team_a", "team_b", "goals_a", "goals_b", "game_day"]
    before = Window.partitionBy(*keys).orderBy("arrived", "file").rowsBetween(Window.unboundedPreceding, -1)
    of_kind = Window.partitionBy(*keys, "kind").orderBy("arrived", "file").rowsBetween(Window.unboundedPreceding, -1)
    built = F.coalesce(F.max(F.col("kind") == "players").over(before), F.lit(False))
    again = F.count("*").over(of_kind) > 0
    return g.withColumn("state", F.when(again, "AlreadyLoaded").when(built, "GameUpdated").when(F.col("kind") == "players", "GameAdded").otherwise("Waiting"))


def new_files(files: DataFrame, kept: DataFrame, name: str = "stored") -> DataFrame:
    """The files whose canonical name isn't kept yet, one of each name (the first that arrived)."""
    return J.first_match(files, [name], ["arrived", "file"]).join(kept.select(name).distinct(), name, "left_anti")


def orphans(files: DataFrame, entries: DataFrame, version: int = VERSION) -> DataFrame:
    """The kept files of no current entry: those of entries of another version are read again. entries: file, version."""
    current = entries.filter(F.col("version") == version).select("file").distinct()
    return files.join(current, "file", "left_anti")


def save_games(games: DataFrame, folder: str) -> None:
    """Games (with ``game_id``) into a partition each; a game that is there already is replaced, others stay."""
    games.write.partitionBy("game_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def delete_game(spark: SparkSession, folder: str, game_id: str) -> bool:
    """Removes a game's partition; whether it was there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "game_id=" + game_id)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of the same keys replaced by the new ones."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def report_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: each row of a report as a JSON object; nulls are left out."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))
