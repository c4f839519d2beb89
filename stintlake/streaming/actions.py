"""Streams of actions: tumbling counts, sessions, responses within a time, idempotent delivery, and files that wait for others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_actions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling_counts(actions: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and values of each action by time windows; rows later than ``late`` are not waited for."""
    return actions.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("window.start", "window.end", "event_type", "n", "v")


def sessions(actions: DataFrame, at: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Shifts as sessions: a player's actions less than ``gap`` apart."""
    return actions.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def responses(actions: DataFrame, kind: str, at: str = "ts", late: str = "10 minutes", within: str = "2 minutes") -> DataFrame:
    """Actions of a user that follow one of a kind within a time, by a join of the stream with itself that can forget."""
    first = actions.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("cause"), F.col(at).alias("cause_ts")).withWatermark("cause_ts", late)
    then = actions.filter(F.col("event_type") != kind).select(F.col("user_id").alias("then_user"), "event_id", F.col(at).alias("then_ts")).withWatermark("then_ts", late)
    return first.join(then, F.expr(f"user_id = then_user and then_ts > cause_ts and then_ts <= cause_ts + interval {within}")).drop("then_user")


def once(actions: DataFrame, key: str = "event_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows delivered twice come out once."""
    return actions.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


GAME = ["team_a", "team_b", "goals_a", "goals_b"]
ARRIVALS = "team_a string, team_b string, goals_a int, goals_b int, file long, game_day date, state string"


def arrivals(files: DataFrame, patience: str = "365 days") -> DataFrame:
    """What each arriving file does to its game, as it arrives: ``team_a, team_b, goals_a, goals_b, file, game_day, state``.

    files: file, the teams and score, day, kind, arrived (a time). Per teams and score the state holds the games stored so far, each
    under its first file's day with the kinds of file that it has, so a restarted stream goes on where it was. A file is of the
    first game near its day, as in the batch. A game that still waits for its players' export when its last file is ``patience``
    behind the stream comes out once more, without a file, as Overdue.
    """
    wait_ms = files.sparkSession.sql(f"SELECT INTERVAL {patience} AS w").first()["w"].total_seconds() * 1000

    def run(key, parts, state: GroupState):
        games = [[day, set(kinds.split(",")), late] for day, kinds, late in zip(*state.get)] if state.exists else []
        out = []
        if state.hasTimedOut:
            for game in games:
                if "players" not in game[1] and not game[2]:
                    game[2] = True
                    out.append((*key, None, game[0], "Overdue"))
        else:
            rows = pd.concat(list(parts)).sort_values(["arrived", "file"])
            for r in rows.itertuples():
                game = next((g for g in games if abs((g[0] - r.day).days) <= 1), None)
                if game is None:
                    games.append(game := [r.day, set(), False])
                built, again = "players" in game[1], r.kind in game[1]
                game[1].add(r.kind)
                out.append((*key, r.file, game[0], "AlreadyLoaded" if again else "GameUpdated" if built else "GameAdded" if r.kind == "players" else "Waiting"))
            if any("players" not in g[1] and not g[2] for g in games):
                last = int(rows["arrived"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(last + int(wait_ms), state.getCurrentWatermarkMs() + 1))
        state.update(([g[0] for g in games], [",".join(sorted(g[1])) for g in games], [g[2] for g in games]))
        frame = pd.DataFrame(out, columns=[*GAME, "file", "game_day", "state"])
        yield frame.astype({"file": "Int64"})

    watched = files.withWatermark("arrived", patience)
    return watched.groupBy(*GAME).applyInPandasWithState(run, ARRIVALS, "days array<date>, kinds array<string>, late array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
