"""The store of games against a plain loop over files in order of arrival."""

import datetime
import random

from stintlake.sources import library

SCHEMA = "file long, team_a string, team_b string, goals_a int, goals_b int, day date, arrived long, kind string"


def stored_one_by_one(rows):
    """The day of each file's game: the first stored game of its teams and score within a day, else its own."""
    games, out = [], {}
    for file, a, b, ga, gb, day, *_ in sorted(rows, key=lambda r: (r[6], r[0])):
        same = [g for g in games if g[:4] == (a, b, ga, gb) and abs((g[4] - day).days) <= 1]
        if not same:
            games.append((a, b, ga, gb, day))
        out[file] = same[0][4] if same else day
    return out


def test_three_days_in_a_row_are_two_games(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [(i, "A", "B", 1, 2, day(i), i, "players") for i in (1, 2, 3)]
    got = {r["file"]: (r["game_day"], r["state"]) for r in library.arrivals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (day(1), "GameAdded"), 2: (day(1), "AlreadyLoaded"), 3: (day(3), "GameAdded")}
    rows = [(3, "A", "B", 1, 2, day(2), 1, "team"), (1, "A", "B", 1, 2, day(1), 2, "players"), (2, "A", "B", 1, 2, day(3), 3, "match report")]
    got = {r["file"]: (r["game_day"], r["state"]) for r in library.arrivals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: (day(2), "Waiting"), 1: (day(2), "GameAdded"), 2: (day(2), "GameUpdated")}


def test_same_games_equal_a_loop(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        pair = draw.choice(["AB", "BA", "AC"])
        rows.append((i, pair[0], pair[1], draw.randrange(3), draw.randrange(2), datetime.date(2024, 1, 1) + datetime.timedelta(draw.randrange(150)), draw.randrange(2000), "players"))
    got = {r["file"]: r["game_day"] for r in library.same_games(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == stored_one_by_one(rows)
