"""A game worked out by hand: two sides of three skaters and a goalkeeper, one man advantage, a goal each way."""

import pytest
from pyspark.sql import functions as F

from stintlake.plans import game
from stintlake.sources import event_csv, library

H, V = "HARBOUR", "VALLEY"
SHIFTS = {  # video seconds of the first period
    "Ames Kit": (H, [(0, 400)]), "Bell Jo": (H, [(0, 1200)]), "Cole Max": (H, [(350, 1200)]), "Gray Pat": (H, [(0, 1200)]),
    "Dunn Lee": (V, [(0, 1200)]), "Ellis Sam": (V, [(100, 600), (600.4, 900)]), "Ford Ray": (V, [(900, 1200)]), "Hart Bo": (V, [(0, 1200)]),
}
SECOND = ["Ames Kit", "Bell Jo", "Gray Pat", "Dunn Lee", "Hart Bo"]  # ten minutes of a second period


def line(start, end, player, team, action, half=1, place=","):
    return f"9,{start},{end},{end - start:g},{place},{player},{team},{action},{half}"


def rows():
    out = [line(a, b, p, team, "All shifts") for p, (team, spans) in SHIFTS.items() for a, b in spans]
    out += [line(1500, 2100, p, SHIFTS[p][0], "All shifts", 2) for p in SECOND]
    out.append(line(600, 720, "Bell Jo", H, "Power play shifts"))

    def at(t, player, *actions, half=1, place=","):
        out.extend(line(t - 3, t + 3, player, SHIFTS[player][0], a, half, place) for a in actions)

    at(650, "Bell Jo", "Shots", "Shots on goal", "Goals", place="50,12")
    at(650, "Hart Bo", "Shots against", "Goals against")
    at(660, "Ellis Sam", "Shots", "Shots on goal")
    at(660, "Gray Pat", "Shots against", "Saves")
    at(1000, "Dunn Lee", "Shots", "Shots on goal", "Goals")
    at(1000, "Gray Pat", "Shots against", "Goals against")
    at(1800, "Ames Kit", "Faceoffs", "Faceoffs won", "Faceoffs in OZ", "Penalties", half=2)
    return out


def export(tmp_path, lines, name="Harbour 1 _ 1 Valley 07.03.2024.csv"):
    (tmp_path / name).write_text("﻿" + event_csv.HEADER + "\n" + "\n\n".join(lines) + "\n")
    return str(tmp_path)


@pytest.fixture(scope="module")
def clocked(spark, tmp_path_factory):
    return game.on_clock(event_csv.read_events(spark, export(tmp_path_factory.mktemp("g"), rows()))).cache()


def by_player(df, *columns):
    return {r["player_id"].split("|")[1]: tuple(r[c] for c in columns) for r in df.collect()}


def test_rows_are_read(spark, tmp_path):
    lines = ["7,10.5,14,3.5,60.96,25.92,Lowe Ann,Harbour,Hits,2", "8,,14,2,,,Lowe Ann,Harbour,Power play shifts,2", "9,-8,-3,5,30.48,,,Valley ,Penalties,1", "9,5,,1.25,,,Moss Al,Valley,Controlled breakouts,1", "9,1,2,1,,,Moss Al,Valley,All shifts,1"]
    got = event_csv.read_events(spark, export(tmp_path, lines)).orderBy("row_no").collect()
    assert [(r["kind"], r["start_ms"], r["end_ms"], r["at_ms"]) for r in got] == [("moment", 10500, 14000, 12250), ("span", 12000, 14000, 13000), ("moment", -8000, -3000, -5500), ("span", 5000, 6250, 5625), ("span", 1000, 2000, 1500)]
    assert abs(got[0]["along"] - 100) < 1e-9 and abs(got[0]["across"] + 42.519685) < 1e-5 and got[0]["player_id"] == "HARBOUR|ANN LOWE"
    assert got[2]["along"] is None and got[2]["player"] is None and got[2]["team"] == "VALLEY"
    title = event_csv.file_kinds(event_csv.read_events(spark, str(tmp_path))).first()
    assert (title["title"]["team_a"], title["title"]["goals_b"], str(title["title"]["day"])) == ("HARBOUR", 1, "2024-03-07")


@pytest.mark.parametrize("row", ["1,,,4,,,Lowe Ann,Valley,Hits,1", "1,9,4,5,,,Lowe Ann,Valley,Hits,1", "1,0.0001,4,5,,,Lowe Ann,Valley,Hits,1", "1,2,4,5,,,Lowe Ann,Valley", "1,2,4,2,,,Lowe Ann,,Hits,1"])
def test_bad_rows_are_errors(spark, tmp_path, row):
    events = event_csv.read_events(spark, export(tmp_path, [row]))
    with pytest.raises(Exception, match="not an event row"):
        events.select("action").collect()  # whichever columns are read
    assert library.sniff(spark, str(tmp_path)).first()["kind"] == "events"


def test_files_need_two_teams_and_a_known_kind(spark, tmp_path):
    three = [line(0, 5, "A B", t, "All shifts") for t in ("North", "South", "West")]
    with pytest.raises(Exception, match="two teams"):
        event_csv.file_kinds(event_csv.read_events(spark, export(tmp_path, three))).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="neither"):
        event_csv.file_kinds(event_csv.read_events(spark, export(tmp_path / "none", [line(0, 5, "A B", t, "Hits") for t in ("Harbour", "Valley")]))).collect()


def test_clock_and_shifts(clocked):
    lengths = {r["period"]: (r["length_s"], r["before_s"], r["irregular"]) for r in game.periods(clocked).collect()}
    assert lengths == {1: (1200.0, 0.0, False), 2: (600.0, 1200.0, True)}
    assert clocked.filter("action = 'Penalties'").first()["clock_s"] == 1500.0
    n = {r["player_id"].split("|")[1]: r["count"] for r in game.shifts(clocked).groupBy("player_id").count().collect()}
    assert n["ELLIS SAM"] == 1 and n["BELL JO"] == 2 and n["FORD RAY"] == 1  # less than a second apart is one shift


def test_strength_goals_and_plus_minus(clocked):
    adv = game.advantages(clocked).collect()
    assert [(r["by"], r["start_s"], r["end_s"]) for r in adv] == [(H, 600.0, 720.0)]
    goals = {(r["clock_s"], r["team"]): r for r in game.goals(clocked).collect()}
    assert {k: (r["strength"], r["score_for"], r["score_against"]) for k, r in goals.items()} == {(650.0, H): ("PowerPlay", 1, 0), (650.0, V): ("ShortHanded", 0, 1), (1000.0, H): ("Even", 1, 1), (1000.0, V): ("Even", 1, 1)}
    assert [p.split("|")[1] for p in goals[650.0, H]["on_ice"]] == ["BELL JO", "COLE MAX"] and [p.split("|")[1] for p in goals[1000.0, V]["on_ice"]] == ["DUNN LEE", "FORD RAY"]
    assert by_player(game.plus_minus(game.goals(clocked)), "plus_minus") == {"BELL JO": (-1,), "COLE MAX": (-1,), "DUNN LEE": (1,), "ELLIS SAM": (0,), "FORD RAY": (1,)}


def test_boxes(clocked):
    box = by_player(game.box(clocked), "goals", "shots", "toi_ms", "pp_ms", "corsi_for", "corsi_against", "plus_minus", "shifts")
    assert box["BELL JO"] == (1, 1, 1_800_000, 120_000, 0, 1, -1, 2)
    assert box["DUNN LEE"] == (1, 1, 1_800_000, 0, 1, 0, 1, 2) and box["ELLIS SAM"] == (0, 1, 799_600, 0, 0, 0, 0, 1)
    assert "GRAY PAT" not in box
    assert by_player(game.box(clocked), "faceoffs_oz", "faceoffs_oz_won", "penalty_s")["AMES KIT"] == (1, 1, 120)
    g = by_player(game.goalie_box(clocked), "shots_against", "saves", "goals_against", "ev_faced", "ev_saved", "sh_faced", "sh_saved")
    assert g == {"GRAY PAT": (2, 1, 1, 1, 0, 0, 0), "BO HART": (1, 0, 1, 0, 0, 1, 0)}
    t = {r["team"]: r for r in game.team_summary(clocked).collect()}
    assert (t[H]["shots_pp"], t[H]["goals_pp"], t[H]["power_plays"], t[H]["pp_seconds"], t[H]["pp_goals_scored"], t[H]["faceoffs_won_oz"]) == (1, 1, 1, 120.0, 1, 1)
    assert (t[V]["shots"], t[V]["shots_even"], t[V]["goals_even"]) == (2, 1, 1)


def test_stints_and_units(clocked):
    st = [(r["a"], r["b"], r["strength"], len(r["players"]), r["goals_for"], r["goals_against"]) for r in game.stints(clocked).filter(F.col("team") == H).orderBy("a").collect()]
    assert st == [(0, 350, "Even", 2, 0, 0), (350, 400, "Even", 3, 0, 0), (400, 600, "Even", 2, 0, 0), (600, 720, "PowerPlay", 2, 1, 0), (720, 1200, "Even", 2, 0, 1), (1200, 1800, "Even", 2, 0, 0), (1800, 2400, "Even", 0, 0, 0)][: len(st)]
    assert len(st) >= 6
    two = clocked.select("player_id").distinct().filter(F.col("player_id").rlike("BELL|COLE"))
    u = {(r["kind"], len(r["members"])): (r["seconds"], r["goals_for"], r["corsi_against"]) for r in game.units(clocked, two).filter(F.col("team") == H).collect()}
    assert u["DefencePair", 2] == (50 + 200 + 480, 0, 1) and u["PowerPlay", 2] == (120, 1, 0) and not any(k == "ForwardLine" for k, _ in u)


def test_store(spark, tmp_path):
    games = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "game_id string, v int")
    folder = f"file://{tmp_path}/games"
    library.save_games(games, folder)
    library.save_games(spark.createDataFrame([("b", 9)], "game_id string, v int"), folder)
    left = lambda: sorted((r["game_id"], r["v"]) for r in spark.read.parquet(folder).collect())
    assert left() == [("a", 1), ("b", 9)]
    assert library.delete_game(spark, folder, "b") and not library.delete_game(spark, folder, "c")
    assert left() == [("a", 1)]
