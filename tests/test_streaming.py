import datetime
import random

from stintlake.sources import library
from stintlake.streaming import actions as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    batch.limit(50).write.mode("append").parquet(f"{tmp_path}/in")  # delivered twice
    stream = S.once(S.read_actions(spark, f"{tmp_path}/in", SCHEMA), late="60 days")
    assert run(spark, stream, "once").count() == batch.count()
    plain = S.read_actions(spark, f"{tmp_path}/in", SCHEMA)
    got = run(spark, S.tumbling_counts(plain, late="60 days"), "tumbling", "complete")
    assert got.selectExpr("sum(n)").first()[0] == batch.count() + 50
    got = run(spark, S.sessions(plain, late="60 days"), "sessions", "complete")
    assert got.selectExpr("sum(n)").first()[0] == batch.count() + 50
    hits = run(spark, S.responses(plain, "purchase", late="60 days"), "responses")
    assert set(hits.columns) == {"user_id", "cause", "cause_ts", "event_id", "then_ts"}


FILE = "file long, team_a string, team_b string, goals_a int, goals_b int, day date, kind string, arrived timestamp"


def test_waiting_files_survive_a_restart(spark, tmp_path):
    """Three deliveries, the stream stopped after each: the same as the batch, and what never gets its export is overdue."""
    draw = random.Random(5)
    start, kinds = datetime.datetime(2024, 3, 1), ["players", "team", "match report", "player report"]
    rows = [
        (i, draw.choice("AB"), "C", draw.randrange(2), 1, datetime.date(2024, 1, 1) + datetime.timedelta(draw.randrange(12)), draw.choice(kinds), start + datetime.timedelta(minutes=i))
        for i in range(90)
    ] + [(900, "Z", "C", 9, 9, datetime.date(2024, 1, 1), "team", start)]
    files = spark.createDataFrame(rows, FILE)
    want = {(r["file"], r["game_day"], r["state"]) for r in library.arrivals(files).collect()}
    late = spark.createDataFrame([(901, "Y", "C", 0, 0, datetime.date(2024, 6, 1), "players", start + datetime.timedelta(days=3))], FILE)
    out = []
    for part in (files.filter("file < 30 or file = 900"), files.filter("file >= 30 and file < 60"), files.filter("file >= 60 and file < 900"), late):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.arrivals(spark.readStream.schema(FILE).parquet(f"{tmp_path}/in"), patience="1 day")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination()
    got = {(r["file"], r["game_day"], r["state"]) for r in out if r["file"] is not None}
    assert got == want | {(901, datetime.date(2024, 6, 1), "GameAdded")}
    assert ("Z", datetime.date(2024, 1, 1), "Overdue") in {(r["team_a"], r["game_day"], r["state"]) for r in out if r["file"] is None}


def test_responses_are_those_in_time(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 12, 0, s)
    rows = [(1, at(0), 7, "purchase", 1.0), (2, at(0), 7, "click", 1.0), (3, at(5), 7, "view", 1.0), (4, at(5), 8, "view", 1.0), (5, at(59), 7, "click", 1.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    got = run(spark, S.responses(S.read_actions(spark, f"{tmp_path}/in", SCHEMA), "purchase", within="30 seconds"), "in_time")
    assert [(r["cause"], r["event_id"]) for r in got.collect()] == [(1, 3)]
