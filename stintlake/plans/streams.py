"""Stream queries: the events as arriving files, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.plans.documents import ORACLES as DOCUMENT_SQL
from stintlake.plans.documents import as_files
from stintlake.session import new_path
from stintlake.streaming import actions as S

QUERIES, ORACLES = {}, {}
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files (a glob, since a stream reads no single file)."""
    e = S.read_actions(spark, f"{sf_dir}/events.parque[t]", SCHEMA)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The result of a stream once it has read what there is: every complete batch replaces the last, others are added."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)
    into = "overwrite" if mode == "complete" else "append"
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode(into).parquet(path)).start()
    )
    q.awaitTermination()
    return spark.read.parquet(path)


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_goals_stream(spark, sf_dir):
    """Counts and values of each kind of action by day, from a stream."""
    t = finished(S.tumbling_counts(events(spark, sf_dir), late="60 days", width="1 day"), "tumbling")
    return t.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("v", 4).alias("value"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_shifts_stream(spark, sf_dir):
    """Each user's sessions of actions less than half an hour apart, from a stream."""
    s = finished(S.sessions(events(spark, sf_dir), late="60 days"), "sessions")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(DOCUMENT_SQL["file_arrivals"])
def file_arrivals_stream(spark, sf_dir):
    """What each arriving file does to its game, from a stream of files with the games' state."""
    orders = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/orders.parquet").schema).parquet(f"{sf_dir}/orders.parque[t]")
    arriving = as_files(orders).withColumn("arrived", F.timestamp_seconds(F.col("arrived") + 1))  # what comes at time 0 is late in a stream
    return finished(S.arrivals(arriving), "arrivals", "append").filter("file is not null").select("file", "state")
