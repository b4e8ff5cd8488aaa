"""Registered queries that run as streams over the events, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import online, runner
from .catalog import query, rounded
from .catalog_data import LATCH
from .views import micros, table


def _stream(spark, sf_dir):
    e = runner.table_stream(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("episode"), F.timestamp_micros(micros("ts")).alias("at"), (micros("ts") / 1e6).alias("t"), F.col("value").alias("x"), F.col("event_type").alias("label"))


@query("""SELECT event_type AS label, epoch_us(ts) // 86400000000 * 86400000000 AS "start", count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM events GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    out = runner.available_now(online.windowed(_stream(spark, sf_dir), "at", ["label"], "x", "1 day", "40 days"), "complete")
    return rounded(out.select("label", F.unix_micros("start").alias("start"), "n", "mean", "peak"), "mean")


@query("""SELECT event_type AS label, count(*) AS n, count(*) FILTER (value > 34) AS loud FROM events GROUP BY ALL""")
def stream_counts(spark, sf_dir):
    s = _stream(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("x") > 34).alias("loud"))
    return runner.available_now(s, "complete")


@query(f"""WITH RECURSIVE {LATCH.replace("g.t", "g.us").replace("t - began", "us - began").replace("THEN t END", "THEN us END").replace("3600", "3600000000")} SELECT episode, kind, "start", fired FROM latch WHERE kind IS NOT NULL""")
def stream_latch(spark, sf_dir):
    return latch_of(runner.table_stream(spark, sf_dir, "events"), table(spark, sf_dir, "events"))


def latch_of(stream, events):
    """The latch over a stream of events; ``events``, the same as a table, gives the keys to close."""
    cols = [F.col("user_id").alias("episode"), F.timestamp_micros(micros("ts")).alias("at"), micros("ts").cast("double").alias("t"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("x")]
    rows = stream.select(*cols, F.lit(False).alias("closing"))
    ends = events.select(F.col("user_id").alias("episode")).distinct()
    ends = ends.select("episode", F.timestamp_micros(F.lit(7_258_118_400_000_000)).alias("at"), F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("x"), F.lit(True).alias("closing"))
    hour = 3600.0 * 1e6
    return runner.with_closing(rows, ends, "append", lambda s: online.latched(s, "episode", "at", "t", "seq", "x", "closing", 34.0, 20.0, hour, hour, "400 days"))
