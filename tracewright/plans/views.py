"""Tables in the roles that the operators work on, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of one signal: (episode, i, us, t, x, label, jaw), t in seconds from the episode's start."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), "event_id", micros("ts").alias("us"), F.col("value").alias("x"), F.col("event_type").alias("label"), F.get_json_object("props", "$.k").cast("double").alias("jaw"))
    w = Window.partitionBy("episode").orderBy("us", "event_id")
    e = e.withColumn("i", F.row_number().over(w) - 1).withColumn("t", (F.col("us") - F.first("us").over(w)) / F.lit(1e6))
    return e.select("episode", "i", "us", "t", "x", "label", "jaw")


SIGNAL = """sig AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS us,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t, value AS x, event_type AS label, json_extract_string(props, '$.k')::DOUBLE AS jaw FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of four joints: (episode, i, task, q, p, d, x), an episode being the lines of one part."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    cols = [F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("x")]
    return li.select(F.col("l_partkey").alias("episode"), (F.row_number().over(w) - 1).alias("i"), F.col("l_suppkey").alias("task"), F.col("l_returnflag").alias("flag"), *cols)


FRAMES = """fr AS (SELECT l_partkey AS episode, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) - 1 AS i, l_suppkey AS task, l_returnflag AS flag,
  l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS d, l_tax::DOUBLE AS x FROM lineitem)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation atoms: (episode, ts, role, style, content), from conversation turns."""
    c = table(spark, sf_dir, "conversations")
    style = F.when(F.col("role") == "user", "interjection").when(F.col("role") == "system", "memory").otherwise("subtask")
    return c.select(F.col("conv_id").alias("episode"), (F.col("turn") * 0.5).alias("ts"), "role", style.alias("style"), F.col("text").alias("content"))


ATOMS = "atoms AS (SELECT conv_id AS episode, turn * 0.5::DOUBLE AS ts, role, CASE role WHEN 'user' THEN 'interjection' WHEN 'system' THEN 'memory' ELSE 'subtask' END AS style, text AS content FROM conversations)"
