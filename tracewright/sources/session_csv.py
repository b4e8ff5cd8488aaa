"""High-rate session CSV files, their baselines, and scorer sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = 12


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(element, x, y, z); rows without four numbers are skipped."""
    d = spark.read.option("header", True).csv(path)
    num = lambda c: F.expr(f"try_cast(`{c}` as double)")
    out = d.select(F.expr("try_cast(element as int)").alias("element"), *[num(c).alias(c) for c in "xyz"])
    return out.dropna()


def session_window(spark: SparkSession, path: str, lo: int, hi: int, zero: int, base: DataFrame) -> DataFrame:
    """(t, mean_dev, peak_dev) of the rows with lo <= t_epoch_ns <= hi: mean and greatest distance of
    the elements from their baseline, t in seconds from ``zero``. The filter is on the clock column alone."""
    d = spark.read.option("header", True).csv(path).withColumn("ns", F.col("t_epoch_ns").cast("long")).filter(F.col("ns").between(lo, hi))
    # the baseline is one row: a fixed number of elements
    b = base.filter(F.col("element") < ELEMENTS).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("element", F.array("x", "y", "z")))).alias("b"))
    d = d.crossJoin(F.broadcast(b))

    def dev(k: int) -> Column:
        at = lambda j: F.coalesce(F.get(F.try_element_at("b", F.lit(k)), F.lit(j)), F.lit(0.0))
        return F.sqrt(sum((F.pow(F.col(f"e{k}_{a}").cast("double") - at(j), 2) for j, a in enumerate("xyz")), F.lit(0.0)))

    devs = F.array(*[dev(k) for k in range(ELEMENTS)])
    return d.select("ns", ((F.col("ns") - zero) / 1e9).alias("t"), devs.alias("d")).select("ns", "t", (F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / ELEMENTS).alias("mean_dev"), F.array_max("d").alias("peak_dev"))


def measured_rate(window: DataFrame) -> DataFrame:
    """One row: rows and rate in Hz; null with fewer than two rows or no time between them."""
    g = window.agg(F.count("*").alias("n"), (F.max("ns") - F.min("ns")).alias("span"))
    return g.select("n", F.when((F.col("n") > 1) & (F.col("span") > 0), (F.col("n") - 1) * 1e9 / F.col("span")).alias("hz"))


# The score of each stage.
STAGE_SCORE = {"S0": 0.0, "S1": 0.2, "S2": 0.4, "S3": 0.7, "S4": 0.8, "S5": 1.0}


def stage_score(stage: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in STAGE_SCORE.items():
        out = F.when(stage == k, v).otherwise(out)
    return out


def scorer_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): sheets whose columns are named like episode, stage, failure and scene; a row
    without an episode number or a stage S0 to S5 is skipped."""
    d = spark.read.option("header", True).csv(path)
    find = lambda word: next((F.col(f"`{c}`") for c in d.columns if word in c.lower()), F.lit(None).cast("string"))
    d = d.select(find("episode").alias("e"), find("stage").alias("s"), find("fail").alias("f"), find("scene").alias("scene"))
    rows = d.select(F.expr("try_cast(e as long)").alias("episode"), F.nullif(F.regexp_extract("s", r"^\s*(S[0-5])", 1), F.lit("")).alias("stage"), F.nullif(F.regexp_extract("f", r"^\s*(F[0-8])", 1), F.lit("")).alias("failure"), "scene")
    good = F.col("episode").isNotNull() & F.col("stage").isNotNull()
    return rows.filter(good).withColumn("score", stage_score(F.col("stage"))), rows.filter(~good)
