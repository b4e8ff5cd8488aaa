"""Runs, gaps and intervals: gaps-and-islands over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def run_ids(df: DataFrame, keys, order, flag: Column, out: str = "run") -> DataFrame:
    """Number the maximal stretches of equal flags."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return d.withColumn("_c", F.when(F.col("_f") == F.lag("_f").over(w), 0).otherwise(1)).withColumn(out, F.sum("_c").over(w.rowsBetween(START, 0)))


def runs(df: DataFrame, keys, order, flag: Column, t: str, x: str, dt_end: float = 0.0) -> DataFrame:
    """Maximal runs where the flag holds: (keys, run, n, start, end, peak); a run ends where the next
    row begins, the last one at its last time plus ``dt_end``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = run_ids(df.withColumn("_next", F.coalesce(F.lead(t).over(w), F.col(t) + dt_end)), keys, order, flag).filter("_f")
    return d.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max("_next").alias("end"), F.max(x).alias("peak"))


def merged(spans: DataFrame, keys, gap: float) -> DataFrame:
    """Join spans that start no later than ``gap`` after the furthest end so far: (keys, start, end, peak, spans)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(START, -1))
    d = spans.withColumn("_new", F.when(F.col("start") <= far + gap, 0).otherwise(1))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(START, 0)))
    return d.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("peak").alias("peak"), F.count("*").alias("spans")).drop("_g")


def bouts(df: DataFrame, keys, order, t: str, x: str, enter: float, least: float, gap: float) -> DataFrame:
    """Bouts of a signal above a threshold: runs of a least duration, joined over short gaps."""
    held = runs(df, keys, order, F.col(x) > enter, t, x).filter(F.col("end") - F.col("start") >= least)
    return merged(held, keys, gap)


def sustained(df: DataFrame, keys, order, flag: Column, t: str, hold: int) -> DataFrame:
    """First and last time of runs of ``hold`` rows or more: (keys, first, last, runs)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = run_ids(df, keys, order, flag).filter("_f").groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    return d.filter(F.col("n") >= hold).groupBy(*keys).agg(F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("runs"))


def gap_clusters(df: DataFrame, keys, order, t: str, x: str, gap: float) -> DataFrame:
    """Clusters of rows without a gap above the limit: (keys, cluster, n, start, end, at_peak, peak)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_c", F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("_c").over(w.rowsBetween(START, 0)))
    g = d.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end"), F.max(F.struct(F.col(x).alias("peak"), (-F.col(t)).alias("nt"))).alias("m"))
    return g.select(*keys, "cluster", "n", "start", "end", (-F.col("m.nt")).alias("at_peak"), F.col("m.peak").alias("peak"))


def state_cleanup(events: DataFrame, keys, order, kind: str) -> DataFrame:
    """Drop events that are illegal in their state: ``stable`` only right after an onset was the last
    of onset and terminal, others only while held. Onsets and terminals always stay."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(START, -1)
    d = events.withColumn("_last", F.last(F.when(F.col(kind).isin("onset", "terminal"), F.col(kind)), ignorenulls=True).over(w))
    return d.filter(F.col(kind).isin("onset", "terminal") | (F.col("_last") == "onset")).drop("_last")


def duplicate_drop(df: DataFrame, keys, order, cols) -> DataFrame:
    """Drop a row only where every column equals the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_s", same & (F.row_number().over(w) > 1)).filter("not _s").drop("_s")


def first_per_slot(df: DataFrame, keys, t: str, hz: float, order) -> DataFrame:
    """The first row of each slot floor((t - t0) * hz), stamped at the slot's start."""
    t0 = F.min(t).over(Window.partitionBy(*keys))
    d = df.withColumn("slot", F.floor((F.col(t) - t0) * hz)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(*order)))
    return d.filter("_r = 1").withColumn("stamp", F.col("slot") / F.lit(hz)).drop("_r")
