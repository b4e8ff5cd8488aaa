"""Scoring of rollouts from per-frame measures: how far the object got."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


@dataclass(frozen=True)
class Stages:
    """Limits of the decision; lengths in pixels at a width of 640, times ``scale``."""

    least_seen: int = 3
    head: int = 8
    tail: int = 5
    gain: float = 1.08
    hold: int = 3
    near: float = 90.0
    inside: float = 0.85
    scale: float = 1.0


def _upper_median(values: Column) -> Column:
    """The middle one of a few values, the upper of two."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def decided_stages(frames: DataFrame, bowls: DataFrame, grips: DataFrame, key: str, rules: Stages = Stages()) -> DataFrame:
    """(key, stage, failure, seen, frames, lifted, bowl_distance): one row for each episode with frames.

    ``frames``: (key, i, area, x, y, near), the object unseen where the area is not positive; ``bowls``:
    (key, bowl_x, bowl_y, bowl_r), no row where none was found; ``grips``: (key, actuated). Lifted is an
    area above ``gain`` times that of the first sightings for ``hold`` sightings in a row; S5 ends in the bowl
    after a lift, S3 passed near it, S2 was lifted, S1 was reached or gripped, S0 nothing.
    """
    w = Window.partitionBy(key).orderBy("i")
    seen = frames.filter("area > 0").withColumns({"_n": F.row_number().over(w), "_back": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("i")))})
    # the first sightings stand at the window's start for every row: their number is bounded
    head = F.collect_list(F.when(F.col("_n") <= rules.head, F.col("area"))).over(Window.partitionBy(key))
    seen = seen.withColumn("_high", F.col("area") > rules.gain * _upper_median(head))
    # a sighting is lifted where the ``hold`` last ones, itself included, are all high
    run = F.min(F.col("_high").cast("int")).over(w.rowsBetween(1 - rules.hold, 0))
    seen = seen.withColumn("_up", (run == 1) & (F.col("_n") >= rules.hold)).join(bowls, key, "left")
    away = F.sqrt((F.col("x") - F.col("bowl_x")) ** 2 + (F.col("y") - F.col("bowl_y")) ** 2)
    last = lambda c: _upper_median(F.collect_list(F.when(F.col("_back") <= rules.tail, F.col(c))))
    g = seen.groupBy(key).agg(
        F.count("*").alias("seen"), F.coalesce(F.bool_or("_up"), F.lit(False)).alias("lifted"), F.min(F.when(F.col("_up"), away)).alias("bowl_distance"), last("x").alias("_x"), last("y").alias("_y"),
        F.coalesce(F.bool_or("near"), F.lit(False)).alias("_near"), F.first("bowl_x").alias("_bx"), F.first("bowl_y").alias("_by"), F.first("bowl_r").alias("_br"),
    )
    d = frames.groupBy(key).agg(F.count("*").alias("frames")).join(g, key, "left").join(grips.select(key, "actuated"), key, "left")
    d = d.withColumns({"seen": F.coalesce("seen", F.lit(0)), "lifted": F.coalesce("lifted", F.lit(False)), "_grip": F.coalesce("actuated", F.lit(False))})
    ends = F.coalesce(F.sqrt((F.col("_x") - F.col("_bx")) ** 2 + (F.col("_y") - F.col("_by")) ** 2) < rules.inside * F.col("_br"), F.lit(False))
    close = F.coalesce(F.col("bowl_distance") < rules.near * rules.scale, F.lit(False))
    untracked = F.col("seen") < rules.least_seen
    cases = [
        (untracked & F.col("_grip"), "S1", "F3"), (untracked, "S0", "F6"), (ends & F.col("lifted"), "S5", "F0"), (close, "S3", "F5"), (F.col("lifted"), "S2", "F4"),
        (F.col("_grip"), "S1", "F3"), (F.coalesce("_near", F.lit(False)), "S1", "F2"),
    ]
    found = F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("stage"), F.lit(f).alias("failure"))) for c, s, f in cases], F.struct(F.lit("S0").alias("stage"), F.lit("F6").alias("failure")))
    return d.withColumn("_s", found).select(key, "_s.stage", "_s.failure", "seen", "frames", F.col("lifted") & ~untracked, F.when(~untracked, F.col("bowl_distance")).alias("bowl_distance")).toDF(key, "stage", "failure", "seen", "frames", "lifted", "bowl_distance")
