"""Event detection over a contact signal: passes from DataFrame to DataFrame.

All of it is windows and joins: the debounced latch is the alternation of long enough stretches above
and below its two levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import asof, islands


@dataclass(frozen=True)
class Rules:
    """Thresholds; times in the unit of t."""

    enter: float = 0.15
    leave: float = 0.10
    enter_s: float = 0.2
    leave_s: float = 0.3
    stable_least: float = 0.3
    stable_spread: float = 0.15
    window: int = 9
    slip_rough: float = 15.0
    open_travel: float = 2.0
    weak_peak: float = 2.3
    merge_s: float = 0.5
    short_s: float = 1.0
    slow_s: float = 2.2


def contacts(df: DataFrame, key: str, order: str, t: str, x: str, r: Rules) -> DataFrame:
    """(key, kind, start, fired): onsets and terminals of the debounced latch (``leave`` is at most ``enter``).

    A stretch above ``enter`` (below ``leave``) fires at its first row that is enter_s (leave_s) after
    its start. Stretches of the two kinds never overlap, so the latch takes those that fire and differ
    in kind from the one that fired before; the first must be an onset.
    """
    w = Window.partitionBy(key).orderBy(order)
    d = df.select(key, order, F.col(t).alias("_t"), F.when(F.col(x) > r.enter, 1).when(F.col(x) < r.leave, 0).otherwise(-1).alias("_z"))
    d = d.withColumn("_c", F.when(F.col("_z") == F.lag("_z").over(w), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_c").over(w)).withColumn("start", F.last(F.when(F.col("_c") == 1, F.col("_t")), ignorenulls=True).over(w))
    waited = F.col("_t") - F.col("start") >= F.when(F.col("_z") == 1, r.enter_s).otherwise(r.leave_s)
    g = d.filter("_z >= 0").groupBy(key, "_run", "_z").agg(F.min("start").alias("start"), F.min(F.when(waited, F.col("_t"))).alias("fired")).filter("fired is not null")
    before = F.coalesce(F.lag("_z").over(Window.partitionBy(key).orderBy("_run")), F.lit(0))
    g = g.withColumn("_b", before).filter("_z <> _b")
    return g.select(key, F.when(F.col("_z") == 1, "onset").otherwise("terminal").alias("kind"), "start", "fired")


def residual_gate(df: DataFrame, key: str, order: str, t: str, x: str, level: float, hold: float) -> DataFrame:
    """The rows with ``open``, false where the signal is taken for a residue: after a hold has ended (a
    stretch of ``hold`` at the level or below, after one above it), until the next load of ``hold`` begins."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.col(t) - F.lag(t).over(w)
    d = df.withColumns({"_f": F.coalesce(F.col(x) > level, F.lit(False)), "_next": F.lead(t).over(w), "_d": step})
    d = d.withColumn("_d", F.coalesce(F.percentile("_d", F.lit(0.5)).over(Window.partitionBy(key)), F.lit(0.0)))
    d = d.withColumn("_c", F.when(F.col("_f") == F.lag("_f").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_c").over(w))
    g = d.groupBy(key, "_run", "_f").agg((F.max(F.coalesce(F.col("_next"), F.col(t) + F.col("_d"))) - F.min(t) >= hold).alias("_long"))
    o = Window.partitionBy(key).orderBy("_run")
    load = F.col("_f") & F.col("_long")
    seen = F.coalesce(F.max(load.cast("int")).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    mark = F.when(load, True).when(~F.col("_f") & F.col("_long") & F.col("_seen"), False)
    g = g.withColumn("_seen", seen).withColumn("open", F.coalesce(F.last(mark, ignorenulls=True).over(o), F.lit(True)))
    return d.drop("_f", "_next", "_d", "_c").join(g.select(F.col(key).alias("_k"), F.col("_run").alias("_r"), "open"), (F.col(key) == F.col("_k")) & (F.col("_run") == F.col("_r"))).drop("_k", "_r", "_run")


def bouts(events: DataFrame, key: str, r: Rules) -> DataFrame:
    """(key, bout, start, end): onset to terminal, joined over short gaps; open bouts have no end."""
    w = Window.partitionBy(key).orderBy("start")
    d = events.withColumn("end", F.lead("start").over(w)).filter("kind = 'onset'")
    far = F.lag("end").over(w)
    d = d.withColumn("_n", F.when(F.col("start") <= far + r.merge_s, 0).otherwise(1)).withColumn("bout", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "bout").agg(F.min("start").alias("start"), F.when(F.count("end") == F.count("*"), F.max("end")).alias("end"))


def measured(df: DataFrame, b: DataFrame, key: str, order: str, t: str, x: str, jaw: str, r: Rules) -> DataFrame:
    """Each bout with its peak, its first stable time, roughness and jaw travel after its end."""
    from . import timeseries as ts

    d = ts.relative_std(ts.mean_abs_diff(df, [key], [order], x, 10, "rough"), [key], [order], x, r.window, "spread")
    d = d.withColumn("_t", F.col(t))
    inside = asof.backward(d, b.select(key, F.col("start").alias(t), F.struct("bout", "start", "end").alias("b")), [key], t, "b", "b").filter("b is not null")
    held = inside.filter(F.col("b.end").isNull() | (F.col(t) < F.col("b.end")))
    m = held.groupBy(key, "b.bout").agg(F.max(x).alias("peak"), F.min(F.when((F.col(x) > r.stable_least) & (F.col("spread") < r.stable_spread), F.col(t))).alias("stable"), F.count_if(F.col("rough") > r.slip_rough).alias("rough_rows"), F.min(jaw).alias("jaw_low"))
    after = inside.filter(F.col(t) >= F.col("b.end")).groupBy(key, "b.bout").agg(F.max_by(jaw, F.struct(-F.col(t))).alias("jaw_after"))
    return b.join(m, [key, "bout"], "left").join(after, [key, "bout"], "left")


def classified(m: DataFrame, key: str, r: Rules) -> DataFrame:
    """Bouts with their terminal (release or drop), class and flags."""
    opened = F.coalesce(F.col("jaw_after") - F.col("jaw_low") >= r.open_travel, F.lit(False))
    kind = F.when(F.col("end").isNull(), "open").when(F.col("stable").isNull() & (F.col("peak") < r.weak_peak), "weak_contact").when(F.col("stable").isNull(), "failed_attempt").otherwise("grasp")
    lasted = F.col("end") - F.coalesce("stable", "start")
    d = m.withColumn("terminal", F.when(F.col("end").isNull(), None).when(opened, "release").otherwise("drop")).withColumn("kind", kind)
    d = d.withColumn("short_transport", F.coalesce((F.col("kind") == "grasp") & (lasted < r.short_s), F.lit(False)))
    return d.withColumn("slips", F.col("rough_rows"))


def detect(df: DataFrame, key: str, order: str, t: str, x: str, jaw: str, r: Rules = Rules()) -> DataFrame:
    """All bouts of all episodes, measured and classified."""
    e = contacts(df, key, order, t, x, r)
    return classified(measured(df, bouts(e, key, r), key, order, t, x, jaw, r), key, r)


def recorded(events: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Events that are recorded: not those of an interpretation, nor those inside a weak contact span."""
    own = events.filter("kind not in ('phantom', 'sensor_residual')")
    weak = spans.filter("kind = 'weak_contact'").select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return own.join(weak, (own[key] == F.col("_k")) & own["start"].between(F.col("_s"), F.col("_e")), "left_anti")
