"""Events of each finger from its samples, all passes over one exchange and one order of rows.

Samples are rows (key, finger, i, t, fn, fs, hf, div, edge, tau, gv): load, shear, roughness, slip divergence,
edge rate ratio, torque, and jaw speed at the row's time. Contact is a debounced latch with two levels; the other
passes look only at rows in contact and start anew with every contact. Each pass adds running values; at
the end a row gives the events that it completes, so the table is never read or shuffled twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hand

START = Window.unboundedPreceding
#: Rows of a task: all windows of the passes sort and hold a task's rows.
TASK_ROWS = 50_000
EVENT = "struct<label:string,start:double,end:double,peak:double,rank:int>"


@dataclass(frozen=True)
class Finger:
    """Thresholds; times in the unit of t, windows in rows."""

    enter: float = 0.15
    leave: float = 0.10
    enter_s: float = 0.2
    leave_s: float = 0.3
    stable_least: float = 0.3
    stable_spread: float = 0.15
    stable_rows: int = 9
    lift_rate: float = 1.5
    lift_s: float = 0.1
    still: float = 0.5
    rough_enter: float = 15.0
    rough_leave: float = 6.0
    shear_rate: float = 8.0
    slip_div: float = 0.35
    edge_rate: float = 3.0
    incipient_s: float = 0.08
    torque: float = 25.0
    rotation_s: float = 0.25
    place_rows: int = 9
    place_drop: float = 0.2
    place_hold_rows: int = 21
    place_gap_s: float = 0.5
    least_s: float = 0.033
    before_s: float = 0.5
    after_s: float = 1.0
    travel: float = 2.0
    closing: float = -2.0


def in_contact(samples: DataFrame, key: str, r: Finger) -> DataFrame:
    """The samples with ``held``, ``contact`` (its number), ``began`` (row and time) and ``ended`` (the start of the
    stretch whose row ends the contact)."""
    w = Window.partitionBy(key, "finger").orderBy("i")
    before = w.rowsBetween(START, -1)
    d = samples.withColumn("_z", F.when(F.col("fn") > r.enter, 1).when(F.col("fn") < r.leave, 0).otherwise(-1))
    d = d.withColumn("_c", F.coalesce(F.col("_z") != F.lag("_z").over(w), F.lit(True)))
    d = d.withColumn("_s", F.last(F.when(F.col("_c"), F.struct("i", "t")), ignorenulls=True).over(w.rowsBetween(START, 0)))
    d = d.withColumn("_w", (F.col("_z") >= 0) & (F.col("t") - F.col("_s.t") >= F.when(F.col("_z") == 1, r.enter_s).otherwise(r.leave_s)))
    # a stretch fires once, at its first row that has waited; what it says counts where it differs from the one before
    d = d.withColumn("_f", F.when(F.col("_w") & (F.col("_c") | ~F.lag("_w").over(w)), F.col("_z")))
    d = d.withColumn("_p", F.coalesce(F.last("_f", ignorenulls=True).over(before), F.lit(0)))
    d = d.withColumn("held", F.coalesce("_f", "_p") == 1)
    d = d.withColumns({"_on": F.coalesce((F.col("_f") == 1) & (F.col("_p") == 0), F.lit(False)), "_off": F.coalesce((F.col("_f") == 0) & (F.col("_p") == 1), F.lit(False))})
    run = w.rowsBetween(START, 0)
    d = d.withColumns({"contact": F.sum(F.col("_on").cast("int")).over(run), "began": F.last(F.when(F.col("_on"), F.col("_s")), ignorenulls=True).over(run), "ended": F.when(F.col("_off"), F.col("_s.t"))})
    return d.drop("_z", "_c", "_s", "_w", "_f", "_p", "_off")


def _slope(x: str, w) -> Column:
    step = F.col("t") - F.lag("t").over(w)
    return F.coalesce(F.when(step > 1e-9, (F.col(x) - F.lag(x).over(w)) / step), F.lit(0.0))


def _event(when: Column, label: str, start: Column, end: Column, peak: Column, rank: int) -> Column:
    return F.when(when, F.struct(F.lit(label).alias("label"), start.cast("double").alias("start"), end.cast("double").alias("end"), peak.cast("double").alias("peak"), F.lit(rank).alias("rank")))


def finger_events(samples: DataFrame, key: str, r: Finger = Finger()) -> DataFrame:
    """(key, finger, i, rank, label, start, end, peak): contact_onset, terminal, grasp_stable, lift, slip,
    incipient_slip, rotation and place, each at the row that completes it. A terminal is named by the jaw
    (``named_terminals``). What is open when a contact ends gives no event; nulls in a channel fail its test."""
    w = Window.partitionBy(key, "finger").orderBy("i")
    tasks = max(math.ceil(samples.count() / TASK_ROWS), samples.sparkSession.sparkContext.defaultParallelism)
    d = in_contact(samples.repartition(tasks, key, "finger"), key, r)
    back = w.rowsBetween(-r.stable_rows, -1)
    mean = F.avg("fn").over(back)
    spread = F.sqrt(F.greatest(F.avg(F.col("fn") * F.col("fn")).over(back) - mean * mean, F.lit(0.0))) / F.abs(mean)
    d = d.withColumns({"_rel": F.when(F.abs(mean) >= 1e-9, spread), "_dfn": _slope("fn", w), "_dfs": _slope("fs", w), "_ref": F.lag("fn", r.place_rows).over(w), "_reft": F.lag("t", r.place_rows).over(w), "_next": F.max("fn").over(w.rowsBetween(1, r.place_hold_rows - 1))})
    true = lambda c: F.coalesce(c, F.lit(False))
    inside = F.col("held")
    flat = inside & (F.col("i") - F.col("began.i") >= r.stable_rows) & (F.col("fn") > r.stable_least) & (F.col("_rel") < r.stable_spread) & true(F.col("div") < r.slip_div)
    own = Window.partitionBy(key, "finger", "contact").orderBy("i")
    so_far, past = own.rowsBetween(START, 0), own.rowsBetween(START, -1)
    d = d.withColumn("_flat", true(flat)).withColumn("_marked", inside & (F.max(F.col("_flat").cast("int")).over(so_far) == 1))
    still = true(F.abs("gv") < r.still)
    # stretches of a condition within a contact: where one starts, and its peak so far
    d = d.withColumns({"_lift": F.col("_marked") & still & true(F.col("_dfn") > r.lift_rate), "_inc": inside & true((F.col("div") > r.slip_div) & (F.col("edge") > r.edge_rate)), "_rot": inside & true(F.abs("tau") > r.torque)})
    mark = F.when(~inside, None).when(true((F.col("fn") > r.stable_least) & (F.col("hf") > r.rough_enter) & (F.abs("_dfs") > r.shear_rate)), 1).when(true(F.col("hf") < r.rough_leave), 0)
    d = d.withColumn("_sm", mark).withColumn("_was", F.coalesce(F.last("_sm", ignorenulls=True).over(past), F.lit(0)))
    begins = lambda c: F.col(c) & ~true(F.lag(c).over(own))
    d = d.withColumns({f"{c}_n": F.sum(begins(c).cast("int")).over(so_far) for c in ("_lift", "_inc", "_rot")} | {"_slip_n": F.sum((true(F.col("_sm") == 1) & (F.col("_was") == 0)).cast("int")).over(so_far)})
    first = lambda c: F.first("t").over(Window.partitionBy(key, "finger", "contact", f"{c}_n").orderBy("i").rowsBetween(START, 0))
    top = lambda c, x: F.max(x).over(Window.partitionBy(key, "finger", "contact", f"{c}_n").orderBy("i").rowsBetween(START, 0))
    d = d.withColumns({f"{c}_t": first(c) for c in ("_lift", "_inc", "_rot", "_slip")} | {"_rough": top("_slip", F.col("hf")), "_torque": top("_rot", F.abs("tau")), "_inc0": F.first("div").over(Window.partitionBy(key, "finger", "contact", "_inc_n").orderBy("i").rowsBetween(START, 0))})
    lifted = F.col("_lift") & (F.col("_lift_n") > 0) & true(F.lag("_lift").over(own)) & (F.col("t") - F.col("_lift_t") >= r.lift_s)
    placed = F.col("_marked") & still & true(F.col("_ref") > r.stable_least) & true(F.col("fn") < F.col("_ref") * (1 - r.place_drop)) & F.coalesce(F.col("_next") <= 0.5 * F.col("_ref"), F.lit(True))
    d = d.withColumns({"_up": lifted, "_down": placed}).withColumn("_done", F.coalesce(F.sum(F.col("_up").cast("int")).over(past), F.lit(0)) > 0).withColumn("_flats", F.coalesce(F.sum(F.col("_flat").cast("int")).over(past), F.lit(0)))
    d = d.withColumn("_last", F.last(F.when(F.col("_down"), F.col("t")), ignorenulls=True).over(w.rowsBetween(START, -1)))
    closes = lambda c, least: inside & ~F.col(c) & true(F.lag(c).over(own)) & (F.col("t") - F.col(f"{c}_t") >= least)
    t, none = F.col("t"), F.lit(None).cast("double")
    made = [
        _event(F.col("_on"), "contact_onset", F.col("began.t"), F.col("began.t"), F.col("fn"), 0),
        _event(F.col("ended").isNotNull(), "terminal", F.col("ended"), F.col("ended"), none, 1),
        _event(F.col("_flat") & (F.col("_flats") == 0), "grasp_stable", t, t, F.col("fn"), 2),
        _event(F.col("_up") & ~F.col("_done"), "lift", F.col("_lift_t"), t, none, 3),
        _event(inside & (F.col("_was") == 1) & true(F.col("_sm") == 0), "slip", F.col("_slip_t"), t, F.col("_rough"), 4),
        _event(closes("_inc", r.incipient_s), "incipient_slip", F.col("_inc_t"), t, F.col("_inc0"), 5),
        _event(closes("_rot", r.rotation_s), "rotation", F.col("_rot_t"), t, F.col("_torque"), 6),
        _event(F.col("_down") & F.coalesce(t - F.col("_last") >= r.place_gap_s, F.lit(True)), "place", F.col("_reft"), t, F.col("_ref"), 7),
    ]
    e = d.select(key, "finger", "i", F.array_compact(F.array(*made)).cast(f"array<{EVENT}>").alias("e"))
    return e.select(key, "finger", "i", F.explode("e").alias("e")).select(key, "finger", "i", "e.rank", "e.label", "e.start", "e.end", "e.peak")


def named_terminals(events: DataFrame, jaw: DataFrame, key: str, r: Finger = Finger()) -> DataFrame:
    """A terminal is a release where the jaw opens around it by ``travel`` and was not closing fast, else a drop."""
    d = hand.jaw_at(hand.jaw_at(hand.jaw_at(events, jaw, key, F.col("start"), "_now"), jaw, key, F.col("start") - r.before_s, "_past"), jaw, key, F.col("start") + r.after_s, "_ahead")
    back, fwd = F.col("_now") - F.col("_past"), F.col("_ahead") - F.col("_now")
    opened = F.coalesce((back > r.closing) & (back + fwd >= r.travel), F.lit(False))
    return d.withColumn("label", F.when(F.col("label") != "terminal", F.col("label")).when(opened, "release").otherwise("drop")).drop("_now", "_past", "_ahead")


def legal_events(events: DataFrame, key: str, r: Finger = Finger()) -> DataFrame:
    """The events that their finger's state allows: a stable grasp only in contact, a lift, rotation or incipient
    slip only after one; spans shorter than ``least_s`` go."""
    w = Window.partitionBy(key, "finger").orderBy("start", "i", "rank").rowsBetween(START, -1)
    edge = F.when(F.col("label") == "contact_onset", 1).when(F.col("label").isin("terminal", "release", "drop"), 0)
    d = events.withColumn("_e", F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(0)))
    d = d.withColumn("_ok", ~((F.col("label") == "grasp_stable") & (F.col("_e") == 0)))
    phase = F.when(edge == 1, 1).when(edge == 0, 0).when((F.col("label") == "grasp_stable") & F.col("_ok"), 2)
    d = d.withColumn("_ph", F.coalesce(F.last(phase, ignorenulls=True).over(w), F.lit(0)))
    late = F.col("label").isin("lift", "incipient_slip", "rotation") & (F.col("_ph") < 2)
    short = (F.col("end") > F.col("start")) & (F.col("end") - F.col("start") < r.least_s)
    return d.filter(F.col("_ok") & ~late & ~short).drop("_e", "_ok", "_ph")


def detected(samples: DataFrame, jaw: DataFrame, key: str, r: Finger = Finger()) -> DataFrame:
    """Events of all fingers as ``hand`` takes them: (key, finger, seq, label, start, end, conf)."""
    e = legal_events(named_terminals(finger_events(samples, key, r), jaw, key, r), key, r)
    order = Window.partitionBy(key).orderBy("start", "finger", "i", "rank")
    conf = F.when(F.col("label") == "incipient_slip", "low").otherwise("medium")
    return e.select(key, "finger", (F.row_number().over(order) - 1).cast("long").alias("seq"), "label", "start", "end", conf.alias("conf"))
