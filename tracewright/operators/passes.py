"""Detector passes over event tables: (key, start, kind, conf, ...) to the same, as joins and windows.

Times are in the unit of ``start``. Each pass states what it drops, adds or renames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, islands

START = Window.unboundedPreceding


def sustained_rise(df: DataFrame, keys, order, t: str, rate: Column, least: float, hold: int) -> DataFrame:
    """(keys, start, rows): stretches of ``hold`` rows or more whose rate is above the limit (lift)."""
    d = islands.run_ids(df, keys, order, rate > least).filter("_f")
    return d.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.count("*").alias("rows")).filter(F.col("rows") >= hold).drop("run")


def hysteresis_spans(df: DataFrame, keys, order, t: str, x: str, high: float, low: float) -> DataFrame:
    """(keys, start, end, peak): spans that open above ``high`` and last until the value is below
    ``low``; a span that is open at the end is left out (slip, rotation)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    mark = F.when(F.col(x) > high, 1).when(F.col(x) < low, 0)
    d = df.withColumn("_on", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(START, 0)), F.lit(0)))
    d = d.withColumn("_c", F.when(F.col("_on") == F.coalesce(F.lag("_on").over(w), F.lit(0)), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w.rowsBetween(START, 0))).withColumn("_next", F.lead(t).over(w))
    g = d.filter("_on = 1").groupBy(*keys, "_g").agg(F.min(t).alias("start"), F.max("_next").alias("end"), F.max(x).alias("peak"), F.count_if(F.col("_next").isNull()).alias("_o"))
    return g.filter("_o = 0").drop("_g", "_o")


def places(df: DataFrame, keys, order, clock: str, x: str, back: int, least: float, drop: float, quiet: float, ahead: int) -> DataFrame:
    """Rows where a load of ``least`` fell by the share ``drop`` within ``back`` rows and stays under the
    share ``quiet`` of it for ``ahead`` of the clock (to the series' end at most)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(x, back).over(w)
    after = F.max(x).over(Window.partitionBy(*keys).orderBy(clock).rangeBetween(1, ahead))
    return df.withColumn("before", before).withColumn("_a", after).filter((F.col("before") > least) & (F.col(x) <= (1 - drop) * F.col("before")) & F.coalesce(F.col("_a") <= quiet * F.col("before"), F.lit(True))).drop("_a")


def refractory(events: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """Events no closer than ``gap`` to the last one kept: a fold over one episode's few events."""
    from .kernels import per_episode

    cols = [c for c in events.columns if c != key]

    def run(pdf):
        keep, last = [], float("-inf")
        for now in pdf[t].tolist():
            keep.append(now - last >= gap)
            last = now if keep[-1] else last
        return pdf.loc[keep, cols]

    kind = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in cols)
    return per_episode(events, key, t, run, kind)


def agreed(events: DataFrame, points: DataFrame, keys, reach: float, conf: str = "conf") -> DataFrame:
    """Events of medium confidence near a changepoint become high."""
    near = asof.within(events, points, keys, "start", reach, "left_semi").select(*keys, "start", "kind").distinct().withColumn("_n", F.lit(True))
    d = events.join(near, [*keys, "start", "kind"], "left")
    return d.withColumn(conf, F.when(F.col("_n") & (F.col(conf) == "medium"), "high").otherwise(F.col(conf))).drop("_n")


def lonely(events: DataFrame, points: DataFrame, keys, reach: float) -> DataFrame:
    """Changepoints without an event near them."""
    return asof.within(points, events.select(*keys, "start"), keys, "start", reach, "left_anti")


def backfilled(events: DataFrame, key: str, reach: float, lead: float) -> DataFrame:
    """Adds a low ``place`` before each release that has none within ``reach`` before it."""
    w = Window.partitionBy(key).orderBy("start").rowsBetween(START, 0)
    d = events.withColumn("_p", F.max(F.when(F.col("kind") == "place", F.col("start"))).over(w))
    bare = d.filter((F.col("kind") == "release") & (F.col("_p").isNull() | (F.col("_p") < F.col("start") - reach)))
    new = bare.select(key, (F.col("start") - lead).alias("start"), F.lit("place").alias("kind"), F.lit("low").alias("conf"))
    return events.select(key, "start", "kind", "conf").unionByName(new)


def peeled(events: DataFrame, key: str, quiet: float, late: float) -> DataFrame:
    """A drop without a new onset for ``quiet`` after it and with a release within ``late`` is a release."""
    ahead = Window.partitionBy(key).orderBy(F.desc("start")).rowsBetween(START, -1)
    onset = F.min(F.when(F.col("kind") == "onset", F.col("start"))).over(ahead)
    release = F.min(F.when(F.col("kind") == "release", F.col("start"))).over(ahead)
    d = events.withColumn("_o", onset).withColumn("_r", release)
    free = F.coalesce(F.col("_o") - F.col("start") > quiet, F.lit(True)) & F.coalesce(F.col("_r") - F.col("start") <= late, F.lit(False))
    return d.withColumn("kind", F.when((F.col("kind") == "drop") & free, "release").otherwise(F.col("kind"))).drop("_o", "_r")


def phantoms(events: DataFrame, key: str) -> DataFrame:
    """After an episode's last place and the first terminal that follows, onsets open a span: from the
    first of them on, events have low confidence and ``after_task``."""
    whole = Window.partitionBy(key)
    d = events.withColumn("_p", F.max(F.when(F.col("kind") == "place", F.col("start"))).over(whole))
    d = d.withColumn("_t", F.min(F.when((F.col("kind") == "terminal") & (F.col("start") > F.col("_p")), F.col("start"))).over(whole))
    d = d.withColumn("_o", F.min(F.when((F.col("kind") == "onset") & (F.col("start") > F.col("_t")), F.col("start"))).over(whole))
    after = F.coalesce(F.col("start") >= F.col("_o"), F.lit(False))
    return d.withColumn("after_task", after).withColumn("conf", F.when(after, "low").otherwise(F.col("conf"))).drop("_p", "_t", "_o")


def brief(runs: DataFrame, keys, least: float, most: float, first: float, peak: float) -> DataFrame:
    """Runs of [least, most) with a peak, after ``first`` and before the first longer run: each gives a
    contact and a drop of low confidence."""
    long = F.min(F.when(F.col("end") - F.col("start") >= most, F.col("start"))).over(Window.partitionBy(*keys))
    d = runs.withColumn("_l", long).filter((F.col("end") - F.col("start") >= least) & (F.col("end") - F.col("start") < most) & (F.col("peak") >= peak) & (F.col("start") > first) & F.coalesce(F.col("start") < F.col("_l"), F.lit(True)))
    two = F.array(F.struct(F.col("start").alias("start"), F.lit("contact").alias("kind")), F.struct(F.col("end").alias("start"), F.lit("drop").alias("kind")))
    return d.select(*keys, F.explode(two).alias("e")).select(*keys, "e.start", "e.kind", F.lit("low").alias("conf"))


def merged_attempts(spans: DataFrame, keys, reopened: str, least: float) -> DataFrame:
    """Neighbouring failed spans are one while the opening between them is under the limit."""
    w = Window.partitionBy(*keys).orderBy("start")
    d = spans.withColumn("_n", F.when(F.lag(reopened).over(w) < least, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w.rowsBetween(START, 0)))
    return d.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("_g")


def anchors(bouts: DataFrame, keys, length: str) -> DataFrame:
    """(keys, approach, grasp, transport, place, end): starts of the stages of an episode from its first
    and last bout; without a bout the grasp is at a quarter and the place at nine tenths."""
    g = bouts.groupBy(*keys, length).agg(F.min("start").alias("a"), F.min("stable").alias("s"), F.max("end").alias("e"))
    grasp = F.coalesce("a", 0.25 * F.col(length))
    place = F.greatest(F.coalesce("e", 0.9 * F.col(length)), grasp)
    return g.select(*keys, F.lit(0.0).alias("approach"), grasp.alias("grasp"), F.greatest(F.least(F.coalesce("s", grasp), place), grasp).alias("transport"), place.alias("place"), F.col(length).alias("end"))


def to_atoms(events: DataFrame, subtasks: DataFrame, key: str) -> DataFrame:
    """Events and stages as annotation atoms: (key, timestamp, style, role, content, origin)."""
    from ..functions.scalars import atom_content

    none = F.lit(None).cast("int")
    e = events.select(key, F.col("start").alias("timestamp"), F.lit("interjection").alias("style"), F.lit("user").alias("role"), atom_content(F.col("kind"), F.col("conf"), none, F.col("start").cast("double"), F.lit(None).cast("string")).alias("content"), F.lit(None).cast("string").alias("origin"))
    s = subtasks.select(key, F.col("start").alias("timestamp"), F.lit("subtask").alias("style"), F.lit("assistant").alias("role"), F.col("label").alias("content"), F.lit("auto").alias("origin"))
    return e.unionByName(s)


def closed_spans(df: DataFrame, keys, order, t: str, flag: Column, x: Column, least: float) -> DataFrame:
    """(keys, start, end, first, peak): stretches where the flag holds, to the row that ends them, of a
    least duration; one that no row ends is left out (incipient slip, rotation)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = islands.run_ids(df.withColumns({"_x": x, "_next": F.lead(t).over(w), "_end": F.lead(F.lit(True)).over(w)}), keys, order, flag).filter("_f")
    d = d.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max("_next").alias("end"), F.min_by("_x", F.struct(*order)).alias("first"), F.max("_x").alias("peak"), F.count_if(F.col("_end").isNull()).alias("_open"))
    return d.filter((F.col("_open") == 0) & (F.col("end") - F.col("start") >= least)).drop("run", "_open")


def capability_flags(df: DataFrame, keys, t: str, x: str, enter: float, jaw: Column, arm: Column, layout: bool = True, verified: bool = True, base: bool = False) -> DataFrame:
    """(keys, flags, approach_end): what an episode cannot support, in a fixed order, ``no_contact`` last.
    Only an episode without contact has an approach_end: its whole length is one approach."""
    d = df.groupBy(*keys).agg(F.max(t).alias("_end"), F.max(x).alias("_peak"), F.count(jaw).alias("_jaw"), F.count(arm).alias("_arm"))
    none = F.coalesce(F.col("_peak") < enter, F.lit(True))
    told = [(F.lit(not layout), "no_layout"), (F.col("_jaw") < 3, "no_gripper"), (F.col("_arm") < 3, "no_arm"), (F.lit(not verified), "profile_unverified"), (F.lit(base), "base_mode"), (none, "no_contact")]
    return d.select(*keys, F.array_compact(F.array(*[F.when(c, name) for c, name in told])).alias("flags"), F.when(none & (F.col("_end") > 0), F.col("_end")).alias("approach_end"))


def below_exit(x: Column, leave: float, loaded: Column, quantum: Column, quanta: float = 1.5) -> Column:
    """Whether contact is over: under the exit force, or held by one loaded taxel at ``quanta`` steps
    of the sensor or less. Without a count or a step only the force decides."""
    return (x < leave) | F.coalesce((quantum > 0) & (loaded <= 1) & (x <= quanta * quantum), F.lit(False))


def flags_in_time(flags: DataFrame, keys, place: str, flag: str, is_span: Column, base: bool) -> DataFrame:
    """(keys, flags): an episode's flags by the time after their ``@``, those without one last, else in
    their order of ``place``; in base mode flags of spans go."""
    d = flags.filter(~is_span) if base else flags
    at = F.regexp_extract(flag, r"@([\d.]+)", 1).try_cast("double")
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(at, F.lit(float("inf"))).alias("at"), F.col(place).alias("place"), F.col(flag).alias("flag"))))
    return d.groupBy(*keys).agg(rows["flag"].alias("flags"))


def evaluation_flags(flags: Column, result: Column, released: Column) -> Column:
    """The flags with ``result_<result>`` where an episode that released its object did not succeed; the
    first ``hesitation`` then goes."""
    at = F.array_position(flags, F.lit("hesitation")).cast("int")
    rest = F.when(at > 0, F.concat(F.slice(flags, F.lit(1), at - 1), F.slice(flags, at + 1, F.size(flags)))).otherwise(flags)
    return F.when(F.coalesce((result != "success") & released, F.lit(False)), F.array_append(rest, F.concat(F.lit("result_"), result))).otherwise(flags)


def after_events(events: DataFrame, rows: DataFrame, keys, start: str, t: str, x: str, step: float, steps: int) -> DataFrame:
    """(keys, start, step, peak): greatest value in each of the ``steps`` closed intervals after an event, 0
    where none is greater. Rows meet events by bins of the whole reach, so a long episode is spread."""
    reach = step * steps
    e = events.select(*keys, F.col(start).alias("start")).distinct()
    grid = e.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    e = e.withColumn("_b", F.explode(F.array(F.floor(F.col("start") / reach), F.floor(F.col("start") / reach) + 1)))
    d = e.join(rows.select(*keys, F.col(t).alias("_t"), F.col(x).alias("_x"), F.floor(F.col(t) / reach).alias("_b")), [*keys, "_b"])
    at = F.floor((F.col("_t") - F.col("start")) / step).cast("int")
    d = d.withColumn("step", F.explode(F.sequence(at - 1, at + 1)))  # a row on a border is in both
    a = F.col("start") + F.col("step") * step
    d = d.filter((F.col("_t") >= a) & (F.col("_t") <= a + step)).groupBy(*keys, "start", "step").agg(F.max("_x").alias("_m"))
    return grid.join(d, [*keys, "start", "step"], "left").select(*keys, "start", "step", F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(0.0)).alias("peak"))


def rise_to_end(df: DataFrame, keys, order, x: str, out: str) -> DataFrame:
    """How far the value still rises above each row's until the series ends, 0 at the least."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(START, -1)
    return df.withColumn(out, F.greatest(F.coalesce(F.max(x).over(w) - F.col(x), F.lit(0.0)), F.lit(0.0)))
