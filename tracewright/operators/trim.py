"""Trimming episodes: proposals, row re-basing, metadata and annotations of the kept windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import islands


def propose(df: DataFrame, keys, i: str, command: str, measured: str, speed: float, onset_hold: int, end_hold: int, lead: int, tail: int) -> DataFrame:
    """(keys, frames, onset, stop, start, end): from the first sustained commanded motion, less the
    lead, to the last sustained measured motion, plus the tail, within the episode."""
    w = Window.partitionBy(*keys).orderBy(i)
    d = df.withColumn("_c", F.coalesce(F.abs(F.col(command) - F.lag(command).over(w)), F.lit(0.0))).withColumn("_m", F.coalesce(F.abs(F.col(measured) - F.lag(measured).over(w)), F.lit(0.0)))
    n = df.groupBy(*keys).agg(F.count("*").alias("frames"))
    on = islands.sustained(d, keys, [i], F.col("_c") > speed, i, onset_hold).select(*keys, F.col("first").alias("onset"))
    off = islands.sustained(d, keys, [i], F.col("_m") > speed, i, end_hold).select(*keys, F.col("last").alias("stop"))
    out = n.join(on, keys, "left").join(off, keys, "left")
    return out.withColumn("start", F.greatest(F.coalesce(F.col("onset") - lead, F.lit(0)), F.lit(0))).withColumn("end", F.least(F.coalesce(F.col("stop") + tail, F.col("frames") - 1), F.col("frames") - 1))


def check_cuts(cuts: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The cuts; a negative start or an end before the start is an error."""
    bad = (F.col(start) < 0) | (F.col(end) < F.col(start))
    return cuts.withColumn(start, F.when(bad, F.raise_error(F.concat(F.lit("bad cut "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")))).otherwise(F.col(start)))


def rebase(df: DataFrame, cuts: DataFrame, key: str, i: str, fps: float, renumber: bool = False) -> DataFrame:
    """Keep frames start to end (both inclusive) of each cut episode, all frames of others; new
    frame_index, timestamp = frame_index / fps, contiguous index over episodes in order.

    The index is the frame plus the running length of the episodes before, which is a sum over
    episodes, not over rows.
    """
    d = df.join(cuts.select(key, "start", "end"), key, "left").filter(F.col("start").isNull() | F.col(i).between(F.col("start"), F.col("end")))
    d = d.withColumn("frame_index", F.col(i) - F.coalesce("start", F.lit(0))).withColumn("timestamp", F.col("frame_index") / F.lit(fps)).drop("start", "end")
    m = metadata(d, key)
    new = F.col("episode_number") if renumber else F.col(key)
    return d.join(m, key).withColumn("index", F.col("from_index") + F.col("frame_index")).withColumn("new_episode", new).drop("from_index", "to_index", "length", "episode_number")


def metadata(df: DataFrame, key: str) -> DataFrame:
    """(key, length, from_index, to_index, episode_number): one row an episode, offsets by running sum.

    Episodes are summed in BLOCK-sized ranges of the key first, so that no window holds all of them.
    """
    n = df.groupBy(key).agg(F.count("*").alias("length")).withColumn("_b", F.floor(F.col(key) / BLOCK))
    per = n.groupBy("_b").agg(F.sum("length").alias("s"), F.count("*").alias("c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("count"))
    own = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = n.join(base, "_b").withColumn("to_index", F.col("base") + F.sum("length").over(own)).withColumn("episode_number", F.col("count") + F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1)
    return out.select(key, "length", (F.col("to_index") - F.col("length")).alias("from_index"), "to_index", "episode_number")


#: Episodes of one partial sum.
BLOCK = 10_000


def shift_atoms(atoms: DataFrame, windows: DataFrame, key: str, ts: str) -> DataFrame:
    """Atoms moved by their window's start; those outside [-1e-9, kept + 1e-9] go, starts are held at 0.

    ``windows``: (key, shift, kept) in seconds. Atoms without a number stay as they are.
    """
    d = atoms.join(windows, key)
    moved = F.col(ts) - F.col("shift")
    return d.filter(F.col(ts).isNull() | moved.between(-1e-9, F.col("kept") + 1e-9)).withColumn(ts, F.greatest(moved, F.lit(0.0))).drop("shift", "kept")


def decided(existing: DataFrame, proposals: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """(key, start, end, source, reviewed): decisions after a run of the rule. One that was adjusted or
    reviewed always stays, any other unless ``overwrite``; new ones are of source ``rule``, not reviewed."""
    fixed = (F.col("source") == "adjusted") | F.coalesce("reviewed", F.lit(False)) | F.lit(not overwrite)
    kept = existing.select(key, "start", "end", "source", "reviewed").filter(F.coalesce(fixed, F.lit(False)))
    new = proposals.join(kept.select(key), key, "left_anti").select(key, "start", "end", F.lit("rule").alias("source"), F.lit(False).alias("reviewed"))
    untouched = existing.select(key, "start", "end", "source", "reviewed").filter(~F.coalesce(fixed, F.lit(False))).join(proposals.select(key), key, "left_anti")
    return kept.unionByName(new).unionByName(untouched)


def cut_sidecar(rows: DataFrame, cuts: DataFrame, key: str, clock: str, fps: float) -> DataFrame:
    """Sensor rows of [start, start + kept) frames on a nanosecond clock that begins at ``begin_ns``, with
    the new beginning; episodes without a beginning keep all rows."""
    ns = lambda c: F.bround(F.col(c) / F.lit(fps) * F.lit(1e9)).cast("long")
    c = cuts.select(key, (F.col("begin_ns") + ns("start_frame")).alias("begin_ns"), ns("kept_frames").alias("_span"))
    d = rows.join(c, key)
    return d.filter(F.col("begin_ns").isNull() | ((F.col(clock) >= F.col("begin_ns")) & (F.col(clock) < F.col("begin_ns") + F.col("_span")))).drop("_span")


def rekeyed(df: DataFrame, episodes: DataFrame, key: str, new: str) -> DataFrame:
    """Rows of the episodes that stayed, under their new numbers."""
    return df.join(episodes.select(key, F.col(new).alias("_new")), key).withColumn(key, F.col("_new")).drop("_new")


def together(parts: list[DataFrame], key: str, order) -> DataFrame:
    """One table of several, columns by name and null where a part has none, in order of episodes and parts."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.sort(key, "part", *order)
