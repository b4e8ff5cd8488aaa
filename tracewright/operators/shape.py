"""Shaping series and blocks: clipping, pairing of names, reduction of sensor blocks, instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(df: DataFrame, keys, t: str, limit: Column, least: int = 5) -> DataFrame:
    """Rows up to the limit; a series that would keep fewer than ``least`` stays whole."""
    keep = F.col(t) <= limit
    n = F.count_if(keep).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(keep | (F.col("_n") < least)).drop("_n")


def pair_by_suffix(names: DataFrame, name: str) -> DataFrame:
    """(action, state) names of equal suffix; where no suffix matches at all, pairs by position."""
    part = lambda k: F.element_at(F.split(name, r" \| "), k)
    n = names.select(F.col(name).alias("name"), part(1).alias("kind"), part(-1).alias("suffix")).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("name")))
    a = n.filter("kind = 'action'").select(F.col("name").alias("action"), "suffix", "place")
    s = n.filter("kind = 'state'").select(F.col("name").alias("state"), F.col("suffix").alias("s_suffix"), F.col("place").alias("s_place"))
    equal = a.join(s, F.col("suffix") == F.col("s_suffix")).select("action", "state")
    placed = a.join(s, F.col("place") == F.col("s_place")).select("action", "state")
    return equal.unionByName(placed.join(equal.select(F.lit(1).alias("_")).limit(1), F.lit(True), "left_anti"))


def block_channels(block: Column, taxels: int, y: list[float], floor: float = 0.05, mass: float = 0.2) -> list[Column]:
    """fn, fs, cop_y and active of a flat block of (fx, fy, fz) taxels.

    The centre of pressure counts taxels with fz above the floor and is null under the least mass.
    """
    at = lambda k, a: F.get(block, 3 * k + a).cast("double")
    total = lambda parts: sum(parts[1:], parts[0])
    fz = [at(k, 2) for k in range(taxels)]
    up = [F.when(z > floor, z).otherwise(0.0) for z in fz]
    weight = total(up)
    fn = total([F.greatest(z, F.lit(0.0)) for z in fz])
    fs = F.hypot(total([at(k, 0) for k in range(taxels)]), total([at(k, 1) for k in range(taxels)]))
    cop = F.when(weight > mass, total([u * v for u, v in zip(up, y, strict=True)]) / weight)
    return [fn.alias("fn"), fs.alias("fs"), cop.alias("cop_y"), total([F.when(z > 0.15, 1).otherwise(0) for z in fz]).alias("active")]


def axis_stats(df: DataFrame, block: str, keys=()) -> DataFrame:
    """(keys, axis, n, min, max, mean, std, q50): statistics of an array column for each place in it."""
    long = df.select(*keys, F.posexplode(block).alias("axis", "v"))
    v = F.col("v").cast("double")
    return long.groupBy(*keys, "axis").agg(F.count("v").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("q50"))


def progress(df: DataFrame, key: str, order, candidates, duration: Column) -> DataFrame:
    """(key, rank, at, progress): the first candidate that is finite, at even times over the duration."""
    w = Window.partitionBy(key).orderBy(*order)
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    n = F.count("*").over(Window.partitionBy(key))
    d = df.withColumn("progress", F.coalesce(*[ok(c) for c in candidates])).withColumn("rank", F.row_number().over(w) - 1)
    return d.select(key, "rank", (F.col("rank") / F.greatest(n - 1, F.lit(1)) * duration).alias("at"), "progress")


def actuated(df: DataFrame, keys, x: str, scale: float) -> DataFrame:
    """(keys, range, moved, actuated): whether a gripper works: a range of 15 % of its scale, and a
    move of more than 35 % of the range from its first value."""
    g = df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("range"), F.greatest(F.max(x) - F.min_by(x, "i"), F.min_by(x, "i") - F.min(x)).alias("moved"))
    return g.withColumn("actuated", (F.col("range") >= 0.15 * scale) & (F.col("moved") > 0.35 * F.col("range")))


def gripper_series(long: DataFrame, key: str, t: str, name: str, place: str, value: str) -> DataFrame:
    """(key, t, value) of an episode's first series named like a gripper, never an action; none where it
    has two points or fewer."""
    d = long.filter(F.col(name).rlike("(?i)gripper") & ~F.col(name).rlike("(?i)^action"))
    first = d.groupBy(key).agg(F.min_by(name, place).alias(name))
    d = d.join(first, [key, name]).filter(F.col(t).isNotNull() & F.col(value).isNotNull())
    return _of_size(d, key, 3).select(key, t, value)


def arm_series(long: DataFrame, key: str, t: str, name: str, place: str, value: str) -> DataFrame:
    """(key, t, joints): frames in which every ``.pos`` series of the episode (no action, no gripper) has a
    number; none where there are two or fewer."""
    d = long.filter(F.col(name).rlike(r"(?i)\.pos$") & ~F.col(name).rlike("(?i)^action") & ~F.col(name).rlike("(?i)gripper") & F.col(t).isNotNull())
    names = d.groupBy(key).agg(F.count_distinct(name).alias("_names"))
    real = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(place).alias("p"), F.col(value).alias("v")))
    d = d.groupBy(key, t).agg(F.array_sort(F.collect_list(real))["v"].alias("joints")).join(names, key).filter(F.size("joints") == F.col("_names"))
    return _of_size(d, key, 3).select(key, t, "joints")


def _of_size(df: DataFrame, key: str, least: int) -> DataFrame:
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key), key, "left_semi")


def episode_files(files: DataFrame, episodes: DataFrame, dataset: str, episode: str, path: str) -> DataFrame:
    """(dataset, episode, path): files below an episode's folder ``episode_NNNNNN/``; all files of the
    dataset where it has no such folders."""
    tag = F.regexp_extract(path, r"episode_(\d{6})/", 1)
    f = files.withColumn(episode, F.when(tag != "", tag.cast("long")))
    scoped = f.filter(F.col(episode).isNotNull())
    flat = f.drop(episode).join(scoped.select(dataset).distinct(), dataset, "left_anti")
    e = episodes.select(dataset, episode)
    return e.join(scoped, [dataset, episode]).select(dataset, episode, path).unionByName(e.join(flat, dataset).select(dataset, episode, path))


def block_faults(raw: Column, corrected: Column) -> tuple[Column, Column, Column, Column]:
    """Of flat blocks of (fx, fy, fz) taxels: negative corrected loads, a load made from an all-zero
    block, a corrected sum above the raw one, and by how much it is above."""
    z = lambda b: F.filter(b, lambda _, k: k % 3 == 2)
    total = lambda b: F.aggregate(z(b), F.lit(0.0), lambda a, v: a + v)
    over = total(corrected) - total(raw)
    made = ~F.exists(raw, lambda v: v != 0) & F.exists(corrected, lambda v: v != 0)
    return F.size(F.filter(z(corrected), lambda v: v < 0)), made, over > 1e-9, F.greatest(over, F.lit(0.0))


def paired_rows(df: DataFrame, keys, flat: str, first: int, names: tuple[str, str]) -> DataFrame:
    """(keys, row, names): a frame of ``first`` values of one column and then those of another as rows, the
    shorter column padded with nulls; an empty frame has no rows."""
    parts = [F.slice(flat, 1, first), F.slice(flat, F.lit(first + 1), F.greatest(F.size(flat) - first, F.lit(0)))]
    d = df.select(*keys, *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    return d.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("row", "_v")).select(*keys, "row", *[F.col(f"_v.{n}") for n in names])


def by_position(groups: list[DataFrame], keys, place: str) -> DataFrame:
    """Chart groups side by side: rows of equal position are one row, null where a group is shorter."""
    out = groups[0]
    for g in groups[1:]:
        out = out.join(g, [*keys, place], "full")
    return out


def csv_text(df: DataFrame, keys, order: str, columns) -> DataFrame:
    """(keys, csv): a group's rows in order as lines, values joined by commas without quotes, nulls empty."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(rows["line"], "\n").alias("csv"))
