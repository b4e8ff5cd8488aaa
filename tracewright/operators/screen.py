"""Screening windows against labelled references: features, z-scores and nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metric
from .tables import kept

START = Window.unboundedPreceding
BACKGROUND = "background"


@dataclass(frozen=True)
class Screen:
    """How windows are cut and judged; times in the unit of t."""

    half: float = 0.35
    points: int = 16
    outside: float = 0.05
    rough_rows: int = 10
    gap: float = 0.5
    per_series: int = 2
    k: int = 7
    least_votes: int = 4
    least_rows: int = 50


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vec: str, group: str, label: str) -> DataFrame:
    """(query, rank, id, label, distance): the k nearest rows of other groups, by Euclidean distance.
    Ties go to the lesser id."""
    return metric.nearest(metric.build(rows, id_col, vec, group, label), queries, k, id_col, vec, group, once=True)


def votes(neighbours: DataFrame, k: int, background) -> DataFrame:
    """(query, votes): background labels among the k nearest; null with fewer than k."""
    return neighbours.groupBy("query").agg(F.when(F.count("*") >= k, F.count_if(F.col("label") == background)).alias("votes"))


def zscores(df: DataFrame, cols, keys=()) -> DataFrame:
    """Columns less their mean over their population deviation (floored at 1e-9)."""
    s = df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias(f"{c}_s") for c in cols])
    d = df.join(s, list(keys)) if keys else df.crossJoin(F.broadcast(s))
    return d.select(*[c for c in df.columns if c not in cols], *[((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) for c in cols])


def window_features(signal: DataFrame, centres: DataFrame, keys, t: str, x: str, half: float, points: int) -> DataFrame:
    """(keys, centre, features): the signal interpolated at ``points`` even times around each centre,
    then means before and after and their difference; null where the window leaves the series."""
    from . import asof

    ends = signal.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    c = centres.select(*keys, F.col(t).alias("centre")).join(ends, keys).filter((F.col("centre") - half >= F.col("_lo")) & (F.col("centre") + half <= F.col("_hi")))
    step = 2 * half / (points - 1)
    grid = c.select(*keys, "centre", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn(t, F.col("centre") - half + F.col("k") * step)
    g = asof.interpolated(grid, signal, keys, t, x, "v").groupBy(*keys, "centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("p"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    pre, post = mean(F.slice("p", 1, points // 2)), mean(F.slice("p", points // 2 + 1, points))
    return g.select(*keys, "centre", F.concat("p", F.array(pre, post, post - pre)).alias("features"))


def with_roughness(samples: DataFrame, keys, t: str, x: str, rows: int, out: str) -> DataFrame:
    """Mean size of the last ``rows`` steps of x; the first row counts as a step of 0."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = samples.withColumn("_d", F.coalesce(F.abs(F.col(x) - F.lag(x).over(w)), F.lit(0.0)))
    near = w.rowsBetween(1 - rows, 0)
    return d.withColumn(out, F.sum("_d").over(near) / F.count("*").over(near)).drop("_d")


def terminal_windows(samples: DataFrame, centres: DataFrame, keys, t: str, channels, s: Screen = Screen()) -> DataFrame:
    """The centres (keys, t, ...) with ``v``: every channel at ``points`` even times around the centre, then
    the first channel's means before and after, their difference, and the last channel's maximum.

    Centres whose window leaves the series by more than ``outside`` are dropped. All channels are
    interpolated in one pass of running neighbours.
    """
    keys = list(keys)
    ends = samples.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    c = centres.withColumn("_c", F.struct(*[x for x in centres.columns if x not in keys])).join(ends.hint("merge"), keys)
    c = c.filter((F.col(t) - s.half >= F.col("_lo") - s.outside) & (F.col(t) + s.half <= F.col("_hi") + s.outside))
    grid = c.select(*keys, "_c", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(s.points - 1)), lambda g: F.col(t) - s.half + 2 * s.half * g / (s.points - 1))).alias("_g", "_t"))
    none = lambda like: F.lit(None).cast(like)
    row = samples.select(*keys, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(channels)]).alias("_v"))
    both = grid.select(*keys, "_t", "_c", "_g", none(row.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_s")).unionByName(row.select(*keys, "_t", none(grid.schema["_c"].dataType).alias("_c"), none("int").alias("_g"), "_v", F.lit(0).alias("_s")))
    back = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_s").rowsBetween(START, 0))
    ahead = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_s")).rowsBetween(START, 0))
    g = both.withColumn("_b", back).withColumn("_a", ahead).filter("_c is not null")
    span = F.greatest(F.col("_a.t") - F.col("_b.t"), F.lit(1e-9))

    def at(i: int) -> Column:
        b, a = F.col(f"_b.x{i}"), F.col(f"_a.x{i}")
        return F.when(F.col("_b").isNull(), a).when(F.col("_a").isNull(), b).otherwise(b + (F.col("_t") - F.col("_b.t")) / span * (a - b))

    got = g.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct("_g", *[at(i).alias(f"x{i}") for i in range(len(channels))]))).alias("_p"))
    of = lambda i: F.transform("_p", lambda p: p[f"x{i}"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda u, v: u + v) / F.size(a)
    first = of(0)
    pre, post = mean(F.slice(first, 1, s.points // 2)), mean(F.slice(first, s.points // 2 + 1, s.points))
    v = F.concat(*[of(i) for i in range(len(channels))], F.array(pre, post, post - pre, F.array_max(of(len(channels) - 1))))
    return got.withColumn("v", v).select(*keys, "_c.*", "v")


def background_centres(samples: DataFrame, events: DataFrame, keys, t: str, s: Screen = Screen()) -> DataFrame:
    """(keys, t): of a series' samples at least ``gap`` from every event, and a window from both ends, the
    ones at even shares of their number (with two: a third and two thirds)."""
    keys = list(keys)
    both = samples.select(*keys, t, F.lit(None).cast("double").alias("_e")).unionByName(events.select(*keys, t, F.col(t).alias("_e")))
    before = F.max("_e").over(Window.partitionBy(*keys).orderBy(t).rangeBetween(START, 0))
    after = F.min("_e").over(Window.partitionBy(*keys).orderBy(F.desc(t)).rangeBetween(START, 0))
    w = Window.partitionBy(*keys)
    d = both.withColumns({"_before": before, "_after": after}).filter("_e is null").withColumns({"_lo": F.min(t).over(w), "_hi": F.max(t).over(w)})
    far = F.coalesce(F.col(t) - F.col("_before") >= s.gap, F.lit(True)) & F.coalesce(F.col("_after") - F.col(t) >= s.gap, F.lit(True))
    d = d.filter(far & (F.col(t) >= F.col("_lo") + s.half) & (F.col(t) <= F.col("_hi") - s.half))
    d = d.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(t)) - 1})
    picks = [F.floor(F.col("_n") * b / (s.per_series + 1)) for b in range(1, s.per_series + 1)]
    return d.filter(F.col("_r").isin(*picks)).select(*keys, t)


@dataclass
class Reference:
    """A corpus of labelled windows: ``rows`` (keys, label, id, v) and ``scaler`` (mean, std), one row;
    ``windows``: the rows (keys, t, label, v) before they were rounded."""

    rows: DataFrame
    scaler: DataFrame
    keys: tuple[str, ...]
    windows: DataFrame | None = None

    def scaled(self, windows: DataFrame) -> DataFrame:
        """``z``: v less the corpus mean over its deviation (1e-9 at least)."""
        z = lambda v, m, d: (v - m) / F.greatest(d, F.lit(1e-9))
        d = windows.crossJoin(F.broadcast(self.scaler))  # one row of two arrays
        return d.withColumn("z", F.zip_with(F.arrays_zip("v", "mean"), "std", lambda a, d: z(a["v"], a["mean"], d))).drop("mean", "std")


def reference(samples: DataFrame, events: DataFrame, keys, t: str, channels, s: Screen = Screen()) -> Reference:
    """The corpus of a table: windows of ``events`` (keys, t, label) and of the background between them.
    The scaler is rounded to four decimals and the vectors to three, as a stored corpus is."""
    keys = tuple(keys)
    samples = kept(samples, "samples")
    own = kept(terminal_windows(samples, events.select(*keys, t, "label").distinct(), keys, t, channels, s), "own")
    quiet = background_centres(samples, own.select(*keys, t), keys, t, s).withColumn("label", F.lit(BACKGROUND))
    windows = rows = own.unionByName(kept(terminal_windows(samples, quiet, keys, t, channels, s), "quiet"))
    dims = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    one = dims.agg(F.array_sort(F.collect_list(F.struct("i", F.round("m", 4).alias("m"), F.round("d", 4).alias("d")))).alias("s"))
    scaler = one.select(F.transform("s", lambda x: x["m"]).alias("mean"), F.transform("s", lambda x: x["d"]).alias("std"))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.round(x, 3))).withColumn("id", F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys], F.col(t).cast("string"), "label"))
    return Reference(rows, scaler, keys, windows)


def background_votes(ref: Reference, windows: DataFrame, keys, t: str, s: Screen = Screen(), exclude: bool = True) -> DataFrame:
    """The windows (keys, t, ..., v) with ``votes``: background windows among the k nearest of the corpus, rows
    of the same keys left out (``exclude``). Null with fewer than k, or with a corpus under ``least_rows``.
    Every window is compared under the bounds of an exact index; nothing is sampled."""
    keys = list(keys)
    group = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]).alias("_grp") if exclude else F.lit(None).cast("string").alias("_grp")
    if ref.rows.limit(s.least_rows).count() < s.least_rows:
        return windows.withColumn("votes", F.lit(None).cast("long"))
    rows = ref.scaled(ref.rows).select("id", "label", "z", F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]).alias("_grp"))
    name = [*keys, t]
    ask = ref.scaled(windows.select(*name, "v").distinct()).select(F.struct(*name).alias("q"), "z", group)
    found = metric.nearest(metric.build(rows, "id", "z", "_grp", "label"), ask, s.k, "q", "z", "_grp", once=True)
    counted = votes(found, s.k, BACKGROUND).select(*[F.col(f"query.{c}").alias(c) for c in name], "votes")
    return windows.join(counted, name, "left")


def screened(judged: DataFrame, kind: str, s: Screen = Screen()) -> DataFrame:
    """``artifact`` where at least ``least_votes`` neighbours are background, and ``flag`` where such an event
    is still named place, release or drop: the screen neither renames nor deletes."""
    artifact = F.coalesce(F.col("votes") >= s.least_votes, F.lit(False))
    return judged.withColumn("artifact", artifact).withColumn("flag", F.when(artifact & F.col(kind).isin("place", "release", "drop"), "residual_suspect"))
