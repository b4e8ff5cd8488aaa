"""Window primitives over ordered series. ``keys`` partition, ``order`` sorts; all frames are rows
unless a time is named. Row-count frames take literal sizes; time frames use a long order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def median5(df: DataFrame, keys, order, x: str, out: str, interior: bool = False) -> DataFrame:
    """Upper median of the centred five, cut at the edges; ``interior`` leaves the edges as they are."""
    w = _w(keys, order)
    five = F.array_sort(F.collect_list(x).over(w.rowsBetween(-2, 2)))
    med = F.get(five, F.floor(F.size(five) / 2).cast("int"))
    return df.withColumn(out, F.when(F.size(five) == 5, med).otherwise(F.col(x)) if interior else med)


def moving_rms(df: DataFrame, keys, order, x: str, win: int, out: str) -> DataFrame:
    return df.withColumn(out, F.sqrt(F.avg(F.col(x) * F.col(x)).over(_w(keys, order).rowsBetween(-(win - 1), 0))))


def derivative(df: DataFrame, keys, order, x: str, t: str, out: str) -> DataFrame:
    """Backward difference over the time step, 0 for steps of 1e-9 or less; the first takes the second's."""
    w = _w(keys, order)
    dt = F.col(t) - F.lag(t).over(w)
    df = df.withColumn("_d", F.when(dt > 1e-9, (F.col(x) - F.lag(x).over(w)) / dt).when(dt.isNotNull(), 0.0))
    return df.withColumn(out, F.coalesce("_d", F.lead("_d").over(w), F.lit(0.0))).drop("_d")


def relative_std(df: DataFrame, keys, order, x: str, win: int, out: str) -> DataFrame:
    """Population deviation over the mean of the ``win`` rows before (the row itself excluded);
    infinite with fewer than two rows or a mean near 0.

    Squares are summed by Welford's update, row by row, as DuckDB does: a quotient that ends in a half must not
    depend on how the deviation was reached."""
    rows = F.collect_list(F.col(x).cast("double")).over(_w(keys, order).rowsBetween(-win, -1))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (v - s["mean"]) / n
        return F.struct(n.alias("n"), (s["sum"] + v).alias("sum"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    def ratio(s: Column) -> Column:
        mean = F.abs(s["sum"] / s["n"])
        return F.when((s["n"] > 1) & (mean > 1e-9), F.sqrt(s["squares"] / s["n"]) / mean).otherwise(F.lit(float("inf")))

    return df.withColumn(out, F.aggregate(rows, zero, step, ratio))


def mean_abs_diff(df: DataFrame, keys, order, x: str, win: int, out: str) -> DataFrame:
    """Rolling mean of absolute steps (a roughness measure); the first step is 0."""
    w = _w(keys, order)
    df = df.withColumn("_s", F.coalesce(F.abs(F.col(x) - F.lag(x).over(w)), F.lit(0.0)))
    return df.withColumn(out, F.avg("_s").over(w.rowsBetween(-(win - 1), 0))).drop("_s")


def lagged_rate(df: DataFrame, keys, order, x: str, t: str, n: int, out: str) -> DataFrame:
    w = _w(keys, order)
    return df.withColumn(out, F.coalesce((F.col(x) - F.lag(x, n).over(w)) / F.nullif(F.col(t) - F.lag(t, n).over(w), F.lit(0.0)), F.lit(0.0)))


def joint_speed(df: DataFrame, keys, order, joints, out: str, total: bool = False) -> DataFrame:
    """Greatest (or summed) absolute change of the joints from the frame before; 0 at the start."""
    w = _w(keys, order)
    steps = [F.coalesce(F.abs(F.col(j) - F.lag(j).over(w)), F.lit(0.0)) for j in joints]
    whole = steps[0]
    for s in steps[1:]:
        whole = whole + s
    return df.withColumn(out, whole if total else F.greatest(*steps) if len(steps) > 1 else steps[0])


def excursion(df: DataFrame, keys, order, x: str, out: str) -> DataFrame:
    """Fall from the running maximum and rise from the running minimum."""
    w = _w(keys, order).rowsBetween(START, 0)
    return df.withColumn(f"{out}_fall", F.max(x).over(w) - F.col(x)).withColumn(f"{out}_rise", F.col(x) - F.min(x).over(w))


def plateau(df: DataFrame, keys, clock: str, x: str, span: int, out: str) -> DataFrame:
    """Greatest value of the last ``span`` units of a long clock."""
    return df.withColumn(out, F.max(x).over(Window.partitionBy(*keys).orderBy(clock).rangeBetween(-span, 0)))


def forward_quiet(df: DataFrame, keys, clock: str, x: str, span: int, limit: float, out: str) -> DataFrame:
    """Whether the value stays below the limit for ``span`` to come; false where the series ends before."""
    w = Window.partitionBy(*keys).orderBy(clock)
    last = F.max(clock).over(Window.partitionBy(*keys))
    return df.withColumn(out, (F.max(x).over(w.rangeBetween(0, span)) < limit) & (F.col(clock) + span <= last))


def even_positions(df: DataFrame, keys, order, target: int) -> DataFrame:
    """``target`` rows at round(k * (n - 1) / (target - 1)), all rows of shorter series."""
    w = _w(keys, order)
    d = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    # row r is position k for the k's that round to r: find the least k with floor(k (n-1)/(t-1) + .5) >= r
    k = F.ceil((F.col("_r") - 0.5) * (target - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (k >= 0) & (k < target) & (F.floor(k * (F.col("_n") - 1) / (target - 1) + 0.5) == F.col("_r"))
    return d.filter((F.col("_n") <= target) | hit).drop("_r", "_n")


def resampled(df: DataFrame, keys, t: str, x: str, points: int, out: str = "x") -> DataFrame:
    """Linear interpolation at ``points`` even times from the first to the last sample.

    The grid is joined by position: samples carry the next sample, and each grid time falls into
    one such segment, so no grid point meets all samples.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    whole = Window.partitionBy(*keys)
    d = df.select(*keys, F.col(t).alias("_t"), F.col(x).alias("_x"), F.lead(t).over(w).alias("_t1"), F.lead(x).over(w).alias("_x1"), F.min(t).over(whole).alias("_a"), F.max(t).over(whole).alias("_b"), F.row_number().over(w).alias("_r"))
    step = (F.col("_b") - F.col("_a")) / (points - 1)
    lo = F.when(F.col("_r") == 1, 0).otherwise(F.floor((F.col("_t") - F.col("_a")) / step) - 1)
    hi = F.when(F.col("_t1").isNull(), points - 1).otherwise(F.floor((F.col("_t1") - F.col("_a")) / step) + 1)
    d = d.filter("_b > _a").withColumn("k", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.greatest(F.least(hi, F.lit(points - 1)), F.greatest(lo, F.lit(0))).cast("int"))))
    at = F.when(F.col("k") == points - 1, F.col("_b")).otherwise(F.col("_a") + F.col("k") * step)
    d = d.withColumn("_at", at).filter((F.col("_at") >= F.col("_t")) & (F.col("_at").__lt__(F.col("_t1")) | F.col("_t1").isNull()))
    value = F.when(F.col("_t1").isNull() | (F.col("_t1") == F.col("_t")), F.col("_x")).otherwise(F.col("_x") + (F.col("_x1") - F.col("_x")) * (F.col("_at") - F.col("_t")) / (F.col("_t1") - F.col("_t")))
    return d.select(*keys, "k", value.alias(out)).groupBy(*keys, "k").agg(F.max(out).alias(out))


def best_split(df: DataFrame, keys, order, x: str, least: int) -> DataFrame:
    """The single split with the greatest drop in squared cost, each side of ``least`` rows or more."""
    w = _w(keys, order).rowsBetween(START, 0)
    whole = Window.partitionBy(*keys)
    d = df.select(*keys, F.row_number().over(_w(keys, order)).alias("at"), F.sum(x).over(w).alias("head"), F.sum(x).over(whole).alias("all"), F.count("*").over(whole).alias("n"))
    gain = F.pow("head", F.lit(2)) / F.col("at") + F.pow(F.col("all") - F.col("head"), F.lit(2)) / (F.col("n") - F.col("at")) - F.pow("all", F.lit(2)) / F.col("n")
    d = d.filter((F.col("at") >= least) & (F.col("n") - F.col("at") >= least)).withColumn("gain", F.round(gain, 4))
    best = d.groupBy(*keys).agg(F.max(F.struct("gain", -F.col("at"), F.col("at").alias("split"))).alias("m"))
    return best.select(*keys, F.col("m.split").cast("long").alias("split"), F.col("m.gain").alias("gain"))


def unwrapped(df: DataFrame, keys, order, angle: str, out: str) -> DataFrame:
    """Angles without jumps of more than pi: the running sum of wrapped steps."""
    import math

    w = _w(keys, order)
    step = F.coalesce(F.col(angle) - F.lag(angle).over(w), F.lit(0.0))
    turn = F.floor(step / (2 * math.pi) + 0.5) * 2 * math.pi
    return df.withColumn("_s", F.coalesce(F.first(angle).over(w), F.lit(0.0)) * 0 + step - turn).withColumn(out, F.first(angle).over(w) + F.sum("_s").over(w.rowsBetween(START, 0))).drop("_s")


def sustain(df: DataFrame, keys, order, x: str) -> DataFrame:
    """Net change over total variation per series, and the least-squares slope over the row number."""
    w = _w(keys, order)
    d = df.select(*keys, F.col(x).alias("_x"), F.abs(F.col(x) - F.lag(x).over(w)).alias("_s"), F.row_number().over(w).cast("double").alias("_r"), F.first(x).over(w).alias("_f"), F.last(x).over(w.rowsBetween(START, Window.unboundedFollowing)).alias("_l"))
    g = d.groupBy(*keys).agg(F.sum("_s").alias("tv"), F.max("_f").alias("f"), F.max("_l").alias("l"), F.when(F.count("*") >= 4, F.regr_slope("_x", "_r")).alias("slope"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.col("tv").alias("variation"), F.when(F.col("tv") > 0, F.abs(F.col("l") - F.col("f")) / F.col("tv")).otherwise(0.0).alias("sustain"), "slope")


def initial_baseline(df: DataFrame, keys, order, t: str, x: str, jaw: str, least: float, fall: float) -> DataFrame:
    """(keys, rows, baseline): upper median of the first rows, which last until the jaw fell by ``fall``
    from its running maximum, ``least`` at the least; three rows or more where there are as many."""
    w = _w(keys, order)
    d = df.withColumns({"_top": F.max(jaw).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(w)})
    closing = F.min(F.when(F.col(jaw) < F.col("_top") - fall, F.col(t)))
    n = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1"), closing.alias("_close"))
    span = F.greatest(F.lit(least), F.coalesce(F.col("_close") - F.col("_t0"), F.lit(least)))
    rate = F.when(F.col("_t1") > F.col("_t0"), (F.col("_n") - 1) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    n = n.select(*keys, F.least("_n", F.greatest(F.lit(3), F.floor(rate * span + 0.5))).alias("rows"))
    d = d.join(n, keys).filter(F.col("_k") <= F.col("rows")).filter(F.col(x).isNotNull())
    w = Window.partitionBy(*keys)
    d = d.withColumns({"_r": F.row_number().over(w.orderBy(x)), "_m": F.count("*").over(w)})
    return d.filter(F.col("_r") == F.floor(F.col("_m") / 2) + 1).select(*keys, "rows", F.col(x).alias("baseline"))


def slope(df: DataFrame, keys, t: str, x: str, least: int = 4) -> DataFrame:
    """(keys, n, slope): least-squares slope over the finite points, null with fewer than ``least``."""
    d = df.filter(~F.isnan(x) & (F.abs(x) != float("inf")))
    return d.groupBy(*keys).agg(F.count(x).alias("n"), F.regr_slope(x, t).alias("slope")).withColumn("slope", F.when(F.col("n") >= least, F.col("slope")))


def change_gated(df: DataFrame, keys, order, regions: dict[str, list[str]], out: str) -> DataFrame:
    """Rows in which a region changed, with a bit mask of those that did; a first row has all bits."""
    w = _w(keys, order)
    first = F.row_number().over(w) == 1
    changed = [F.when(first | ~F.struct(*cols).eqNullSafe(F.lag(F.struct(*cols)).over(w)), 1 << k).otherwise(0) for k, cols in enumerate(regions.values())]
    return df.withColumn(out, sum(changed[1:], changed[0])).filter(F.col(out) > 0)


def strided(df: DataFrame, keys, order, most: int) -> DataFrame:
    """Every step-th row, step = max(1, floor(rows / most))."""
    w = _w(keys, order)
    d = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    return d.filter(F.col("_k") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).drop("_k", "_n")
