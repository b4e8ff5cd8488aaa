"""Statistics over series and episodes. Quantile rules differ by operator and are named in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values for running sums over a whole table.
BINS = 4096


def half_up(x: Column, digits: int) -> Column:
    """Round with halves toward plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def upper_median(x: str) -> Column:
    """sorted[floor(n / 2)] of a group."""
    a = F.sort_array(F.collect_list(x))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def rank_value(df: DataFrame, keys, x: str, share: float, out: str) -> DataFrame:
    """sorted[floor(share * n)] of each episode, by row numbers; ``rank_values`` is for large groups."""
    w = Window.partitionBy(*keys)
    d = df.filter(F.col(x).isNotNull()).select(*keys, x, F.row_number().over(w.orderBy(x)).alias("_r"), F.count("*").over(w).alias("_n"))
    return d.filter(F.col("_r") == F.least(F.floor(F.col("_n") * share) + 1, F.col("_n"))).select(*keys, F.col(x).alias(out))


def running(df: DataFrame, keys, x: str, measures: dict[str, Column]) -> DataFrame:
    """(keys, x, measures, <m>_below, <m>_total): sums for each distinct value, over all lesser values
    of its group, and over the group.

    Two levels: values are counted first, then dealt to BINS equal ranges of the group's values, whose
    sums run over at most BINS rows; so a group of any size is spread over many tasks. Null values go.
    """
    c = df.filter(F.col(x).isNotNull()).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], x).agg(*[m.alias(n) for n, m in measures.items()])
    own = [f"_k{i}" for i in range(len(keys))]
    ends = c.groupBy(*[F.col(k).alias(f"{k}_") for k in own]).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    equal = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in own]
    part = c.join(ends, equal) if own else c.crossJoin(F.broadcast(ends))
    place = F.floor((F.col(x).cast("double") - F.col("_lo")) * BINS / (F.col("_hi") - F.col("_lo")))
    part = part.withColumn("_p", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(0)).drop("_lo", "_hi", *[f"{k}_" for k in own])
    sums = part.groupBy(*own, "_p").agg(*[F.sum(n).alias(n) for n in measures])
    w = Window.partitionBy(*own)
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"{k}_") for k in own], F.col("_p").alias("_p_"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_base") for n in measures], *[F.sum(n).over(w).alias(f"{n}_total") for n in measures])
    inner = Window.partitionBy(*own, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    d = part.select("*", *[F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(f"{n}_own") for n in measures])
    d = d.join(base, [*equal, F.col("_p") == F.col("_p_")])
    return d.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], x, *measures, *[(F.col(f"{n}_base") + F.col(f"{n}_own")).alias(f"{n}_below") for n in measures], *[f"{n}_total" for n in measures])


def rank_values(df: DataFrame, keys, x: str, shares: dict[str, float]) -> DataFrame:
    """sorted[floor(share * n)] of few large groups, for several shares at once."""
    r = running(df, keys, x, {"n": F.count("*")})
    at = lambda p: F.least(F.floor(F.col("n_total") * p), F.col("n_total") - 1)
    hit = lambda p: (F.col("n_below") <= at(p)) & (at(p) < F.col("n_below") + F.col("n"))
    return r.groupBy(*keys).agg(*[F.max(F.when(hit(p), F.col(x))).alias(out) for out, p in shares.items()])


def min_max(df: DataFrame, columns) -> DataFrame:
    """(column, min, max) of the finite values, to 3 digits."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    ok = long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    return ok.groupBy("column").agg(half_up(F.min("v"), 3).alias("min"), half_up(F.max("v"), 3).alias("max"))


def length_stats(lengths: DataFrame, n: str, fps: float) -> DataFrame:
    """One row: shortest, longest, mean, population deviation about the rounded mean, median, in seconds."""
    d = lengths.select(half_up(F.col(n) / fps, 2).alias("s"))
    a = d.agg(F.count("*").alias("episodes"), F.min("s").alias("shortest"), F.max("s").alias("longest"), half_up(F.avg("s"), 2).alias("mean"), half_up(F.percentile("s", F.lit(0.5)), 2).alias("median"), F.sum(F.col("s") * F.col("s")).alias("_q"), F.sum("s").alias("_s"))
    var = F.greatest(F.col("_q") / F.col("episodes") - 2 * F.col("mean") * F.col("_s") / F.col("episodes") + F.col("mean") * F.col("mean"), F.lit(0.0))
    return a.select("episodes", "shortest", "longest", "mean", "median", half_up(F.sqrt(var), 2).alias("std"))


def histogram(df: DataFrame, keys, x: str, bins: int) -> DataFrame:
    """(keys, bin, n): equal widths from the least to the greatest value, the last bin closed."""
    lo, hi = F.min(x).over(Window.partitionBy(*keys)), F.max(x).over(Window.partitionBy(*keys))
    b = F.when(hi > lo, F.least(F.floor((F.col(x) - lo) * bins / (hi - lo)), F.lit(bins - 1))).otherwise(0)
    return df.select(*keys, b.cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def nice_histogram(df: DataFrame, x: str) -> DataFrame:
    """(start, n): bins of a 1/2/2.5/5/10 step over the 1st to 99th percentile, outliers in the edge bins."""
    a = df.agg(F.percentile(x, F.lit(0.01)).alias("lo"), F.percentile(x, F.lit(0.99)).alias("hi"), F.count(x).alias("n"))
    bins = F.greatest(F.lit(10), F.least(F.lit(50), F.ceil(F.log2("n") + 1)))
    a = a.withColumn("raw", (F.col("hi") - F.col("lo")) / bins).withColumn("mag", F.pow(F.lit(10.0), F.floor(F.log10("raw"))))
    f = F.col("raw") / F.col("mag")
    a = a.withColumn("step", F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 2.5, 2.5).when(f <= 5, 5.0).otherwise(10.0) * F.col("mag"))
    a = a.select("step", F.floor(F.col("lo") / F.col("step")).alias("a"), F.ceil(F.col("hi") / F.col("step")).alias("b"))
    k = F.greatest(F.col("a"), F.least(F.floor(F.col(x) / F.col("step")), F.col("b") - 1))
    return df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(a)).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.first("step").alias("step")).select(F.round(F.col("k") * F.col("step"), 6).alias("start"), "n")


def cross_episode_variance(df: DataFrame, key: str, i: str, dims, bins: int = 50) -> DataFrame:
    """(bin, dim, variance): each episode resampled to the bins by nearest index; population variance, 0 with fewer than two."""
    w = Window.partitionBy(key)
    d = df.withColumn("_n", F.count("*").over(w))
    # row i serves the bins b with floor(b (n-1)/(bins-1) + .5) = i
    step = (F.col("_n") - 1) / F.lit(float(bins - 1))
    lo = F.when(F.col("_n") == 1, 0).otherwise(F.ceil((F.col(i) - 0.5) / step - 1))
    hi = F.when(F.col("_n") == 1, bins - 1).otherwise(F.floor((F.col(i) + 0.5) / step + 1))
    d = d.withColumn("bin", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(bins - 1)).cast("int"))))
    d = d.filter(F.floor(F.col("bin") * step + 0.5) == F.col(i))
    long = d.select("bin", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("v")) for c in dims])).alias("e"))
    return long.groupBy("bin", "e.dim").agg(F.when(F.count("e.v") > 1, F.var_pop("e.v")).otherwise(0.0).alias("variance"), F.count("e.v").alias("episodes"))


def movement(df: DataFrame, key: str, order, dims) -> DataFrame:
    """(key, frames, score): mean L2 norm of frame deltas to 4 digits; 0 for a single frame."""
    w = Window.partitionBy(key).orderBy(*order)
    total = F.lit(0.0)
    for c in dims:
        total = total + F.pow(F.col(c) - F.lag(c).over(w), 2)
    return df.select(key, F.sqrt(total).alias("m")).groupBy(key).agg(F.count("*").alias("frames"), half_up(F.coalesce(F.avg("m"), F.lit(0.0)), 4).alias("score"))


def motor_profile(df: DataFrame, key: str, order, x: str) -> DataFrame:
    """(key, range, distinct, discrete, p95_step, active): range 1 where it is 0; active from a step
    at sorted[floor(0.95 n)] of 0.001 of the range."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.select(key, F.col(x).alias("v"), F.abs(F.col(x) - F.lag(x).over(w)).alias("s"))
    g = d.groupBy(key).agg((F.max("v") - F.min("v")).alias("r"), F.count_distinct("v").alias("distinct"))
    p = rank_value(d, [key], "s", 0.95, "p95_step")
    r = F.when(F.col("r") == 0, 1.0).otherwise(F.col("r"))
    return g.join(p, key, "left").select(key, r.alias("range"), "distinct", (F.col("distinct") <= 4).alias("discrete"), F.coalesce("p95_step", F.lit(0.0)).alias("p95_step"), (F.coalesce("p95_step", F.lit(0.0)) >= 0.001 * r).alias("active"))


def autocorrelation(df: DataFrame, key: str, i: str, x: str, max_lag: int) -> DataFrame:
    """(lag, acf, episodes): sum(c_t c_t+lag) / sum(c^2) per episode, averaged over episodes of at
    least twice the largest lag; an episode without variance adds 0.

    The lags are leads over one sort: no self-join.
    """
    whole = Window.partitionBy(key)
    d = df.select(key, F.col(i).alias("i"), (F.col(x) - F.avg(x).over(whole)).alias("c"), F.count("*").over(whole).alias("n")).filter(F.col("n") >= 2 * max_lag)
    w = Window.partitionBy(key).orderBy("i")
    sums = d.select(key, "c", *[F.lead("c", k).over(w).alias(f"l{k}") for k in range(1, max_lag + 1)]).groupBy(key).agg(F.sum(F.col("c") * F.col("c")).alias("v"), *[F.sum(F.col("c") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("v") > 0, F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("v")).otherwise(0.0).alias("a")) for k in range(1, max_lag + 1)])
    return sums.select(F.explode(pairs).alias("e")).groupBy("e.lag").agg(F.avg("e.a").alias("acf"), F.count("*").alias("episodes"))


def cross_correlation(df: DataFrame, key: str, i: str, a: str, b: str, max_lag: int) -> DataFrame:
    """(key, lag, r): correlation of the deltas of a with those of b ``lag`` rows later, means over the
    whole series and norms over the overlap."""
    w = Window.partitionBy(key).orderBy(i)
    d = df.select(key, F.col(i).alias("i"), (F.col(a) - F.lag(a).over(w)).alias("x"), (F.col(b) - F.lag(b).over(w)).alias("y")).filter("x is not null and y is not null")
    whole = Window.partitionBy(key)
    d = d.select(key, "i", (F.col("x") - F.avg("x").over(whole)).alias("x"), (F.col("y") - F.avg("y").over(whole)).alias("y"))
    shift = lambda k: F.lead("y", k).over(w) if k > 0 else F.lag("y", -k).over(w) if k < 0 else F.col("y")
    lags = range(-max_lag, max_lag + 1)
    d = d.select(key, "x", *[shift(k).alias(f"y{k + max_lag}") for k in lags])
    aggs = []
    for k in lags:
        y = F.col(f"y{k + max_lag}")
        norm = F.sqrt(F.sum(F.when(y.isNotNull(), F.col("x") * F.col("x"))) * F.sum(y * y))
        aggs.append(F.struct(F.lit(k).alias("lag"), F.when(norm > 1e-12, F.sum(F.col("x") * y) / norm).otherwise(0.0).alias("r")))
    return d.groupBy(key).agg(F.array(*aggs).alias("e")).select(key, F.explode("e").alias("e")).select(key, "e.lag", "e.r")


def speed_profile(df: DataFrame, key: str, x: str) -> DataFrame:
    """(key, n, mean, std, cv, verdict)."""
    g = df.filter(F.col(x).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    g = g.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0))
    return g.withColumn("verdict", F.when(F.col("cv") < 0.2, "consistent").when(F.col("cv") < 0.4, "moderate").otherwise("varied"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a rate, within 0 and 1; (0, 0) without trials."""
    p = k / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / den
    none = n <= 0
    return F.when(none, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))), F.when(none, 0.0).otherwise(F.least(mid + half, F.lit(1.0)))


def average_ranks(df: DataFrame, keys, x: str, out: str) -> DataFrame:
    """Ranks with ties at their mean. The counts of equal values come from an aggregation, so a
    frequent value meets in no one row."""
    w = Window.partitionBy(*keys).orderBy(x)
    same = Window.partitionBy(*keys, x)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def mann_whitney(df: DataFrame, group: str, x: str) -> DataFrame:
    """One row: n1, n2, U and AUC = U / (n1 n2) of group true over group false, by running sums over
    the distinct values."""
    d = running(df, [], x, {"a": F.count_if(F.col(group)), "b": F.count_if(~F.col(group))}).withColumn("below", F.col("b_below"))
    g = d.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"))
    return g.select("n1", "n2", "u", (F.col("u") / (F.col("n1") * F.col("n2"))).alias("auc"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation over the rows that have both; null where one of them is constant, where F.corr divides by zero."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """(keys, n, rho): correlation of average ranks, null where all values of one side are equal."""
    d = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))


def duplicate_census(df: DataFrame, keys, order, x: str, step: float) -> DataFrame:
    """(keys, pairs, exact, flicker, real, longest): consecutive pairs by size of change, and the
    longest stretch of exact repeats."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(w)))
    d = d.withColumn("_g", F.sum(F.when(F.col("_d") == 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_len", F.sum(F.when(F.col("_d") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "_g")))
    return d.groupBy(*keys).agg(F.count("_d").alias("pairs"), F.count_if(F.col("_d") == 0).alias("exact"), F.count_if((F.col("_d") > 0) & (F.col("_d") <= step)).alias("flicker"), F.count_if(F.col("_d") > step).alias("real"), F.max("_len").alias("longest"))
