"""As-of, nearest and range joins.

As-of joins are one union, one sort per key and direction, and a running last value: no row meets
more than its neighbours, and each frame grows by one row at a time. Rows of one time go by their
values. Range joins are equi-joins on time bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def _union(left: DataFrame, right: DataFrame, keys, t: str, value: str, right_first: bool) -> DataFrame:
    """Both sides in one table: _l the left row, _v the right value with its time."""
    lrow, rrow = F.struct(*left.columns), F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    a = left.select(*keys, F.col(t).alias("_t"), F.lit(1 if right_first else 0).alias("_s"), lrow.alias("_l"))
    b = right.select(*keys, F.col(t).alias("_t"), F.lit(0 if right_first else 1).alias("_s"), rrow.alias("_v"))
    return a.unionByName(b, allowMissingColumns=True)


def _before(keys) -> Column:
    """The last right value at or before each row."""
    return F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_s", "_v").rowsBetween(START, 0))


def _after(keys, own: bool = False) -> Column:
    """The first right value after each row (``own``: the row itself included), as a running last
    value in descending order: a frame that reaches forward is computed anew for every row."""
    return F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_s"), F.desc("_v")).rowsBetween(START, 0 if own else -1))


def backward(left: DataFrame, right: DataFrame, keys, t: str, value: str, out: str, clamp: bool = False) -> DataFrame:
    """The right value at or before each left time; with ``clamp`` the first one where none is before."""
    u = _union(left, right, keys, t, value, True).withColumn("_b", _before(keys))
    if clamp:
        u = u.withColumn("_b", F.coalesce("_b", F.min("_v").over(Window.partitionBy(*keys))))
    return u.filter("_l is not null").select("_l.*", F.col("_b.v").alias(out))


def nearest(left: DataFrame, right: DataFrame, keys, t: str, value: str, out: str, tolerance: float | None = None, later: bool = False) -> DataFrame:
    """The right value nearest in time; ties go to the earlier one (``later``: to the later one).

    Left rows without a partner within the tolerance are dropped.
    """
    u = _union(left, right, keys, t, value, True)
    u = u.withColumn("_b", _before(keys)).withColumn("_a", _after(keys)).filter("_l is not null")
    back, ahead = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    first = back.isNotNull() & (ahead.isNull() | (back < ahead if later else back <= ahead))
    u = u.withColumn("_g", F.when(first, back).otherwise(ahead)).withColumn("_p", F.when(first, F.col("_b.v")).otherwise(F.col("_a.v")))
    u = u.filter("_g is not null")
    if tolerance is not None:
        u = u.filter(F.col("_g") <= tolerance)
    return u.select("_l.*", F.col("_p").alias(out), F.col("_g").alias(f"{out}_gap"))


def interpolated(left: DataFrame, right: DataFrame, keys, t: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of the right series at the left times, held at its ends."""
    u = _union(left, right, keys, t, value, True)
    u = u.withColumn("_b", _before(keys)).withColumn("_a", _after(keys)).filter("_l is not null")
    span = F.col("_a.t") - F.col("_b.t")
    mid = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_t") - F.col("_b.t")) / span
    return u.select("_l.*", F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (span <= 0), F.col("_b.v")).otherwise(mid).alias(out))


def bracket_slope(left: DataFrame, right: DataFrame, keys, t: str, value: str, out: str) -> DataFrame:
    """The slope of the right pair whose later member is the first at or after each left time; the
    last pair beyond the end."""
    w = Window.partitionBy(*keys).orderBy(t)
    pair = right.select(*keys, F.col(t), ((F.col(value) - F.lag(value).over(w)) / F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0))).alias("_slope")).filter("_slope is not null")
    u = _union(left, pair, keys, t, "_slope", False)
    u = u.withColumn("_a", _after(keys, own=True)).withColumn("_z", F.max("_v").over(Window.partitionBy(*keys)))
    return u.filter("_l is not null").select("_l.*", F.coalesce("_a.v", "_z.v").alias(out))


def within(left: DataFrame, right: DataFrame, keys, t: str, reach: float, how: str = "inner", left_t: Column | None = None) -> DataFrame:
    """Pairs of rows at most ``reach`` apart: each right row goes to its bin and the two beside it.

    Right columns get the prefix ``r_``. ``how``: inner, left_semi or left_anti.
    """
    a = left.withColumn("_bin", F.floor(F.col(t) / reach))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.sequence(F.floor(F.col(t) / reach) - 1, F.floor(F.col(t) / reach) + 1)).alias("r__bin"))
    on = (F.abs(a[t] - b[f"r_{t}"]) <= reach) & (a["_bin"] == b["r__bin"])
    for k in keys:
        on = on & (a[k] == b[f"r_{k}"])
    return a.join(b, on, how).drop("_bin", "r__bin")
