"""Set operations and diffs of annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def multiset_diff(a: DataFrame, b: DataFrame, cols) -> DataFrame:
    """(cols, surplus): how often a holds a row more than b (negative: less); equal rows are left out."""
    both = a.select(*cols, F.lit(1).alias("k")).unionByName(b.select(*cols, F.lit(-1).alias("k")))
    return both.groupBy(*cols).agg(F.sum("k").alias("surplus")).filter("surplus <> 0")


def three_way_diff(ours: DataFrame, theirs: DataFrame, keys, identity: str, content: str, t: str, reach: float) -> DataFrame:
    """(keys, identity, status, t, t_theirs): exact pairs are unchanged; of the rest, rows that are
    each other's nearest within reach pair (moved with equal content, else modified); others stand alone."""
    from .asof import within

    mark = lambda d: d.select(*keys, identity, content, t).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, identity, content, t).orderBy(F.lit(0))))
    a, b = mark(ours), mark(theirs)
    exact = [*keys, identity, content, t, "_n"]
    same = a.join(b, exact, "left_semi")
    left, right = a.join(b, exact, "left_anti"), b.join(a, exact, "left_anti")
    left = left.withColumn("_id", F.xxhash64(*exact))
    right = right.withColumn("_id", F.xxhash64(*exact))
    near = within(left, right, [*keys, identity], t, reach).withColumn("gap", F.abs(F.col(t) - F.col(f"r_{t}")))
    best = lambda col: F.row_number().over(Window.partitionBy(col).orderBy("gap", F.col(t), F.col(f"r_{t}"), "_id", "r__id"))
    pairs = near.withColumn("_x", best("_id")).withColumn("_y", best("r__id")).filter("_x = 1 and _y = 1")
    status = F.when(F.col(content).eqNullSafe(F.col(f"r_{content}")), "moved").otherwise("modified")
    out = same.select(*keys, identity, F.lit("unchanged").alias("status"), t, F.col(t).alias("t_theirs"))
    out = out.unionByName(pairs.select(*keys, identity, status.alias("status"), t, F.col(f"r_{t}").alias("t_theirs")))
    out = out.unionByName(left.join(pairs.select("_id"), "_id", "left_anti").select(*keys, identity, F.lit("only_ours").alias("status"), t, F.lit(None).cast("double").alias("t_theirs")))
    rest = right.join(pairs.select(F.col("r__id").alias("_id")), "_id", "left_anti")
    return out.unionByName(rest.select(*keys, identity, F.lit("only_theirs").alias("status"), F.lit(None).cast("double").alias(t), F.col(t).alias("t_theirs")))
