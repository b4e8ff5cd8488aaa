"""Extremes over arbitrary intervals, and the spans that hold a point, by dyadic blocks.

Time is cut into blocks of one width; two neighbours make a block of the next level, and so on. A table holds
each block's extremes. An interval is a few whole blocks (two for each level at most) and the rows of
the blocks at its two ends, so a long interval meets few rows and a long episode is spread over its blocks:
all joins are on (keys, level, block). Levels go as high as the times of the rows reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of blocks at most; a block of the last one spans 2**16 blocks of the first. Rows of a task that makes the table.
LEVELS, TASK_ROWS = 16, 250_000


def _ancestors(block: Column, top: int) -> Column:
    """(level, block) of every block that holds this one, itself first."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda s: F.struct(s.alias("level"), F.floor(block / F.pow(F.lit(2.0), s)).cast("long").alias("block")))


def _cover(a: Column, b: Column, top: int = LEVELS) -> Column:
    """(level, block): the fewest blocks that make up the blocks [a, b) of the first level."""

    def at(s: Column) -> Column:
        size = F.pow(F.lit(2.0), s)
        lo, hi = F.ceil(a / size).cast("long"), F.floor(b / size).cast("long")
        inner = F.when(s == top, F.when(lo < hi, F.sequence(lo, hi - 1)))
        ends = F.when(lo < hi, F.array_compact(F.array(F.when(F.pmod(lo, F.lit(2)) == 1, lo), F.when(F.pmod(hi, F.lit(2)) == 1, hi - 1))))
        blocks = F.coalesce(inner, F.when(s < top, ends), F.array().cast("array<long>"))
        return F.transform(blocks, lambda k: F.struct(s.alias("level"), k.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))


def _extent(rows: DataFrame, t: str, width: float) -> tuple[int, int, int]:
    """The first and last block that rows are in, and the number of rows."""
    leaf = F.floor(F.col(t) / width)
    low, high, n = rows.agg(F.min(leaf), F.max(leaf), F.count("*")).first()
    return low or 0, high or 0, n


def block_extremes(rows: DataFrame, keys, t: str, x: str, width: float, top: int = LEVELS) -> DataFrame:
    """(keys, level, block, least, greatest, rows): the table of all levels up to ``top``."""
    leaf = rows.filter(F.col(t).isNotNull()).groupBy(*keys, F.floor(F.col(t) / width).alias("leaf")).agg(F.min(x).alias("least"), F.max(x).alias("greatest"), F.count(x).alias("rows"))
    up = leaf.select(*keys, F.explode(_ancestors(F.col("leaf"), top)).alias("at"), "least", "greatest", "rows").select(*keys, "at.level", "at.block", "least", "greatest", "rows")
    return up.groupBy(*keys, "level", "block").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("rows").alias("rows"))


def _probe(level: Column, block: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), block.cast("long").alias("block"))


def extremes(asked: DataFrame, rows: DataFrame, keys, lo: str, hi: str, t: str, x: str, width: float, prefix: str = "", open_start: bool = False) -> DataFrame:
    """The rows of ``asked`` with ``least``, ``greatest`` and ``rows`` of x over [lo, hi] (``open_start``: (lo, hi]),
    null and 0 where it is empty. Nulls in x are skipped; an interval without ends is empty.

    ``asked`` is read once: each row is sent to its blocks and its two ends, and put together again. Its
    columns can be grouped by (no maps). ``rows`` is read three times, so it should be a table; blocks are made of
    rows dealt by their keys to tasks that grow with their number, without a shuffle of what the blocks repeat.
    """
    keys = list(keys)
    low, high, n = _extent(rows, t, width)
    top = min((high - low).bit_length(), LEVELS)
    tasks = max(math.ceil(n / TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    table = rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(-1).alias("__l"), F.floor(F.col(t) / width).alias("__b"), F.col(t).alias("__t"), F.col(x).alias("__low"), F.col(x).alias("__top"), F.lit(1).cast("long").alias("__n")).filter("__low is not null")
    blocks = block_extremes(rows.select(*keys, t, x).repartition(tasks, *keys), keys, t, x, width, top)
    table = table.unionByName(blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("level").alias("__l"), F.col("block").alias("__b"), F.lit(None).cast(table.schema["__t"].dataType).alias("__t"), F.col("least").alias("__low"), F.col("greatest").alias("__top"), F.col("rows").alias("__n")))
    first, last = F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)
    ends = F.array_distinct(F.transform(F.array(first, last), lambda b: _probe(F.lit(-1), b)))
    inner = _cover(F.greatest(first + 1, F.lit(low)), F.least(last, F.lit(min(high + 1, 2**63 - 1))), top)
    whole = F.when(last - first > 1, F.transform(inner, lambda c: _probe(c["level"], c["block"]))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    probes = F.when(F.col(lo) <= F.col(hi), F.concat(ends, whole)).otherwise(F.array(_probe(F.lit(None), F.lit(None))))
    d = asked.groupBy(*asked.columns).agg(F.count("*").alias("__copies")).withColumn("__p", F.explode(probes))
    inside = (F.col("__t") > F.col(lo)) if open_start else (F.col("__t") >= F.col(lo))
    on = (F.col("__p.level") == F.col("__l")) & (F.col("__p.block") == F.col("__b")) & ((F.col("__l") >= 0) | (inside & (F.col("__t") <= F.col(hi))))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    d = d.join(table, on, "left").groupBy(*asked.columns, "__copies").agg(F.min("__low").alias(f"{prefix}least"), F.max("__top").alias(f"{prefix}greatest"), F.coalesce(F.sum("__n"), F.lit(0)).alias(f"{prefix}rows"))
    return _copied(d)


def _copied(d: DataFrame) -> DataFrame:
    """As many equal rows as there were."""
    return d.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).drop("__copies")


def stabbed(points: DataFrame, spans: DataFrame, keys, t: str, lo: str, hi: str, width: float, out: str, wild: str | None = None) -> DataFrame:
    """The points with ``out``: whether one lies in a span [lo, hi] of its keys. A span whose ``wild`` column is
    null holds for every value of it.

    Points and spans are put in order of time once: a point lies in a span if the furthest end of the spans that
    began by then is not before it. Every row is shuffled once, whatever the spans' lengths and ``width``."""
    keys = list(keys)
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    name = F.lit(None).cast("string") if wild is None else F.col(wild).cast("string")
    known = spans.filter(F.col(lo) <= F.col(hi)).dropna(subset=keys)
    s = known.select(*own, name.alias("__w"), F.col(lo).cast("double").alias("__t"), F.lit(0).alias("__s"), F.col(hi).cast("double").alias("__hi"))
    p = points.select(*own, name.alias("__w"), F.col(t).cast("double").alias("__t"), F.lit(1).alias("__s"), F.struct(*points.columns).alias("__p"))
    by, so_far = [f"__k{i}" for i in range(len(keys))], (Window.unboundedPreceding, 0)
    d = p.unionByName(s, allowMissingColumns=True)
    every = F.max(F.when(F.col("__w").isNull(), F.col("__hi"))).over(Window.partitionBy(*by).orderBy("__t", "__s").rowsBetween(*so_far))
    d = d.withColumn("__far", every)
    if wild is not None:
        d = d.withColumn("__far", F.greatest("__far", F.max("__hi").over(Window.partitionBy(*by, "__w").orderBy("__t", "__s").rowsBetween(*so_far))))
    return d.filter("__s = 1").select("__p.*", F.coalesce(F.col("__far") >= F.col("__t"), F.lit(False)).alias(out))
