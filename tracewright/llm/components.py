"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Tasks to which the edges of one vertex are dealt when they meet its minimum.
SALTS = 16
#: Edges for which one file is written in a round.
EDGES_PER_FILE = 100_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (u, v) with u's minimum m. A hub may have a third of all edges: they are dealt out by
    their other ends, and the minimum goes to each of these places."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("_s")
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_s"))
    return edges.select("u", "v", salt).join(spread, ["u", "_s"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _with_least(down, least).select("v", "m").union(least.select(F.col("u").alias("v"), "m")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): the least vertex that each vertex of an edge can reach.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest
    path; no vertex's neighbours are gathered in one place (only minima are).
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    before, files = None, None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == sums:
            break
        before, files = sums, -(-sums[0] // EDGES_PER_FILE) or 1
        now = written(_small(_large(now)).distinct(), "edges", files)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
