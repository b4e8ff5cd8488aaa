"""Names of one side to names of another: a cascade of rules with one winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of joint names and what a column's suffix then holds; fixed values of the naming scheme.
PATTERNS = [(r"^openarm_(left|right)_joint(\d+)$", "$1_joint_$2"), (r"^openarm_(left|right)_finger_joint1$", "$1_gripper")]
MIMIC = "finger_joint2"


def matched_joints(joints: DataFrame, columns: DataFrame, key: str, aliases: DataFrame, delimiter: str = r"\|") -> DataFrame:
    """(key, joint, column, rule): the column that drives each joint; joints without one have no row.

    ``joints``: (key, joint); ``columns``: (key, column, place); ``aliases``: (suffix, joint), both in
    lower case. A column's suffix is what follows its last delimiter. In turn: a suffix that equals the
    joint; an alias (the last column that has one); a pattern's text inside a suffix; the joint inside a
    whole column name. A mimic joint takes only the first two or its pattern. Elsewhere the column with the least
    place wins. Exact and alias matches are equi-joins; the two that look inside a name compare what one
    key has, a robot's joints with its columns.
    """
    j = joints.select(key, "joint", F.lower("joint").alias("_j")).distinct()
    suffix = F.lower(F.trim(F.element_at(F.split("column", delimiter), -1)))
    c = columns.select(key, "column", F.col("place").cast("long").alias("place"), suffix.alias("_s"), F.lower("column").alias("_c"))
    pick = lambda d, rule, order: d.select(key, "joint", F.struct(F.lit(rule).alias("rule"), order.alias("order"), F.col("column")).alias("m"))
    exact = pick(j.join(c, (j[key] == c[key]) & (j["_j"] == c["_s"])).drop(c[key]), 1, F.col("place"))
    named = c.join(aliases.select(F.col("suffix").alias("_s"), F.col("joint").alias("_a")), "_s")
    alias = pick(j.join(named, (j[key] == named[key]) & (j["_j"] == named["_a"])).drop(named[key]), 2, -F.col("place"))
    text = F.coalesce(*[F.when(F.col("_j").rlike(p), F.regexp_replace("_j", p, to)) for p, to in PATTERNS])
    inside = j.withColumn("_p", text).join(c, key)
    within = pick(inside.filter(F.col("_s").contains(F.col("_p"))), 3, F.col("place"))
    fuzzy = pick(inside.filter(F.col("_c").contains(F.col("_j")) & ~F.col("_j").contains(MIMIC)), 4, F.col("place"))
    best = exact.unionByName(alias).unionByName(within).unionByName(fuzzy).groupBy(key, "joint").agg(F.min("m").alias("m"))
    rule = F.element_at(F.array(*[F.lit(n) for n in ("exact", "alias", "pattern", "fuzzy")]), F.col("m.rule"))
    return best.select(key, "joint", F.col("m.column").alias("column"), rule.alias("rule"))
