"""Registered queries: rollout stages, joint names, and events through SQL table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, rollout, shape, table_functions
from .catalog import K, query, rounded
from .catalog_data import LATCH
from .views import SIGNAL, signal, table

R = rollout.Stages()
FOUND = f"""{SIGNAL}, fr AS (SELECT episode, i, CASE WHEN x > 20 THEN x ELSE 0 END AS area, jaw * 6.4 AS px, x AS py, label = 'error' AND x > 150 AS near FROM sig),
bw AS (SELECT DISTINCT episode, 300.0::DOUBLE AS bx, 60.0::DOUBLE AS bby, 180.0::DOUBLE AS br FROM sig WHERE episode % 3 > 0), gr AS (SELECT episode, max(jaw) - min(jaw) >= 15 AND greatest(max(jaw) - arg_min(jaw, i), arg_min(jaw, i) - min(jaw)) > 0.9::DOUBLE * (max(jaw) - min(jaw)) AS grip FROM sig GROUP BY ALL),
sn AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY i) AS n, row_number() OVER (PARTITION BY episode ORDER BY i DESC) AS back FROM fr WHERE area > 0),
ba AS (SELECT episode, list_sort(list(area))[len(list(area)) // 2 + 1] AS base FROM sn WHERE n <= {R.head} GROUP BY ALL),
hi AS (SELECT sn.*, area > {R.gain}::DOUBLE * base AS h, sqrt((px - bx) ** 2 + (py - bby) ** 2) AS away FROM sn JOIN ba USING (episode) LEFT JOIN bw USING (episode)),
lu AS (SELECT a.episode, min(a.away) AS bd, count(*) > 0 AS up FROM hi a JOIN hi b ON b.episode = a.episode AND b.n = a.n - 1 JOIN hi c ON c.episode = a.episode AND c.n = a.n - 2 WHERE a.h AND b.h AND c.h GROUP BY ALL),
tl AS (SELECT episode, list_sort(list(px))[len(list(px)) // 2 + 1] AS fx, list_sort(list(py))[len(list(py)) // 2 + 1] AS fy FROM sn WHERE back <= {R.tail} GROUP BY ALL),
al AS (SELECT episode, (SELECT count(*) FROM fr f WHERE f.episode = e.episode) AS frames, (SELECT count(*) FROM sn s WHERE s.episode = e.episode) AS seen, coalesce((SELECT bool_or(near) FROM sn s WHERE s.episode = e.episode), FALSE) AS near FROM (SELECT DISTINCT episode FROM fr) e),
de AS (SELECT al.*, grip, coalesce(up, FALSE) AND seen >= 3 AS lifted, CASE WHEN seen >= 3 THEN bd END AS bd, coalesce(sqrt((fx - bx) ** 2 + (fy - bby) ** 2) < {R.inside} * br, FALSE) AS ends FROM al JOIN gr USING (episode) LEFT JOIN lu USING (episode) LEFT JOIN tl USING (episode) LEFT JOIN bw USING (episode))"""


@query(f"""WITH {FOUND} SELECT episode, CASE WHEN seen < 3 THEN CASE WHEN grip THEN 'S1' ELSE 'S0' END WHEN ends AND lifted THEN 'S5' WHEN bd < {R.near} THEN 'S3' WHEN lifted THEN 'S2' WHEN grip OR near THEN 'S1' ELSE 'S0' END AS stage,
CASE WHEN seen < 3 THEN CASE WHEN grip THEN 'F3' ELSE 'F6' END WHEN ends AND lifted THEN 'F0' WHEN bd < {R.near} THEN 'F5' WHEN lifted THEN 'F4' WHEN grip THEN 'F3' WHEN near THEN 'F2' ELSE 'F6' END AS failure, seen, frames, lifted, round(bd, 6) AS bowl_distance FROM de""")
def rollout_stages(spark, sf_dir):
    s = signal(spark, sf_dir)
    frames = s.select("episode", "i", F.when(F.col("x") > 20, F.col("x")).otherwise(0.0).alias("area"), (F.col("jaw") * 6.4).alias("x"), F.col("x").alias("y"), ((F.col("label") == "error") & (F.col("x") > 150)).alias("near"))
    bowls = s.filter("episode % 3 > 0").select("episode").distinct().select("episode", F.lit(300.0).alias("bowl_x"), F.lit(60.0).alias("bowl_y"), F.lit(180.0).alias("bowl_r"))
    g = shape.actuated(s, K, "jaw", 100.0)
    grips = g.select("episode", ((F.col("range") >= 15) & (F.col("moved") > 0.9 * F.col("range"))).alias("actuated"))
    return rounded(rollout.decided_stages(frames, bowls, grips, "episode"), "bowl_distance")


SIDE = "CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END"
JOINTS = f"""jn AS (SELECT DISTINCT p_brand AS robot, split_part(p_name, ' ', 1) AS joint FROM part UNION SELECT p_brand, upper(split_part(p_name, ' ', 2)) FROM part UNION SELECT p_brand, 'openarm_' || {SIDE} || '_joint' || p_size FROM part UNION SELECT p_brand, 'openarm_' || {SIDE} || '_finger_joint' || (p_size % 3) FROM part),
cl AS (SELECT p_brand AS robot, split_part(p_name, ' ', 1) || ' | ' || split_part(p_name, ' ', 2) AS col, min(p_partkey) AS place FROM part WHERE p_size % 5 > 0 GROUP BY ALL UNION ALL SELECT p_brand, 'state | ' || {SIDE} || CASE WHEN p_size = 7 THEN '_gripper' ELSE '_joint_' || p_size || '.pos' END, min(p_partkey) FROM part WHERE p_size % 4 > 0 GROUP BY ALL),
al AS (SELECT split_part(p_name, ' ', 2) AS suffix, min(split_part(p_name, ' ', 1)) AS joint FROM part GROUP BY ALL),
ca AS (SELECT j.robot, j.joint, 1 AS r, place AS o, col FROM jn j JOIN cl c ON c.robot = j.robot AND lower(trim(split_part(col, '|', -1))) = lower(j.joint)
  UNION ALL SELECT j.robot, j.joint, 2, -place, col FROM jn j JOIN al ON al.joint = lower(j.joint) JOIN cl c ON c.robot = j.robot AND lower(trim(split_part(col, '|', -1))) = al.suffix
  UNION ALL SELECT j.robot, j.joint, 3, place, col FROM jn j JOIN cl c ON c.robot = j.robot WHERE contains(lower(trim(split_part(col, '|', -1))), CASE WHEN regexp_matches(lower(j.joint), '^openarm_(left|right)_joint(\\d+)$') THEN regexp_replace(lower(j.joint), '^openarm_(left|right)_joint(\\d+)$', '\\1_joint_\\2') WHEN regexp_matches(lower(j.joint), '^openarm_(left|right)_finger_joint1$') THEN regexp_replace(lower(j.joint), '^openarm_(left|right)_finger_joint1$', '\\1_gripper') END)
  UNION ALL SELECT j.robot, j.joint, 4, place, col FROM jn j JOIN cl c ON c.robot = j.robot WHERE contains(lower(col), lower(j.joint)) AND NOT contains(lower(j.joint), 'finger_joint2'))"""


@query(f"""WITH {JOINTS} SELECT robot, joint, col AS "column", ['exact', 'alias', 'pattern', 'fuzzy'][r] AS rule FROM ca QUALIFY row_number() OVER (PARTITION BY robot, joint ORDER BY r, o, col) = 1""")
def joint_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "robot")
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    side = F.when(F.col("p_size") % 2 == 0, "left").otherwise("right")
    names = [one, F.upper(two), F.concat(F.lit("openarm_"), side, F.lit("_joint"), "p_size"), F.concat(F.lit("openarm_"), side, F.lit("_finger_joint"), F.col("p_size") % 3)]
    joints = p.select("robot", F.explode(F.array(*names)).alias("joint")).distinct()
    arms = F.concat(F.lit("state | "), side, F.when(F.col("p_size") == 7, "_gripper").otherwise(F.concat(F.lit("_joint_"), "p_size", F.lit(".pos"))))
    columns = p.filter("p_size % 5 > 0").select("robot", F.concat(one, F.lit(" | "), two).alias("column"), "p_partkey").unionByName(p.filter("p_size % 4 > 0").select("robot", arms.alias("column"), "p_partkey"))
    columns = columns.groupBy("robot", "column").agg(F.min("p_partkey").alias("place"))
    aliases = p.groupBy(two.alias("suffix")).agg(F.min(one).alias("joint"))
    return matching.matched_joints(joints, columns, "robot", aliases)


@query(f"""WITH RECURSIVE {LATCH} SELECT episode, kind, round("start", 6) AS "start", round(fired, 6) AS fired FROM latch WHERE kind IS NOT NULL""")
def latch_table_function(spark, sf_dir):
    """The debounced latch as SQL: a table function over each episode's rows in order."""
    table_functions.register(spark)
    signal(spark, sf_dir).select("episode", "i", "t", "x").createOrReplaceTempView("tracewright_signal")
    out = spark.sql("SELECT * FROM contact_latch(TABLE(tracewright_signal) PARTITION BY (episode) ORDER BY (i), 34D, 20D, 3600D, 3600D)")
    return rounded(out, "start", "fired")


@query(f"""WITH {SIGNAL}, c AS (SELECT *, CASE WHEN (x > 50) = (lag(x) OVER (PARTITION BY episode ORDER BY i) > 50) THEN 0 ELSE 1 END AS c FROM sig), g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT episode, (row_number() OVER (PARTITION BY episode ORDER BY g) - 1)::INT AS span, round(min(t), 6) AS "start", round(max(t), 6) AS "end", count(*) AS "rows", max(x) AS peak FROM g WHERE x > 50 GROUP BY episode, g""")
def spans_table_function(spark, sf_dir):
    table_functions.register(spark)
    signal(spark, sf_dir).select("episode", "i", "t", "x").createOrReplaceTempView("tracewright_signal")
    return rounded(spark.sql("SELECT * FROM load_spans(TABLE(tracewright_signal) PARTITION BY (episode) ORDER BY (i), 50D)"), "start", "end")
