"""Registered queries: slips of an episode over its time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screen, trajectory
from . import catalog_exits, catalog_screen
from .catalog import K, query, rounded
from .catalog_exits import TOUCH
from .views import signal

#: Half a slip's window in the clock of ``events``: signups stand for slips, their finger being their row's.
HALF = 432_000.0
SLIPS = "sl AS (SELECT DISTINCT episode, (i % 2)::INT AS finger, t FROM sig WHERE label = 'signup')"
SUMMED = f"""{TOUCH}, {SLIPS}, pr AS (SELECT sl.*, fn, sfx, sfy, CASE WHEN fn > 0.5 THEN copy END AS cop, row_number() OVER (PARTITION BY sl.episode, sl.finger, sl.t ORDER BY s.i) AS r, count(*) OVER (PARTITION BY sl.episode, sl.finger, sl.t) AS n
  FROM sl JOIN s ON s.episode = sl.episode AND s.finger = sl.finger AND s.t BETWEEN sl.t - {HALF} AND sl.t + {HALF}),
su AS (SELECT episode, finger, t, avg(fn) AS grip, degrees(atan2(avg(sfy), avg(sfx))) AS shear_ang, avg(cop) AS cop_y, avg(cop) FILTER (r > n - 8) - avg(cop) FILTER (r <= 8) AS dcop FROM pr GROUP BY ALL)"""


def _slips(spark, sf_dir):
    s = signal(spark, sf_dir).filter("label = 'signup'").select("episode", (F.col("i") % 2).cast("int").alias("finger"), "t").distinct()
    return trajectory.slip_summaries(catalog_exits._samples(spark, sf_dir), s, K, "i", HALF)


@query(f"WITH {SUMMED} SELECT episode, finger, round(t, 6) AS t, round(grip, 5) AS grip, round(shear_ang, 5) AS shear_ang, round(cop_y, 5) AS cop_y, round(dcop, 5) AS dcop FROM su")
def slip_summaries(spark, sf_dir):
    return rounded(rounded(_slips(spark, sf_dir), "t"), "grip", "shear_ang", "cop_y", "dcop", digits=5)


def _half_way(spark, sf_dir):
    """The second phase begins at the middle of an episode's time."""
    return signal(spark, sf_dir).groupBy("episode").agg((F.max("t") / 2).alias("anchor"))


@query(f"""WITH {SUMMED}, an AS (SELECT episode, max(t) / 2 AS anchor FROM sig GROUP BY ALL), p AS (SELECT episode, finger, t, t >= anchor AS ph, grip, cop_y FROM su JOIN an USING (episode) WHERE grip IS NOT NULL AND cop_y IS NOT NULL),
ds AS (SELECT a.episode, a.finger, a.t, a.ph, avg(sqrt((a.grip - b.grip) ** 2 + (a.cop_y - b.cop_y) ** 2)) FILTER (b.ph = a.ph AND (b.finger, b.t) <> (a.finger, a.t)) AS near, avg(sqrt((a.grip - b.grip) ** 2 + (a.cop_y - b.cop_y) ** 2)) FILTER (b.ph <> a.ph) AS away FROM p a JOIN p b ON a.episode = b.episode GROUP BY ALL)
SELECT episode, count(*) AS "rows", round(avg(CASE WHEN near IS NULL THEN 0 ELSE coalesce((away - near) / nullif(greatest(away, near), 0), 0) END), 6) AS silhouette FROM ds GROUP BY episode HAVING bool_or(ph) AND NOT bool_and(ph)""")
def slip_phases(spark, sf_dir):
    p = _slips(spark, sf_dir).join(_half_way(spark, sf_dir), "episode").withColumn("phase", F.col("t") >= F.col("anchor"))
    return rounded(trajectory.phase_silhouette(p, K, "phase", ["grip", "cop_y"]), "silhouette")


@query()
def slip_trajectory(spark, sf_dir):
    s = _slips(spark, sf_dir)
    windows = screen.terminal_windows(catalog_screen._samples(spark, sf_dir), s, K, "t", catalog_screen.CHANNELS, catalog_screen.RULES)
    return trajectory.slip_trajectory(windows, _half_way(spark, sf_dir), K, "t", "v", "anchor")
