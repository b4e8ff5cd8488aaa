"""Registered queries on the views, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import islands
from ..operators import timeseries as ts
from .views import FRAMES, SIGNAL, frames, signal

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *cols, digits: int = 6):
    kinds = dict(df.dtypes)
    to = lambda c: scalars.rounded(F.col(c), digits) if kinds[c] == "double" else F.round(F.col(c), digits)
    return df.select(*[to(c).alias(c) if c in cols else F.col(c) for c in df.columns])


K, O = ["episode"], ["i"]
HOUR = 3600.0

# --- runs and intervals ---


@query(f"""WITH {SIGNAL}, a AS (SELECT *, x > 34 AS f, lead(t, 1, t) OVER (PARTITION BY episode ORDER BY i) AS nt FROM sig),
b AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY episode ORDER BY i) THEN 0 ELSE 1 END AS c FROM a),
g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
r AS (SELECT episode, run, min(t) AS s, max(nt) AS e, max(x) AS peak FROM g WHERE f GROUP BY ALL HAVING max(nt) - min(t) >= 3600),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY episode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200 THEN 0 ELSE 1 END AS nw FROM r),
n AS (SELECT *, sum(nw) OVER (PARTITION BY episode ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
o AS (SELECT episode, g, min(s) AS s, max(e) AS e, max(peak) AS peak, count(*) AS spans FROM n GROUP BY ALL)
SELECT episode, count(*) AS bouts, sum(spans)::BIGINT AS runs, max(peak) AS peak, round(sum(e - s), 3) AS held FROM o GROUP BY ALL""")
def contact_bouts(spark, sf_dir):
    b = islands.bouts(signal(spark, sf_dir), K, O, "t", "x", 34.0, HOUR, 2 * HOUR)
    return b.groupBy("episode").agg(F.count("*").alias("bouts"), F.sum("spans").alias("runs"), F.max("peak").alias("peak"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("held"))


@query(f"""WITH {SIGNAL}, b AS (SELECT *, x > 50 AS f, lead(t, 1, t + 1) OVER (PARTITION BY episode ORDER BY i) AS nt FROM sig),
c AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY episode ORDER BY i) THEN 0 ELSE 1 END AS c FROM b),
g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT episode, run::BIGINT AS run, count(*) AS n, round(min(t), 6) AS "start", round(max(nt), 6) AS "end", max(x) AS peak FROM g WHERE f GROUP BY ALL""")
def run_segmentation(spark, sf_dir):
    return rounded(islands.runs(signal(spark, sf_dir), K, O, F.col("x") > 50, "t", "x", 1.0), "start", "end")


@query(f"""WITH {SIGNAL}, c AS (SELECT *, CASE WHEN (x > 20) = (lag(x) OVER (PARTITION BY episode ORDER BY i) > 20) THEN 0 ELSE 1 END AS c FROM sig),
g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT episode, run, count(*) AS n, min(t) AS a, max(t) AS b FROM g WHERE x > 20 GROUP BY ALL HAVING count(*) >= 3)
SELECT episode, round(min(a), 6) AS first, round(max(b), 6) AS last, count(*) AS runs FROM r GROUP BY ALL""")
def first_last_motion(spark, sf_dir):
    return rounded(islands.sustained(signal(spark, sf_dir), K, O, F.col("x") > 20, "t", 3), "first", "last")


@query(f"""WITH {SIGNAL}, c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY episode ORDER BY i) > 43200 THEN 1 ELSE 0 END AS c FROM sig),
g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS cluster FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY episode, cluster ORDER BY x DESC, t) AS r FROM g)
SELECT episode, cluster::BIGINT AS cluster, count(*) AS n, round(min(t), 6) AS "start", round(max(t), 6) AS "end", round(max(CASE WHEN r = 1 THEN t END), 6) AS at_peak, max(x) AS peak FROM m GROUP BY ALL""")
def gap_clusters(spark, sf_dir):
    return rounded(islands.gap_clusters(signal(spark, sf_dir), K, O, "t", "x", 12 * HOUR), "start", "end", "at_peak")


@query(f"""WITH {SIGNAL}, s AS (SELECT episode, t AS s, t + x * 60 AS e, x AS peak FROM sig),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY episode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 THEN 0 ELSE 1 END AS nw FROM s),
n AS (SELECT *, sum(nw) OVER (PARTITION BY episode ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT episode, round(min(s), 6) AS "start", round(max(e), 6) AS "end", max(peak) AS peak, count(*) AS spans FROM n GROUP BY episode, g""")
def interval_merge(spark, sf_dir):
    s = signal(spark, sf_dir).select("episode", F.col("t").alias("start"), (F.col("t") + F.col("x") * 60).alias("end"), F.col("x").alias("peak"))
    return rounded(islands.merged(s, K, 600.0), "start", "end")


@query(f"""WITH {SIGNAL}, k AS (SELECT *, CASE label WHEN 'purchase' THEN 'onset' WHEN 'click' THEN 'terminal' WHEN 'view' THEN 'stable' ELSE 'slip' END AS kind FROM sig),
l AS (SELECT *, last_value(CASE WHEN kind IN ('onset', 'terminal') THEN kind END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM k)
SELECT episode, i, kind FROM l WHERE kind IN ('onset', 'terminal') OR st = 'onset'""")
def state_machine_cleanup(spark, sf_dir):
    kind = F.when(F.col("label") == "purchase", "onset").when(F.col("label") == "click", "terminal").when(F.col("label") == "view", "stable").otherwise("slip")
    return islands.state_cleanup(signal(spark, sf_dir).select("episode", "i", kind.alias("kind")), K, O, "kind")


@query(f"""WITH {SIGNAL}, q AS (SELECT episode, i, floor(x / 25) AS level, label FROM sig)
SELECT episode, i, level::BIGINT AS level FROM (SELECT *, lag(level) OVER w AS pl, lag(label) OVER w AS pb, row_number() OVER w AS r FROM q WINDOW w AS (PARTITION BY episode ORDER BY i)) WHERE NOT (r > 1 AND level IS NOT DISTINCT FROM pl AND label IS NOT DISTINCT FROM pb)""")
def duplicate_drop(spark, sf_dir):
    q = signal(spark, sf_dir).select("episode", "i", F.floor(F.col("x") / 25).alias("level"), "label")
    return islands.duplicate_drop(q, K, O, ["level", "label"]).select("episode", "i", "level")


@query(f"""WITH {SIGNAL}, s AS (SELECT *, floor(t * 0.0001)::BIGINT AS slot FROM sig)
SELECT episode, slot, round(slot / 0.0001, 3) AS stamp, x FROM (SELECT *, row_number() OVER (PARTITION BY episode, slot ORDER BY i) AS r FROM s) WHERE r = 1""")
def device_grid(spark, sf_dir):
    return rounded(islands.first_per_slot(signal(spark, sf_dir), K, "t", 0.0001, O).select("episode", "slot", "stamp", "x"), "stamp", digits=3)


# --- window primitives ---

W = "(PARTITION BY episode ORDER BY i)"


@query(f"""WITH {SIGNAL} SELECT episode, i, list_sort(a)[floor(len(a) / 2)::INT + 1] AS m, CASE WHEN len(a) = 5 THEN list_sort(a)[3] ELSE x END AS inner_m
FROM (SELECT *, list(x) OVER (PARTITION BY episode ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM sig)""")
def median5(spark, sf_dir):
    d = ts.median5(signal(spark, sf_dir), K, O, "x", "m")
    return ts.median5(d, K, O, "x", "inner_m", interior=True).select("episode", "i", "m", "inner_m")


@query(f"WITH {SIGNAL} SELECT episode, i, round(sqrt(avg(x * x) OVER (PARTITION BY episode ORDER BY i ROWS 9 PRECEDING)), 6) AS rms FROM sig")
def moving_rms(spark, sf_dir):
    return rounded(ts.moving_rms(signal(spark, sf_dir), K, O, "x", 10, "rms").select("episode", "i", "rms"), "rms")


@query(f"""WITH {SIGNAL}, d AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1e-9 THEN (x - lag(x) OVER w) / (t - lag(t) OVER w) WHEN i > 0 THEN 0.0 END AS d FROM sig WINDOW w AS {W})
SELECT episode, i, round(coalesce(d, lead(d) OVER {W}, 0.0), 9) AS v FROM d""")
def derivative(spark, sf_dir):
    return rounded(ts.derivative(signal(spark, sf_dir), K, O, "x", "t", "v").select("episode", "i", "v"), "v", digits=9)


@query(f"""WITH {SIGNAL} SELECT episode, i, CASE WHEN count(x) OVER v > 1 AND abs(avg(x) OVER v) > 1e-9 THEN round(stddev_pop(x) OVER v / abs(avg(x) OVER v), 6) ELSE 'infinity'::DOUBLE END AS r
FROM sig WINDOW v AS (PARTITION BY episode ORDER BY i ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)""")
def rel_std(spark, sf_dir):
    return rounded(ts.relative_std(signal(spark, sf_dir), K, O, "x", 9, "r").select("episode", "i", "r"), "r")


@query(f"""WITH {SIGNAL}, s AS (SELECT *, coalesce(abs(x - lag(x) OVER {W}), 0) AS s FROM sig)
SELECT episode, i, round(avg(s) OVER (PARTITION BY episode ORDER BY i ROWS 9 PRECEDING), 6) AS hf FROM s""")
def hf_proxy(spark, sf_dir):
    return rounded(ts.mean_abs_diff(signal(spark, sf_dir), K, O, "x", 10, "hf").select("episode", "i", "hf"), "hf")


@query(f"WITH {SIGNAL} SELECT episode, i, round(coalesce((x - lag(x, 10) OVER w) / nullif(t - lag(t, 10) OVER w, 0), 0), 9) AS rate FROM sig WINDOW w AS {W}")
def lagged_rate(spark, sf_dir):
    return rounded(ts.lagged_rate(signal(spark, sf_dir), K, O, "x", "t", 10, "rate").select("episode", "i", "rate"), "rate", digits=9)


@query(f"""WITH {FRAMES} SELECT episode, i, round(coalesce(greatest(abs(q - lag(q) OVER w), abs(d * 100 - lag(d * 100) OVER w)), 0), 6) AS top, round(coalesce(abs(q - lag(q) OVER w) + abs(d * 100 - lag(d * 100) OVER w), 0), 6) AS total FROM fr WINDOW w AS {W}""")
def joint_speed(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("e", F.col("d") * 100)
    d = ts.joint_speed(ts.joint_speed(d, K, O, ["q", "e"], "top"), K, O, ["q", "e"], "total", total=True)
    return rounded(d.select("episode", "i", "top", "total"), "top", "total")


@query(f"""WITH {SIGNAL} SELECT episode, i, round(max(x) OVER v - x, 6) AS jaw_fall, round(x - min(x) OVER v, 6) AS jaw_rise FROM sig WINDOW v AS (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def running_excursion(spark, sf_dir):
    return rounded(ts.excursion(signal(spark, sf_dir), K, O, "x", "jaw").select("episode", "i", "jaw_fall", "jaw_rise"), "jaw_fall", "jaw_rise")


@query(f"WITH {SIGNAL} SELECT episode, i, max(x) OVER (PARTITION BY episode ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS top FROM sig")
def window_plateau(spark, sf_dir):
    return ts.plateau(signal(spark, sf_dir), K, "us", "x", 86_400_000_000, "top").select("episode", "i", "top")


@query(f"""WITH {SIGNAL} SELECT episode, i, max(x) OVER (PARTITION BY episode ORDER BY us RANGE BETWEEN CURRENT ROW AND 43200000000 FOLLOWING) < 120 AND us + 43200000000 <= max(us) OVER (PARTITION BY episode) AS quiet FROM sig""")
def forward_quiet(spark, sf_dir):
    return ts.forward_quiet(signal(spark, sf_dir), K, "us", "x", 43_200_000_000, 120.0, "quiet").select("episode", "i", "quiet")


@query(f"""WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM sig)
SELECT episode, i, x FROM n WHERE n <= 12 OR i IN (SELECT floor(k * (n.n - 1) / 11.0::DOUBLE + 0.5)::BIGINT FROM range(12) r(k))""")
def even_sample(spark, sf_dir):
    return ts.even_positions(signal(spark, sf_dir), K, O, 12).select("episode", "i", "x")


@query(f"""WITH {SIGNAL}, b AS (SELECT episode, min(t) AS a, max(t) AS b FROM sig GROUP BY ALL HAVING max(t) > min(t)),
g AS (SELECT episode, k::INT AS k, CASE WHEN k = 15 THEN b ELSE a + k * ((b - a) / 15) END AS t FROM b, range(16) r(k)),
p AS (SELECT g.*, s.t AS t0, s.x AS x0, s.i AS i FROM g ASOF JOIN (SELECT episode, t, max(i) AS i, max_by(x, i) AS x FROM sig GROUP BY ALL) s ON g.episode = s.episode AND g.t >= s.t)
SELECT p.episode, k, round(CASE WHEN n.t IS NULL OR n.t = t0 THEN x0 ELSE x0 + (n.x - x0) * (p.t - t0) / (n.t - t0) END, 6) AS x FROM p LEFT JOIN sig n ON n.episode = p.episode AND n.i = p.i + 1""")
def grid_resample(spark, sf_dir):
    return rounded(ts.resampled(signal(spark, sf_dir), K, "t", "x", 16), "x")


@query(f"""WITH {SIGNAL}, s AS (SELECT episode, i + 1 AS k, sum(x) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS h, sum(x) OVER (PARTITION BY episode) AS a, count(*) OVER (PARTITION BY episode) AS n FROM sig),
g AS (SELECT episode, k, round(h * h / k + (a - h) * (a - h) / (n - k) - a * a / n, 4) AS gain FROM s WHERE k >= 3 AND n - k >= 3)
SELECT episode, k AS split, gain FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY gain DESC, k) AS r FROM g) WHERE r = 1""")
def prefix_cost_best_split(spark, sf_dir):
    return ts.best_split(signal(spark, sf_dir), K, O, "x", 3)


@query(f"""WITH {SIGNAL}, a AS (SELECT episode, i, (x % 7) - 3.5 AS a FROM sig), s AS (SELECT *, first_value(a) OVER {W} AS f, coalesce(a - lag(a) OVER {W}, 0) AS s FROM a)
SELECT episode, i, round(f + sum(s - floor(s / (2 * pi()) + 0.5) * 2 * pi()) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS angle FROM s""")
def angle_unwrap(spark, sf_dir):
    d = signal(spark, sf_dir).select("episode", "i", (F.col("x") % 7 - 3.5).alias("a"))
    return rounded(ts.unwrapped(d, K, O, "a", "angle").select("episode", "i", "angle"), "angle")


@query(f"""WITH {SIGNAL}, s AS (SELECT episode, x, i + 1 AS r, abs(x - lag(x) OVER {W}) AS s, first_value(x) OVER v AS f, last_value(x) OVER v AS l FROM sig WINDOW v AS (PARTITION BY episode ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT episode, count(*) AS n, round(sum(s), 6) AS variation, round(CASE WHEN sum(s) > 0 THEN abs(max(l) - max(f)) / sum(s) ELSE 0 END, 6) AS sustain, round(CASE WHEN count(*) >= 4 THEN regr_slope(x, r) END, 6) AS slope FROM s GROUP BY episode""")
def total_variation(spark, sf_dir):
    return rounded(ts.sustain(signal(spark, sf_dir), K, O, "x"), "variation", "sustain", "slope")
