"""Registered queries: further detector rules, baselines, slopes and change gates on the signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passes
from ..operators import timeseries as ts
from .catalog import HOUR, K, O, query, rounded
from .views import FRAMES, SIGNAL, frames, signal


def _closed(flag: str, x: str, least: float) -> str:
    return f"""WITH {SIGNAL}, f AS (SELECT *, coalesce({flag}, FALSE) AS f, {x} AS v FROM sig), b AS (SELECT *, lead(t) OVER w AS nt, CASE WHEN f = lag(f) OVER w THEN 0 ELSE 1 END AS c FROM f WINDOW w AS (PARTITION BY episode ORDER BY i)),
g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT episode, round(min(t), 6) AS "start", round(max(nt), 6) AS "end", arg_min(v, i) AS first, max(v) AS peak FROM g WHERE f GROUP BY episode, g HAVING count(*) = count(nt) AND max(nt) - min(t) >= {least}"""


@query(_closed("x > 20 AND jaw > 40", "x", HOUR))
def incipient_slip(spark, sf_dir):
    return rounded(passes.closed_spans(signal(spark, sf_dir), K, O, "t", (F.col("x") > 20) & (F.col("jaw") > 40), F.col("x"), HOUR), "start", "end")


@query(_closed("abs(x - 50) > 25", "abs(x - 50)", 2 * HOUR))
def rotation_spans(spark, sf_dir):
    torque = F.abs(F.col("x") - 50)
    return rounded(passes.closed_spans(signal(spark, sf_dir), K, O, "t", torque > 25, torque, 2 * HOUR), "start", "end", digits=6)


@query(f"""WITH {SIGNAL}, a AS (SELECT episode, max(t) AS e, max(x) AS peak, count(CASE WHEN label = 'purchase' THEN jaw END) AS j, count(CASE WHEN label = 'error' THEN x END) AS m FROM sig GROUP BY ALL)
SELECT episode, array_to_string(list_filter([CASE WHEN j < 3 THEN 'no_gripper' END, CASE WHEN m < 3 THEN 'no_arm' END, 'profile_unverified', CASE WHEN peak < 300 THEN 'no_contact' END], lambda f: f IS NOT NULL), ',') AS flags,
round(CASE WHEN peak < 300 AND e > 0 THEN e END, 6) AS approach_end FROM a""")
def capability_flags(spark, sf_dir):
    jaw, arm = F.when(F.col("label") == "purchase", F.col("jaw")), F.when(F.col("label") == "error", F.col("x"))
    d = passes.capability_flags(signal(spark, sf_dir), K, "t", "x", 300.0, jaw, arm, verified=False)
    return rounded(d.withColumn("flags", F.array_join("flags", ",")), "approach_end")


@query(f"""WITH {SIGNAL}, q AS (SELECT episode, min(CASE WHEN x > 0 THEN x END) AS q FROM sig GROUP BY ALL)
SELECT episode, count(*) AS n, count(*) FILTER (x < 5 OR coalesce(q > 0 AND jaw <= 1 AND x <= 40 * q, FALSE)) AS below FROM sig JOIN q USING (episode) GROUP BY ALL""")
def single_taxel_floor(spark, sf_dir):
    s = signal(spark, sf_dir)
    q = s.groupBy("episode").agg(F.min(F.when(F.col("x") > 0, F.col("x"))).alias("q"))
    below = passes.below_exit(F.col("x"), 5.0, F.col("jaw"), F.col("q"), 40.0)
    return s.join(q, "episode").groupBy("episode").agg(F.count("*").alias("n"), F.count_if(below).alias("below"))


_FLAGS = "fl AS (SELECT episode, i, label, CASE WHEN jaw > 30 THEN label || '@' || floor(t)::BIGINT || '-' || floor(t + 60)::BIGINT || 's' ELSE label END AS flag FROM sig WHERE x > 60)"


def _flags(spark, sf_dir):
    at = F.concat("label", F.lit("@"), F.floor("t").cast("string"), F.lit("-"), F.floor(F.col("t") + 60).cast("string"), F.lit("s"))
    return signal(spark, sf_dir).filter("x > 60").select("episode", "i", "label", F.when(F.col("jaw") > 30, at).otherwise(F.col("label")).alias("flag"))


@query(f"""WITH {SIGNAL}, {_FLAGS} SELECT episode, string_agg(flag, ',' ORDER BY coalesce(try_cast(nullif(regexp_extract(flag, '@([\\d.]+)', 1), '') AS DOUBLE), 'inf'::DOUBLE), i DESC) AS flags FROM fl WHERE label <> 'view' GROUP BY ALL""")
def flags_in_time(spark, sf_dir):
    f = _flags(spark, sf_dir).withColumn("place", -F.col("i"))
    return passes.flags_in_time(f, K, "place", "flag", F.col("label") == "view", True).withColumn("flags", F.array_join("flags", ","))


@query(f"""WITH {SIGNAL}, f AS (SELECT episode, list(CASE label WHEN 'view' THEN 'hesitation' ELSE label END ORDER BY i) AS f, CASE arg_max(label, i) WHEN 'purchase' THEN 'success' ELSE arg_max(label, i) END AS result, count(*) FILTER (label = 'signup') > 0 AS released FROM sig WHERE x > 40 GROUP BY ALL),
p AS (SELECT *, coalesce(list_position(f, 'hesitation'), 0) AS p FROM f)
SELECT episode, array_to_string(CASE WHEN result <> 'success' AND released THEN list_append(CASE WHEN p > 0 THEN f[:p - 1] || f[p + 1:] ELSE f END, 'result_' || result) ELSE f END, ',') AS flags FROM p""")
def evaluation_flags(spark, sf_dir):
    s = signal(spark, sf_dir).filter("x > 40").withColumn("f", F.when(F.col("label") == "view", "hesitation").otherwise(F.col("label")))
    last = F.max_by("label", "i")
    d = s.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("i", "f")))["f"].alias("f"), F.when(last == "purchase", "success").otherwise(last).alias("result"), (F.count_if(F.col("label") == "signup") > 0).alias("released"))
    return d.select("episode", F.array_join(passes.evaluation_flags(F.col("f"), F.col("result"), F.col("released")), ",").alias("flags"))


@query(f"""WITH {SIGNAL}, m AS (SELECT *, max(jaw) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS top FROM sig),
n AS (SELECT episode, count(*) AS n, max(t) - min(t) AS span, greatest(7200, coalesce(min(CASE WHEN jaw < top - 60 THEN t END) - min(t), 7200)) AS win FROM m GROUP BY ALL),
r AS (SELECT episode, least(n, greatest(3, floor(CASE WHEN span > 0 THEN (n - 1) / span ELSE 0 END * win + 0.5)))::BIGINT AS "rows" FROM n),
k AS (SELECT episode, "rows", x, row_number() OVER (PARTITION BY episode ORDER BY x) AS r, count(*) OVER (PARTITION BY episode) AS m FROM sig JOIN r USING (episode) WHERE i < "rows" AND x IS NOT NULL)
SELECT episode, "rows", x AS baseline FROM k WHERE r = m // 2 + 1""")
def initial_baseline(spark, sf_dir):
    return ts.initial_baseline(signal(spark, sf_dir), K, O, "t", "x", "jaw", 7200.0, 60.0)


@query(f"""WITH {SIGNAL} SELECT episode, label, count(x) AS n, round(CASE WHEN count(x) >= 4 THEN regr_slope(x, t / 3600) END, 6) AS slope FROM sig GROUP BY ALL""")
def slope_fit(spark, sf_dir):
    return rounded(ts.slope(signal(spark, sf_dir).withColumn("h", F.col("t") / 3600), ["episode", "label"], "h", "x"), "slope")


@query(f"""WITH {FRAMES}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END + CASE WHEN row_number() OVER w = 1 OR d IS DISTINCT FROM lag(d) OVER w OR x IS DISTINCT FROM lag(x) OVER w THEN 2 ELSE 0 END AS mask FROM fr WINDOW w AS (PARTITION BY episode ORDER BY i))
SELECT episode, i, mask FROM c WHERE mask > 0""")
def change_gated_rows(spark, sf_dir):
    return ts.change_gated(frames(spark, sf_dir), K, O, {"hand": ["flag"], "arm": ["d", "x"]}, "mask").select("episode", "i", "mask")


@query(f"""WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM sig) SELECT episode, i, round(x, 2) AS force, round(jaw, 2) AS peak FROM n WHERE i % greatest(1, n // 20) = 0""")
def contact_timeline(spark, sf_dir):
    return ts.strided(signal(spark, sf_dir), K, O, 20).select("episode", "i", F.round("x", 2).alias("force"), F.round("jaw", 2).alias("peak"))


@query(f"""WITH {SIGNAL}, g AS (SELECT episode, t AS s, unnest(range(0, 10)) AS step FROM sig WHERE label = 'error' AND x > 60)
SELECT g.episode, round(s, 6) AS "start", step::INTEGER AS step, greatest(coalesce(max(x), 0), 0) AS peak FROM g LEFT JOIN sig ON sig.episode = g.episode AND sig.t >= s + step * 7200::DOUBLE AND sig.t <= s + step * 7200::DOUBLE + 7200 GROUP BY ALL""")
def hand_after_drop(spark, sf_dir):
    s = signal(spark, sf_dir)
    drops = s.filter("label = 'error' and x > 60")
    return rounded(passes.after_events(drops, s, K, "t", "t", "x", 2 * HOUR, 10), "start")


@query(f"""WITH {SIGNAL}, r AS (SELECT episode, i, label, greatest(coalesce(max(jaw) OVER (PARTITION BY episode ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - jaw, 0), 0) AS rise FROM sig) SELECT episode, i, rise FROM r WHERE label = 'error'""")
def jaw_rise(spark, sf_dir):
    return passes.rise_to_end(signal(spark, sf_dir), K, O, "jaw", "rise").filter("label = 'error'").select("episode", "i", "rise")
