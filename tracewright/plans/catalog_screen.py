"""Registered queries: the signal screen and its corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screen
from .catalog import K, query, rounded
from .views import SIGNAL, signal

HALF, OUTSIDE, GAP = 43_200.0, 3_600.0, 21_600.0
RULES = screen.Screen(half=HALF, outside=OUTSIDE, gap=GAP)
CHANNELS = ["fn", "fs", "active", "rough"]
CLASSES = {"purchase": "place", "signup": "release", "error": "drop"}

WINDOWS = f"""{SIGNAL}, c0 AS (SELECT episode, t, max(x) AS fn, max(jaw) AS fs FROM sig GROUP BY ALL),
c1 AS (SELECT *, row_number() OVER w AS j, coalesce(abs(fn - lag(fn) OVER w), 0) AS d FROM c0 WINDOW w AS (PARTITION BY episode ORDER BY t)),
ch AS MATERIALIZED (SELECT episode, t, fn, fs, CASE WHEN fn > 34 THEN 1.0 ELSE 0.0 END::DOUBLE AS ac, sum(d) OVER (PARTITION BY episode ORDER BY t ROWS 9 PRECEDING) / least(j, 10) AS hf, min(t) OVER (PARTITION BY episode) AS t0, max(t) OVER (PARTITION BY episode) AS t1 FROM c1),
ends AS (SELECT DISTINCT episode, t0, t1 FROM ch),
ev AS MATERIALIZED (SELECT DISTINCT episode, t, CASE label {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())} END AS label FROM sig JOIN ends USING (episode) WHERE label IN ('purchase', 'signup', 'error') AND t - {HALF} >= t0 - {OUTSIDE} AND t + {HALF} <= t1 + {OUTSIDE}),
near AS (SELECT ch.episode, ch.t, max(CASE WHEN abs(ch.t - ev.t) < {GAP} THEN 1 ELSE 0 END) AS n FROM ch LEFT JOIN ev ON ev.episode = ch.episode GROUP BY ALL),
far AS (SELECT episode, t, row_number() OVER (PARTITION BY episode ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY episode) AS m FROM near JOIN ends USING (episode) WHERE n = 0 AND t >= t0 + {HALF} AND t <= t1 - {HALF}),
cen AS (SELECT episode, t AS c, label FROM ev UNION ALL SELECT episode, t, 'background' FROM far WHERE r IN (m // 3, 2 * m // 3)),
gr AS (SELECT episode, c, label, g, c - {HALF} + 2 * {HALF} * g / 15 AS t FROM cen, range(16) r(g)),
a AS (SELECT gr.*, ch.t AS bt, ch.fn AS bn, ch.fs AS bs, ch.ac AS ba, ch.hf AS bh FROM gr ASOF LEFT JOIN ch ON gr.episode = ch.episode AND gr.t >= ch.t),
b AS (SELECT a.*, ch.t AS nt, ch.fn AS nn, ch.fs AS ns, ch.ac AS na, ch.hf AS nh FROM a ASOF LEFT JOIN ch ON a.episode = ch.episode AND a.t <= ch.t),
p AS (SELECT episode, c, label, g, {', '.join(f"CASE WHEN bt IS NULL THEN n{k} WHEN nt IS NULL THEN b{k} ELSE b{k} + (t - bt) / greatest(nt - bt, 1e-9) * (n{k} - b{k}) END AS {k}" for k in 'nsah')} FROM b),
wl AS (SELECT episode, c, label, list(n ORDER BY g) AS n, list(s ORDER BY g) AS s, list(a ORDER BY g) AS a, list(h ORDER BY g) AS h FROM p GROUP BY ALL),
win AS MATERIALIZED (SELECT episode, c, label, n || s || a || h || [list_sum(n[1:8]) / 8, list_sum(n[9:16]) / 8, list_sum(n[9:16]) / 8 - list_sum(n[1:8]) / 8, list_max(h)] AS v FROM wl)"""

SCALED = f"""{WINDOWS}, un AS (SELECT unnest(range(1, 69)) AS i, unnest(v) AS x FROM win), sc AS (SELECT list(m ORDER BY i) AS m, list(d ORDER BY i) AS d FROM (SELECT i, round(avg(x), 4) AS m, round(stddev_pop(x), 4) AS d FROM un GROUP BY ALL)),
corpus AS MATERIALIZED (SELECT episode, c, label, list_transform(range(1, 69), lambda i: (round(v[i], 3) - m[i]) / greatest(d[i], 1e-9))::DOUBLE[68] AS z FROM win, sc),
ask AS MATERIALIZED (SELECT episode, c, label, list_transform(range(1, 69), lambda i: (v[i] - m[i]) / greatest(d[i], 1e-9))::DOUBLE[68] AS z FROM win, sc),
vote AS (SELECT a.episode, a.c, a.label, CASE WHEN count(*) >= 7 THEN len(list_filter(arg_min(r.label, array_distance(a.z, r.z), 7), lambda n: n = 'background')) END AS votes FROM ask a JOIN corpus r ON a.episode <> r.episode WHERE ASKED GROUP BY ALL)"""


def _samples(spark, sf_dir):
    s = signal(spark, sf_dir)
    d = s.groupBy("episode", "t").agg(F.max("x").alias("fn"), F.max("jaw").alias("fs"))
    return screen.with_roughness(d.withColumn("active", (F.col("fn") > 34).cast("double")), K, "t", "fn", 10, "rough")


def _events(spark, sf_dir):
    label = F.when(F.col("label") == "purchase", "place").when(F.col("label") == "signup", "release").when(F.col("label") == "error", "drop")
    return signal(spark, sf_dir).select("episode", "t", label.alias("label")).filter("label is not null").distinct()


def _reference(spark, sf_dir):
    return screen.reference(_samples(spark, sf_dir), _events(spark, sf_dir), K, "t", CHANNELS, RULES)


@query(f"WITH {SCALED.replace('ASKED', 'TRUE')} SELECT episode, round(c, 6) AS c, label, len(z)::INT AS dims, round(list_sum(z), 4) AS s, round(sqrt(list_sum(list_transform(z, lambda x: x * x))), 4) AS length FROM corpus")
def reference_build(spark, sf_dir):
    ref = _reference(spark, sf_dir)
    add = lambda f: F.aggregate("z", F.lit(0.0), lambda a, x: a + f(x))
    d = ref.scaled(ref.rows).select("episode", F.col("t").alias("c"), "label", F.size("z").alias("dims"), add(lambda x: x).alias("s"), F.sqrt(add(lambda x: x * x)).alias("length"))
    return rounded(rounded(d, "c"), "s", "length", digits=4)


@query(f"WITH {SCALED.replace('ASKED', "a.label <> 'background'")} SELECT episode, round(c, 6) AS c, label, votes, coalesce(votes >= 4, FALSE) AS artifact, CASE WHEN votes >= 4 AND label <> 'background' THEN 'residual_suspect' END AS flag FROM vote WHERE label <> 'background'")
def signal_screen(spark, sf_dir):
    ref = _reference(spark, sf_dir)
    events = ref.windows.filter(F.col("label") != screen.BACKGROUND)
    judged = screen.screened(screen.background_votes(ref, events, K, "t", RULES), "label", RULES)
    return rounded(judged.select("episode", F.col("t").alias("c"), "label", "votes", "artifact", "flag"), "c")


@query(f"""WITH {SCALED.replace("ASKED", "TRUE")} SELECT label, votes, count(*) AS n FROM vote GROUP BY ALL""")
def screen_votes_by_class(spark, sf_dir):
    """Leave-one-episode-out: every window of the corpus, background too, against all other episodes."""
    ref = _reference(spark, sf_dir)
    return screen.background_votes(ref, ref.windows, K, "t", RULES).groupBy("label", "votes").agg(F.count("*").alias("n"))
