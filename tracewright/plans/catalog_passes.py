"""Registered queries: detector passes on events made from labels, and on runs of the signal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import islands, passes
from ..operators import timeseries as ts
from .catalog import HOUR, K, query, rounded
from .views import SIGNAL, signal

KINDS = {"purchase": "onset", "click": "terminal", "view": "place", "signup": "release", "error": "drop"}
EVENTS = f"""{SIGNAL}, ev AS (SELECT episode, i, t AS "start", CASE label {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'slip' END AS kind, CASE WHEN x > 60 THEN 'high' ELSE 'medium' END AS conf FROM sig)"""


def _events(spark, sf_dir):
    kind = F.lit("slip")
    for k, v in KINDS.items():
        kind = F.when(F.col("label") == k, v).otherwise(kind)
    return signal(spark, sf_dir).select("episode", "i", F.col("t").alias("start"), kind.alias("kind"), F.when(F.col("x") > 60, "high").otherwise("medium").alias("conf"))


@query(f"""WITH {SIGNAL}, r AS (SELECT *, coalesce((x - lag(x, 2) OVER w) / nullif(t - lag(t, 2) OVER w, 0), 0) AS r FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i)), c AS (SELECT *, CASE WHEN (r > 0.0003) = (lag(r) OVER (PARTITION BY episode ORDER BY i) > 0.0003) THEN 0 ELSE 1 END AS c FROM r),
g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c) SELECT episode, round(min(t), 6) AS "start", count(*) AS "rows" FROM g WHERE r > 0.0003 GROUP BY episode, g HAVING count(*) >= 2""")
def lift(spark, sf_dir):
    d = ts.lagged_rate(signal(spark, sf_dir), K, ["i"], "x", "t", 2, "r")
    return rounded(passes.sustained_rise(d, K, ["i"], "t", F.col("r"), 0.0003, 2), "start")


@query(f"""WITH {SIGNAL}, m AS (SELECT *, coalesce(last_value(CASE WHEN x > 100 THEN 1 WHEN x < 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS o FROM sig),
c AS (SELECT *, lead(t) OVER w AS nx, CASE WHEN o = coalesce(lag(o) OVER w, 0) THEN 0 ELSE 1 END AS c FROM m WINDOW w AS (PARTITION BY episode ORDER BY i)), g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT episode, round(min(t), 6) AS "start", round(max(nx), 6) AS "end", max(x) AS peak FROM g WHERE o = 1 GROUP BY episode, g HAVING count(*) = count(nx)""")
def slip_spans(spark, sf_dir):
    return rounded(passes.hysteresis_spans(signal(spark, sf_dir), K, ["i"], "t", "x", 100.0, 20.0), "start", "end")


@query(f"""WITH {SIGNAL}, p AS (SELECT episode, i, x, lag(x, 2) OVER (PARTITION BY episode ORDER BY i) AS before, max(x) OVER (PARTITION BY episode ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 43200000000 FOLLOWING) AS a FROM sig)
SELECT episode, i, before FROM p WHERE before > 60 AND x <= 0.8::DOUBLE * before AND coalesce(a <= 0.5::DOUBLE * before, TRUE)""")
def place_rows(spark, sf_dir):
    return passes.places(signal(spark, sf_dir), K, ["i"], "us", "x", 2, 60.0, 0.2, 0.5, 43_200_000_000).select("episode", "i", "before")


@query(f"""WITH RECURSIVE {SIGNAL}, p0 AS (SELECT episode, i, t, x, lag(x, 2) OVER (PARTITION BY episode ORDER BY i) AS before, max(x) OVER (PARTITION BY episode ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 43200000000 FOLLOWING) AS a FROM sig),
p AS MATERIALIZED (SELECT episode, i, t, row_number() OVER (PARTITION BY episode ORDER BY i) AS r FROM p0 WHERE before > 60 AND x <= 0.8::DOUBLE * before AND coalesce(a <= 0.5::DOUBLE * before, TRUE)),
st AS (SELECT episode, i, t, r, TRUE AS kept, t AS last FROM p WHERE r = 1 UNION ALL SELECT p.episode, p.i, p.t, p.r, p.t - last >= 43200, CASE WHEN p.t - last >= 43200 THEN p.t ELSE last END FROM st JOIN p ON p.episode = st.episode AND p.r = st.r + 1)
SELECT episode, i, t FROM st WHERE kept""")
def place_events(spark, sf_dir):
    p = passes.places(signal(spark, sf_dir), K, ["i"], "us", "x", 2, 60.0, 0.2, 0.5, 43_200_000_000).select("episode", "i", "t")
    return passes.refractory(p, "episode", "t", 12 * HOUR)


POINTS = "pt AS (SELECT episode, t + 1000 AS \"start\" FROM sig WHERE x > 90)"


@query(f"""WITH {EVENTS}, {POINTS} SELECT episode, i, kind, CASE WHEN conf = 'medium' AND EXISTS (SELECT 1 FROM pt WHERE pt.episode = ev.episode AND abs(pt."start" - ev."start") <= 7200) THEN 'high' ELSE conf END AS conf FROM ev""")
def changepoint_agreement(spark, sf_dir):
    s = signal(spark, sf_dir).filter("x > 90").select("episode", (F.col("t") + 1000).alias("start"))
    return passes.agreed(_events(spark, sf_dir), s, K, 2 * HOUR).select("episode", "i", "kind", "conf")


@query(f"""WITH {EVENTS}, {POINTS} SELECT episode, round("start", 6) AS "start" FROM pt WHERE NOT EXISTS (SELECT 1 FROM ev WHERE pt.episode = ev.episode AND ev.kind = 'place' AND abs(pt."start" - ev."start") <= 7200)""")
def unlabelled_transitions(spark, sf_dir):
    s = signal(spark, sf_dir).filter("x > 90").select("episode", (F.col("t") + 1000).alias("start"))
    return rounded(passes.lonely(_events(spark, sf_dir).filter("kind = 'place'"), s, K, 2 * HOUR), "start")


@query(f"""WITH {EVENTS}, p AS (SELECT *, max(CASE WHEN kind = 'place' THEN "start" END) OVER (PARTITION BY episode ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS p FROM ev)
SELECT episode, kind, conf, count(*) AS n FROM (SELECT episode, kind, conf FROM ev UNION ALL SELECT episode, 'place', 'low' FROM p WHERE kind = 'release' AND (p IS NULL OR p < "start" - 36000)) GROUP BY ALL""")
def place_backfill(spark, sf_dir):
    return passes.backfilled(_events(spark, sf_dir), "episode", 10 * HOUR, HOUR).groupBy("episode", "kind", "conf").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, a AS (SELECT *, min(CASE WHEN kind = 'onset' THEN "start" END) OVER w AS o, min(CASE WHEN kind = 'release' THEN "start" END) OVER w AS r FROM ev WINDOW w AS (PARTITION BY episode ORDER BY "start" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT episode, i, CASE WHEN kind = 'drop' AND coalesce(o - "start" > 14400, TRUE) AND coalesce(r - "start" <= 86400, FALSE) THEN 'release' ELSE kind END AS kind FROM a""")
def peel_off(spark, sf_dir):
    return passes.peeled(_events(spark, sf_dir), "episode", 4 * HOUR, 24 * HOUR).select("episode", "i", "kind")


@query(f"""WITH {EVENTS}, p AS (SELECT *, max(CASE WHEN kind = 'place' AND i % 9 = 0 THEN "start" END) OVER (PARTITION BY episode) AS p FROM ev), t AS (SELECT *, min(CASE WHEN kind = 'terminal' AND "start" > p THEN "start" END) OVER (PARTITION BY episode) AS tt FROM p), o AS (SELECT *, min(CASE WHEN kind = 'onset' AND "start" > tt THEN "start" END) OVER (PARTITION BY episode) AS o FROM t)
SELECT episode, i, coalesce("start" >= o, FALSE) AS after_task, CASE WHEN coalesce("start" >= o, FALSE) THEN 'low' ELSE conf END AS conf FROM o""")
def phantom_gate(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("kind", F.when(F.expr("kind = 'place' and i % 9 <> 0"), "moved").otherwise(F.col("kind")))
    return passes.phantoms(e, "episode").select("episode", "i", "after_task", "conf")


RUNS = """c AS (SELECT *, lead(t, 1, t) OVER (PARTITION BY episode ORDER BY i) AS nt, CASE WHEN (x > 34) = (lag(x) OVER (PARTITION BY episode ORDER BY i) > 34) THEN 0 ELSE 1 END AS c FROM sig), g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c), r AS (SELECT episode, g, min(t) AS s, max(nt) AS e, max(x) AS peak FROM g WHERE x > 34 GROUP BY ALL)"""


@query(f"""WITH {SIGNAL}, {RUNS}, l AS (SELECT *, min(CASE WHEN e - s >= 86400 THEN s END) OVER (PARTITION BY episode) AS l FROM r), b AS (SELECT * FROM l WHERE e - s >= 3600 AND e - s < 86400 AND peak >= 50 AND s > 1000 AND coalesce(s < l, TRUE))
SELECT episode, round(s, 6) AS "start", 'contact' AS kind, 'low' AS conf FROM b UNION ALL SELECT episode, round(e, 6), 'drop', 'low' FROM b""")
def brief_spans(spark, sf_dir):
    r = islands.runs(signal(spark, sf_dir), K, ["i"], F.col("x") > 34, "t", "x")
    return rounded(passes.brief(r, K, HOUR, 24 * HOUR, 1000.0, 50.0), "start")


@query(f"""WITH {SIGNAL}, {RUNS}, q AS (SELECT *, lead(s) OVER (PARTITION BY episode ORDER BY s) - e AS gap FROM r), n AS (SELECT *, CASE WHEN lag(gap) OVER (PARTITION BY episode ORDER BY s) < 28800 THEN 0 ELSE 1 END AS n FROM q), k AS (SELECT *, sum(n) OVER (PARTITION BY episode ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT episode, round(min(s), 6) AS "start", round(max(e), 6) AS "end", count(*) AS spans FROM k GROUP BY episode, k""")
def attempt_merge(spark, sf_dir):
    r = islands.runs(signal(spark, sf_dir), K, ["i"], F.col("x") > 34, "t", "x")
    r = r.withColumn("gap", F.lead("start").over(Window.partitionBy("episode").orderBy("start")) - F.col("end"))
    return rounded(passes.merged_attempts(r, K, "gap", 8 * HOUR), "start", "end")


@query(f"""WITH {SIGNAL}, {RUNS}, n AS (SELECT episode, max(t) AS len FROM sig GROUP BY ALL), b AS (SELECT n.episode, len, min(s) AS a, min(CASE WHEN peak > 100 THEN s END) AS st, max(e) AS e FROM n LEFT JOIN r ON r.episode = n.episode AND e - s >= 3600 GROUP BY ALL), q AS (SELECT episode, len, st, coalesce(a, 0.25::DOUBLE * len) AS grasp, greatest(coalesce(e, 0.9::DOUBLE * len), coalesce(a, 0.25::DOUBLE * len)) AS place FROM b)
SELECT episode, 0.0::DOUBLE AS approach, round(grasp, 6) AS grasp, round(greatest(least(coalesce(st, grasp), place), grasp), 6) AS transport, round(place, 6) AS place, round(len, 6) AS "end" FROM q""")
def subtask_anchors(spark, sf_dir):
    s = signal(spark, sf_dir)
    r = islands.runs(s, K, ["i"], F.col("x") > 34, "t", "x").filter(F.col("end") - F.col("start") >= HOUR).withColumn("stable", F.when(F.col("peak") > 100, F.col("start")))
    b = s.groupBy("episode").agg(F.max("t").alias("length")).join(r, "episode", "left")
    return rounded(passes.anchors(b, K, "length"), "grasp", "transport", "place", "end")


@query(f"""WITH {EVENTS} SELECT 'interjection' AS style, 'user' AS role, count(*) AS n, count(DISTINCT '[auto:' || conf || '] ' || kind || printf(' %.2fs', "start")) AS texts FROM ev WHERE kind <> 'slip' UNION ALL SELECT 'subtask', 'assistant', count(DISTINCT episode), 1 FROM sig""")
def detected_atoms(spark, sf_dir):
    e = _events(spark, sf_dir).filter("kind <> 'slip'")
    stages = signal(spark, sf_dir).groupBy("episode").agg(F.min("t").alias("start")).withColumn("label", F.lit("approach"))
    return passes.to_atoms(e, stages, "episode").groupBy("style", "role").agg(F.count("*").alias("n"), F.count_distinct("content").alias("texts"))
