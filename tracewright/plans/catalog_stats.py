"""Registered queries: joins in time, statistics, sets and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, setops, stats
from .catalog import HOUR, K, query, rounded
from .views import ATOMS, FRAMES, SIGNAL, atoms, frames, signal, table

# --- joins ---

LEFT = "lft AS (SELECT episode, i, t FROM sig WHERE label = 'click'), rgt AS (SELECT episode, t, max(x) AS v FROM sig WHERE label = 'purchase' GROUP BY ALL)"


def _sides(spark, sf_dir):
    s = signal(spark, sf_dir)
    right = s.filter("label = 'purchase'").groupBy("episode", "t").agg(F.max("x").alias("v"))
    return s.filter("label = 'click'").select("episode", "i", "t"), right


@query(f"""WITH {SIGNAL}, {LEFT} SELECT l.episode, l.i, coalesce(r.v, f.v) AS v FROM lft l ASOF LEFT JOIN rgt r ON l.episode = r.episode AND l.t >= r.t
LEFT JOIN (SELECT episode, arg_min(v, t) AS v FROM rgt GROUP BY ALL) f ON l.episode = f.episode""")
def asof_backward(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return asof.backward(left, right, K, "t", "v", "v", clamp=True).select("episode", "i", "v")


NEAR = """n AS (SELECT l.episode, l.i, l.t, b.v AS bv, l.t - b.t AS bg, a.v AS av, a.t - l.t AS ag FROM lft l ASOF LEFT JOIN rgt b ON l.episode = b.episode AND l.t >= b.t ASOF LEFT JOIN rgt a ON l.episode = a.episode AND l.t < a.t)"""


@query(f"""WITH {SIGNAL}, {LEFT}, {NEAR}, p AS (SELECT episode, i, CASE WHEN bg IS NOT NULL AND (ag IS NULL OR bg <= ag) THEN bv ELSE av END AS v, CASE WHEN bg IS NOT NULL AND (ag IS NULL OR bg <= ag) THEN bg ELSE ag END AS g FROM n)
SELECT episode, i, v, round(g, 6) AS v_gap FROM p WHERE g <= 36000""")
def asof_nearest_tol(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return rounded(asof.nearest(left, right, K, "t", "v", "v", 10 * HOUR).select("episode", "i", "v", "v_gap"), "v_gap")


@query(f"""WITH {SIGNAL}, {LEFT}, {NEAR} SELECT episode, i, CASE WHEN bg IS NOT NULL AND (ag IS NULL OR bg < ag) THEN bv ELSE av END AS v FROM n WHERE bg IS NOT NULL OR ag IS NOT NULL""")
def snap_nearest(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return asof.nearest(left, right, K, "t", "v", "v", later=True).select("episode", "i", "v")


@query(f"""WITH {SIGNAL}, {LEFT}, b AS (SELECT l.episode, l.i, l.t, b.v AS bv, b.t AS bt, a.v AS av, a.t AS at0 FROM lft l ASOF LEFT JOIN rgt b ON l.episode = b.episode AND l.t >= b.t ASOF LEFT JOIN rgt a ON l.episode = a.episode AND l.t < a.t)
SELECT episode, i, round(CASE WHEN bt IS NULL THEN av WHEN at0 IS NULL THEN bv ELSE bv + (av - bv) * (t - bt) / (at0 - bt) END, 6) AS v FROM b""")
def interpolate_at(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return rounded(asof.interpolated(left, right, K, "t", "v", "v").select("episode", "i", "v"), "v")


@query(f"""WITH {SIGNAL}, {LEFT}, p AS (SELECT * FROM (SELECT episode, t, (v - lag(v) OVER w) / nullif(t - lag(t) OVER w, 0) AS s FROM rgt WINDOW w AS (PARTITION BY episode ORDER BY t)) WHERE s IS NOT NULL)
SELECT l.episode, l.i, round(coalesce(a.s, z.s), 9) AS v FROM lft l ASOF LEFT JOIN p a ON l.episode = a.episode AND l.t <= a.t LEFT JOIN (SELECT episode, arg_max(s, t) AS s FROM p GROUP BY ALL) z ON l.episode = z.episode""")
def bracket_slope(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return rounded(asof.bracket_slope(left, right, K, "t", "v", "v").select("episode", "i", "v"), "v", digits=9)


@query(f"""WITH {SIGNAL}, {LEFT} SELECT l.episode, l.i, count(*) AS near, max(r.v) AS top FROM lft l JOIN rgt r ON l.episode = r.episode AND abs(l.t - r.t) <= 18000 GROUP BY ALL""")
def events_near(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return asof.within(left, right, K, "t", 5 * HOUR).groupBy("episode", "i").agg(F.count("*").alias("near"), F.max("r_v").alias("top"))


@query(f"""WITH {SIGNAL}, {LEFT} SELECT l.episode, l.i FROM lft l WHERE NOT EXISTS (SELECT 1 FROM rgt r WHERE l.episode = r.episode AND abs(l.t - r.t) <= 18000)""")
def lonely_events(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return asof.within(left, right, K, "t", 5 * HOUR, "left_anti").select("episode", "i")


@query(f"""WITH {ATOMS}, q AS (SELECT episode, ts + 0.25 AS ts FROM atoms WHERE style = 'interjection'), p AS (SELECT episode, ts, min(content) AS content FROM atoms WHERE style = 'subtask' GROUP BY ALL)
SELECT q.episode, q.ts, p.content AS active FROM q ASOF LEFT JOIN p ON q.episode = p.episode AND q.ts >= p.ts""")
def active_atom(spark, sf_dir):
    a = atoms(spark, sf_dir)
    q = a.filter("style = 'interjection'").select("episode", (F.col("ts") + 0.25).alias("ts"))
    p = a.filter("style = 'subtask'").groupBy("episode", "ts").agg(F.min("content").alias("content"))
    return asof.backward(q, p, K, "ts", "content", "active")


# --- statistics ---


@query("""SELECT "column", floor(min(v) * 1000 + 0.5) / 1000 AS "min", floor(max(v) * 1000 + 0.5) / 1000 AS "max" FROM (
UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) ON COLUMNS(*) INTO NAME "column" VALUE v) GROUP BY ALL""")
def column_min_max(spark, sf_dir):
    return stats.min_max(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(f"""WITH {FRAMES} SELECT task, floor(min(q) * 1000 + 0.5) / 1000 AS lo, floor(max(q) * 1000 + 0.5) / 1000 AS hi, count(*) AS n FROM fr GROUP BY ALL""")
def group_min_max(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("task").agg(stats.half_up(F.min("q"), 3).alias("lo"), stats.half_up(F.max("q"), 3).alias("hi"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT floor(count(*) / 30.0::DOUBLE * 100 + 0.5) / 100 AS s FROM lineitem GROUP BY l_orderkey), a AS (SELECT count(*) AS episodes, min(s) AS shortest, max(s) AS longest, floor(avg(s) * 100 + 0.5) / 100 AS mean, floor(quantile_cont(s, 0.5) * 100 + 0.5) / 100 AS median FROM l)
SELECT a.*, floor(sqrt(greatest((SELECT sum(s * s) FROM l) / episodes - 2 * mean * (SELECT sum(s) FROM l) / episodes + mean * mean, 0)) * 100 + 0.5) / 100 AS std FROM a""")
def length_stats(spark, sf_dir):
    return stats.length_stats(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n", 30.0)


@query("""WITH a AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, greatest(10, least(50, ceil(log2(count(value)) + 1))) AS bins FROM events), b AS (SELECT *, (hi - lo) / bins AS raw, pow(10.0, floor(log10((hi - lo) / bins))) AS mag FROM a),
c AS (SELECT *, CASE WHEN raw / mag <= 1 THEN 1.0 WHEN raw / mag <= 2 THEN 2.0 WHEN raw / mag <= 2.5 THEN 2.5 WHEN raw / mag <= 5 THEN 5.0 ELSE 10.0 END::DOUBLE * mag AS step FROM b)
SELECT round(greatest(floor(lo / step), least(floor(value / step), ceil(hi / step) - 1)) * step, 6) AS "start", count(*) AS n FROM events, c GROUP BY ALL""")
def nice_histogram(spark, sf_dir):
    return stats.nice_histogram(table(spark, sf_dir, "events").select(F.col("value").alias("x")), "x")


@query(f"""WITH {SIGNAL}, b AS (SELECT episode, x, min(x) OVER (PARTITION BY episode) AS lo, max(x) OVER (PARTITION BY episode) AS hi FROM sig)
SELECT episode, (CASE WHEN hi > lo THEN least(floor((x - lo) * 6 / (hi - lo)), 5) ELSE 0 END)::INT AS bin, count(*) AS n FROM b GROUP BY ALL""")
def equal_width_hist(spark, sf_dir):
    return stats.histogram(signal(spark, sf_dir), K, "x", 6)


@query(f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM fr), b AS (SELECT bin::INT AS bin, q, d FROM n, range(50) r(bin) WHERE floor(bin * ((n - 1) / 49.0::DOUBLE) + 0.5) = i)
SELECT bin, dim, round(CASE WHEN count(v) > 1 THEN var_pop(v) ELSE 0 END, 6) AS variance, count(v) AS episodes FROM (UNPIVOT b ON q, d INTO NAME dim VALUE v) GROUP BY ALL""")
def cross_episode_variance(spark, sf_dir):
    return rounded(stats.cross_episode_variance(frames(spark, sf_dir), "episode", "i", ["q", "d"]), "variance")


@query(f"""WITH {FRAMES} SELECT episode, count(*) AS frames, floor(coalesce(avg(m), 0) * 10000 + 0.5) / 10000 AS score FROM (SELECT episode, sqrt(pow(q - lag(q) OVER w, 2) + pow(d - lag(d) OVER w, 2) + pow(x - lag(x) OVER w, 2)) AS m FROM fr WINDOW w AS (PARTITION BY episode ORDER BY i)) GROUP BY ALL""")
def movement_score(spark, sf_dir):
    return stats.movement(frames(spark, sf_dir), "episode", ["i"], ["q", "d", "x"])


@query(f"""WITH {FRAMES}, s AS (SELECT episode, q, abs(q - lag(q) OVER (PARTITION BY episode ORDER BY i)) AS s FROM fr),
g AS (SELECT episode, CASE WHEN max(q) = min(q) THEN 1.0 ELSE max(q) - min(q) END AS range, count(DISTINCT q) AS "distinct", coalesce(list_sort(list(s) FILTER (s IS NOT NULL))[least(floor(count(s) * 0.95::DOUBLE) + 1, count(s))::INT], 0) AS p95_step FROM s GROUP BY ALL)
SELECT *, "distinct" <= 4 AS discrete, p95_step >= 0.001::DOUBLE * range AS active FROM g""")
def motor_activity_p95(spark, sf_dir):
    return stats.motor_profile(frames(spark, sf_dir), "episode", ["i"], "q")


@query(f"""WITH {SIGNAL}, v AS (SELECT label, x - lag(x) OVER (PARTITION BY episode ORDER BY i) AS v FROM sig), w AS (SELECT label, v, min(v) OVER (PARTITION BY label) AS lo, max(v) OVER (PARTITION BY label) AS hi FROM v WHERE v IS NOT NULL)
SELECT label, (CASE WHEN hi > lo THEN least(floor((v - lo) * 30 / (hi - lo)), 29) ELSE 0 END)::INT AS bin, count(*) AS n FROM w GROUP BY ALL""")
def velocity_hist(spark, sf_dir):
    d = signal(spark, sf_dir).select("label", (F.col("x") - F.lag("x").over(Window.partitionBy("episode").orderBy("i"))).alias("v"))
    return stats.histogram(d.filter("v is not null"), ["label"], "v", 30)


ACF = f"""{SIGNAL}, c AS (SELECT episode, i, x - avg(x) OVER (PARTITION BY episode) AS c, count(*) OVER (PARTITION BY episode) AS n FROM sig),
d AS (SELECT * FROM c WHERE n >= 20), l AS (SELECT episode, i, c, lag, lead(c, lag) OVER (PARTITION BY episode, lag ORDER BY i) AS l FROM d, (SELECT unnest(range(1, 11))::INT AS lag)),
e AS (SELECT episode, lag, CASE WHEN sum(c * c) > 0 THEN coalesce(sum(c * l), 0) / sum(c * c) ELSE 0 END AS a FROM l GROUP BY ALL), acf AS (SELECT lag, avg(a) AS acf, count(*) AS episodes FROM e GROUP BY ALL)"""


@query(f"WITH {ACF} SELECT lag, round(acf, 6) AS acf, episodes FROM acf")
def autocorrelation(spark, sf_dir):
    return rounded(stats.autocorrelation(signal(spark, sf_dir), "episode", "i", "x", 10), "acf")


@query(f"WITH {ACF} SELECT min(lag) FILTER (acf < 0.5) AS lag FROM acf")
def decorrelation_lag(spark, sf_dir):
    return stats.autocorrelation(signal(spark, sf_dir), "episode", "i", "x", 10).agg(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))).alias("lag"))


@query(f"""WITH {SIGNAL} SELECT episode, round(avg(abs(v - pv)), 6) AS jerk FROM (SELECT episode, i, v, lag(v) OVER (PARTITION BY episode ORDER BY i) AS pv FROM (SELECT episode, i, x - lag(x) OVER (PARTITION BY episode ORDER BY i) AS v FROM sig)) GROUP BY ALL""")
def jerkiness(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("i")
    d = signal(spark, sf_dir).select("episode", "i", (F.col("x") - F.lag("x").over(w)).alias("v")).select("episode", F.abs(F.col("v") - F.lag("v").over(w)).alias("j"))
    return d.groupBy("episode").agg(F.round(F.avg("j"), 6).alias("jerk"))


@query(f"""WITH {SIGNAL}, g AS (SELECT episode, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT episode, abs(x - lag(x) OVER (PARTITION BY episode ORDER BY i)) AS v FROM sig) WHERE v IS NOT NULL GROUP BY ALL), c AS (SELECT *, CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cv FROM g)
SELECT episode, n, round(mean, 6) AS mean, round(std, 6) AS std, round(cv, 6) AS cv, CASE WHEN cv < 0.2 THEN 'consistent' WHEN cv < 0.4 THEN 'moderate' ELSE 'varied' END AS verdict FROM c""")
def speed_cv(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("i")
    d = signal(spark, sf_dir).select("episode", F.abs(F.col("x") - F.lag("x").over(w)).alias("v"))
    return rounded(stats.speed_profile(d, "episode", "v"), "mean", "std", "cv")


@query(f"""WITH {SIGNAL}, dl AS (SELECT * FROM (SELECT episode, i, x - lag(x) OVER w AS x, jaw - lag(jaw) OVER w AS y FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i)) WHERE x IS NOT NULL AND y IS NOT NULL),
z AS (SELECT episode, i, x - avg(x) OVER (PARTITION BY episode) AS x, y - avg(y) OVER (PARTITION BY episode) AS y, row_number() OVER (PARTITION BY episode ORDER BY i) AS r FROM dl),
p AS (SELECT a.episode, lag, a.x, b.y FROM z a, (SELECT unnest(range(-5, 6))::INT AS lag) k LEFT JOIN z b ON a.episode = b.episode AND b.r = a.r + lag)
SELECT episode, lag, round(CASE WHEN sqrt(sum(x * x) FILTER (y IS NOT NULL) * sum(y * y)) > 1e-12 THEN sum(x * y) / sqrt(sum(x * x) FILTER (y IS NOT NULL) * sum(y * y)) ELSE 0 END, 6) AS r FROM p GROUP BY ALL""")
def cross_correlation(spark, sf_dir):
    return rounded(stats.cross_correlation(signal(spark, sf_dir), "episode", "i", "x", "jaw", 5), "r")


@query(f"""WITH {FRAMES} SELECT task, round(min(q), 6) AS "min", round(max(q), 6) AS "max", round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std, round(quantile_cont(q, 0.01), 6) AS q01, round(quantile_cont(q, 0.1), 6) AS q10, round(quantile_cont(q, 0.5), 6) AS q50, round(quantile_cont(q, 0.9), 6) AS q90, round(quantile_cont(q, 0.99), 6) AS q99, count(*) AS n FROM fr GROUP BY ALL""")
def stats_reduce(spark, sf_dir):
    q = lambda p: F.percentile("q", F.lit(p))
    d = frames(spark, sf_dir).groupBy("task").agg(F.min("q").alias("min"), F.max("q").alias("max"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), q(0.01).alias("q01"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"), q(0.99).alias("q99"), F.count("*").alias("n"))
    return rounded(d, "min", "max", "mean", "std", "q01", "q10", "q50", "q90", "q99")


@query(f"""WITH {SIGNAL}, f AS (SELECT DISTINCT episode, label FROM sig WHERE x > 200) SELECT label, count(*) AS episodes FROM f GROUP BY ALL""")
def flag_histogram(spark, sf_dir):
    return signal(spark, sf_dir).filter("x > 200").select("episode", "label").distinct().groupBy("label").agg(F.count("*").alias("episodes"))


@query(f"""WITH {SIGNAL}, f AS (SELECT DISTINCT episode, label FROM sig WHERE x > 200) SELECT episode, sum(CASE label WHEN 'purchase' THEN 5 WHEN 'error' THEN 4 WHEN 'signup' THEN 3 ELSE 1 END)::BIGINT AS weight FROM f GROUP BY ALL""")
def flag_weight(spark, sf_dir):
    kinds = spark.createDataFrame([("purchase", 5), ("error", 4), ("signup", 3)], "label string, w int")
    f = signal(spark, sf_dir).filter("x > 200").select("episode", "label").distinct()
    return f.join(F.broadcast(kinds), "label", "left").groupBy("episode").agg(F.sum(F.coalesce("w", F.lit(1))).alias("weight"))


@query("""WITH r AS (SELECT o_orderstatus AS status, o_custkey AS episode, count(*) AS weight FROM orders GROUP BY ALL)
SELECT status, episode, weight, row_number() OVER (ORDER BY CASE status WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, weight DESC, episode) AS place FROM r""")
def triage_sort(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("episode")).agg(F.count("*").alias("weight"))
    rank = F.when(F.col("status") == "F", 0).when(F.col("status") == "P", 1).otherwise(2)
    # places without one task for all rows: classes of one rank and weight, then places within them
    r = r.withColumn("_k", rank)
    classes = r.groupBy("_k", "weight").agg(F.count("*").alias("n"))
    w = Window.orderBy("_k", F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("_k", "weight", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    own = stats.running(r, ["_k", "weight"], "episode", {"n": F.count("*")}).select("_k", "weight", "episode", "n_below")
    d = r.join(own, ["_k", "weight", "episode"]).join(F.broadcast(classes), ["_k", "weight"])
    return d.select("status", "episode", "weight", (F.col("base") + F.col("n_below") + 1).alias("place"))


@query("""WITH r AS (SELECT n_regionkey AS scene, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS successes, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
p AS (SELECT *, successes / n::DOUBLE AS p FROM r)
SELECT scene, n, successes, score, round(greatest(0, ((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS lo,
round(least(1, ((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n)) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS hi FROM p""")
def rollout_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    g = c.groupBy(F.col("n_regionkey").alias("scene")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("successes"), F.round(F.avg("c_acctbal"), 4).alias("score"))
    lo, hi = stats.wilson(F.col("successes"), F.col("n"))
    return rounded(g.withColumn("lo", lo).withColumn("hi", hi), "lo", "hi")


@query(f"""WITH {SIGNAL} SELECT episode, min(abs(x)) FILTER (abs(x) > 1e-6) AS quantum, round(CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) ELSE 30 END, 9) AS rate FROM sig GROUP BY ALL""")
def quantum(spark, sf_dir):
    g = signal(spark, sf_dir).groupBy("episode").agg(F.min(F.when(F.abs("x") > 1e-6, F.abs("x"))).alias("quantum"), F.when(F.max("t") > F.min("t"), (F.count("*") - 1) / (F.max("t") - F.min("t"))).otherwise(30.0).alias("rate"))
    return rounded(g, "rate", digits=9)


@query(f"""WITH {SIGNAL}, d AS (SELECT episode, i, abs(floor(x / 25) - lag(floor(x / 25)) OVER (PARTITION BY episode ORDER BY i)) AS d FROM sig),
g AS (SELECT *, sum(CASE WHEN d = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM d), l AS (SELECT *, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY episode, g) AS len FROM g)
SELECT episode, count(d) AS pairs, count(*) FILTER (d = 0) AS exact, count(*) FILTER (d > 0 AND d <= 1) AS flicker, count(*) FILTER (d > 1) AS "real", max(len)::BIGINT AS longest FROM l GROUP BY ALL""")
def dup_census(spark, sf_dir):
    d = signal(spark, sf_dir).withColumn("level", F.floor(F.col("x") / 25))
    return stats.duplicate_census(d, K, ["i"], "level", 1)


@query(f"""WITH {SIGNAL}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY episode ORDER BY i) AS d FROM sig), r AS (SELECT episode, d, row_number() OVER (PARTITION BY episode ORDER BY d) AS r, count(*) OVER (PARTITION BY episode) AS n FROM g WHERE d IS NOT NULL)
SELECT episode, round(max(CASE WHEN r = floor(n * 0.5::DOUBLE) + 1 THEN d END), 6) AS median, round(max(CASE WHEN r = floor(n * 0.95::DOUBLE) + 1 THEN d END), 6) AS p95, round(min(d), 6) AS lo, round(max(d), 6) AS hi FROM r GROUP BY ALL""")
def refresh_intervals(spark, sf_dir):
    d = signal(spark, sf_dir).withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("episode").orderBy("i"))).filter("d is not null")
    g = d.groupBy("episode").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    out = g.join(stats.rank_value(d, K, "d", 0.5, "median"), "episode").join(stats.rank_value(d, K, "d", 0.95, "p95"), "episode")
    return rounded(out, "median", "p95", "lo", "hi")


@query("""SELECT o_orderstatus AS label, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ALL""")
def crosstab(spark, sf_dir):
    c = lambda v: F.count_if(F.col("o_orderpriority") == v)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(c("1-URGENT").alias("urgent"), c("2-HIGH").alias("high"), c("3-MEDIUM").alias("medium"), c("5-LOW").alias("low"))


@query("""WITH p AS (SELECT quality AS truth, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)), c AS (SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL)
SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c""")
def confusion(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    c = d.groupBy(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6))


@query("""WITH p AS (SELECT quality = 1 AS g, n_chars AS x FROM labels JOIN documents USING (doc_id)), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM p),
a AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(r) FILTER (g) AS s FROM r) SELECT n1, n2, (s - n1 * (n1 + 1) / 2)::DOUBLE AS u, round((s - n1 * (n1 + 1) / 2)::DOUBLE / (n1 * n2), 6) AS auc FROM a""")
def mann_whitney(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("g"), F.col("n_chars").alias("x"))
    return rounded(stats.mann_whitney(d, "g", "x").withColumn("u", F.col("u").cast("double")), "auc")


@query(f"""WITH {SIGNAL}, r AS (SELECT episode, rank() OVER (PARTITION BY episode ORDER BY x) + (count(*) OVER (PARTITION BY episode, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY episode ORDER BY t) + (count(*) OVER (PARTITION BY episode, t) - 1) / 2.0 AS b FROM sig)
SELECT episode, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY ALL""")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(signal(spark, sf_dir), K, "x", "t"), "rho")


@query("""WITH a AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), n AS (SELECT vec_id, label, floor((k - 1) / 3) AS taxel, sqrt(sum(v * v)) AS f FROM a WHERE k <= 63 GROUP BY ALL)
SELECT label, round(max(f), 5) AS peak, count(DISTINCT vec_id) AS frames, round(avg(f), 5) AS mean, count(*) FILTER (f > 0.3) AS active FROM n GROUP BY ALL""")
def tactile_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    norm = lambda k: F.sqrt(sum((F.get("embedding", 3 * k + j).cast("double") ** 2 for j in (1, 2)), F.get("embedding", 3 * k).cast("double") ** 2))
    d = e.select("vec_id", "label", F.array(*[norm(k) for k in range(21)]).alias("f"))
    one = d.select("label", F.array_max("f").alias("peak"), F.aggregate("f", F.lit(0.0), lambda s, x: s + x).alias("s"), F.size(F.filter("f", lambda x: x > 0.3)).alias("a"))
    return one.groupBy("label").agg(F.round(F.max("peak"), 5).alias("peak"), F.count("*").alias("frames"), F.round(F.sum("s") / (21 * F.count("*")), 5).alias("mean"), F.sum("a").alias("active"))


@query("""WITH a AS (SELECT label, vec_id % 7 AS episode, list_max(embedding)::DOUBLE AS peak FROM embeddings), e AS (SELECT label, episode, max(peak) AS peak, avg((peak > 0.25)::INT) AS contact FROM a GROUP BY ALL)
SELECT label, count(*) AS episodes, round(max(peak), 5) AS peak, round(avg(contact), 6) AS contact FROM e GROUP BY ALL""")
def tactile_aggregate(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).alias("episode"), F.array_max("embedding").cast("double").alias("peak"))
    e = a.groupBy("label", "episode").agg(F.max("peak").alias("peak"), F.avg((F.col("peak") > 0.25).cast("int")).alias("contact"))
    return e.groupBy("label").agg(F.count("*").alias("episodes"), F.round(F.max("peak"), 5).alias("peak"), F.round(F.avg("contact"), 6).alias("contact"))


# --- sets, diffs, order ---


@query(f"""WITH {ATOMS} SELECT style, role, count(*) AS n FROM (SELECT * FROM atoms QUALIFY row_number() OVER (PARTITION BY style, role, content ORDER BY episode, ts) = 1) GROUP BY ALL""")
def atom_dedupe(spark, sf_dir):
    return setops.first_of(atoms(spark, sf_dir), ["style", "role", "content"], ["episode", "ts"]).groupBy("style", "role").agg(F.count("*").alias("n"))


EDITED = "ours AS (SELECT episode, style, content, ts FROM atoms), theirs AS (SELECT episode, style, CASE WHEN episode % 5 = 0 AND style = 'subtask' THEN 'edited' ELSE content END AS content, CASE WHEN episode % 3 = 0 THEN ts + 0.125 ELSE ts END AS ts FROM atoms WHERE NOT (episode % 7 = 0 AND ts > 0))"


def _edited(spark, sf_dir):
    ours = atoms(spark, sf_dir).select("episode", "style", "content", "ts")
    content = F.when(F.expr("episode % 5 = 0 and style = 'subtask'"), "edited").otherwise(F.col("content"))
    theirs = ours.filter("not (episode % 7 = 0 and ts > 0)").select("episode", "style", content.alias("content"), F.when(F.expr("episode % 3 = 0"), F.col("ts") + 0.125).otherwise(F.col("ts")).alias("ts"))
    return ours, theirs


@query(f"""WITH {ATOMS}, {EDITED} SELECT episode, style, content, ts, sum(k)::BIGINT AS surplus FROM (SELECT *, 1 AS k FROM ours UNION ALL SELECT *, -1 FROM theirs) GROUP BY ALL HAVING sum(k) <> 0""")
def multiset_diff(spark, sf_dir):
    return setops.multiset_diff(*_edited(spark, sf_dir), ["episode", "style", "content", "ts"])


@query()
def three_way_diff(spark, sf_dir):
    ours, theirs = _edited(spark, sf_dir)
    return setops.three_way_diff(ours, theirs, K, "style", "content", "ts", 0.25).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def episode_set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, n, 'short' AS side FROM (SELECT * FROM n ORDER BY n, l_orderkey LIMIT 5) UNION ALL SELECT l_orderkey, n, 'long' FROM (SELECT * FROM n ORDER BY n DESC, l_orderkey LIMIT 5)""")
def extreme_lengths(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.orderBy("n", "l_orderkey").limit(5).withColumn("side", F.lit("short")).union(n.orderBy(F.desc("n"), "l_orderkey").limit(5).withColumn("side", F.lit("long")))


@query("""SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY regexp_replace(p_name, '[0-9]+', '', 'g'), coalesce(try_cast(regexp_extract(p_name, '[0-9]+') AS BIGINT), -1), p_partkey) AS r FROM part) WHERE r = 1""")
def natural_sort(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    number = F.coalesce(F.expr("try_cast(regexp_extract(p_name, '[0-9]+', 0) as bigint)"), F.lit(-1))
    return setops.first_of(p, ["p_brand"], [F.regexp_replace("p_name", "[0-9]+", ""), number, "p_partkey"])


@query(f"""WITH {SIGNAL}, n AS (SELECT episode, i, x, row_number() OVER (PARTITION BY episode ORDER BY i) AS r, count(*) OVER (PARTITION BY episode) AS n FROM sig WHERE label <> 'purchase')
SELECT episode, i, x FROM n WHERE r IN (floor(n * 1 / 3) + 1, floor(n * 2 / 3) + 1)""")
def background_picks(spark, sf_dir):
    w = Window.partitionBy("episode")
    d = signal(spark, sf_dir).filter("label <> 'purchase'").withColumn("r", F.row_number().over(w.orderBy("i"))).withColumn("n", F.count("*").over(w))
    return d.filter("r = floor(n * 1 / 3) + 1 or r = floor(n * 2 / 3) + 1").select("episode", "i", "x")
