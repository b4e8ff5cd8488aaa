"""Registered queries: learning studies, validators, attempts, orchestration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import islands, learn, setops, stats
from .catalog import HOUR, K, query, rounded
from .catalog_data import KNN, _knn
from .views import FRAMES, SIGNAL, frames, signal, table

# --- learning ---

PRED = f"""{KNN}, v AS (SELECT query, label, round(count(*), 9) AS v FROM k GROUP BY ALL), p AS (SELECT query, arg_max(label, v * 1000 - label) AS predicted FROM v GROUP BY ALL), t AS (SELECT e.label AS truth, predicted FROM p JOIN embeddings e ON e.vec_id = p.query)"""


@query(f"WITH {PRED} SELECT truth, predicted, count(*) AS n FROM t GROUP BY ALL")
def knn_confusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").alias("truth"))
    return learn.vote(_knn(spark, sf_dir), 7).join(e, "query").groupBy("truth", "predicted").agg(F.count("*").alias("n"))


@query(f"""WITH {PRED}, c AS (SELECT truth AS class, count(*) AS t, count(*) FILTER (truth = predicted) AS hit FROM t GROUP BY ALL), m AS (SELECT predicted AS class, count(*) AS p FROM t GROUP BY ALL)
SELECT sum(t)::BIGINT AS n, round(sum(hit) / sum(t), 6) AS accuracy, round(avg(2 * hit / (t + coalesce(p, 0))), 6) AS macro_f1, round(avg(hit / t), 6) AS balanced_accuracy FROM c LEFT JOIN m USING (class)""")
def knn_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").alias("truth"))
    return rounded(learn.scores(learn.vote(_knn(spark, sf_dir), 7).join(e, "query"), "truth", "predicted"), "accuracy", "macro_f1", "balanced_accuracy")


@query("""SELECT doc_id, quality, x, round(share, 6) AS share FROM (SELECT doc_id, quality, n_chars AS x, cume_dist() OVER (PARTITION BY quality ORDER BY n_chars) AS share FROM labels JOIN documents USING (doc_id))""")
def class_percentiles(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", F.col("n_chars").alias("x"))
    return rounded(learn.percentile_of(d, d, ["quality"], "x").select("doc_id", "quality", "x", "share"), "share")


@query()
def kmeans_sweep(spark, sf_dir):
    return rounded(learn.kmeans_sweep(table(spark, sf_dir, "embeddings"), "embedding", (2, 4, 8)), "inertia", "silhouette", digits=3)


@query()
def cluster_contingency(spark, sf_dir):
    return rounded(learn.contingency(table(spark, sf_dir, "embeddings"), "embedding", "label", 6), "purity")


@query()
def pca2(spark, sf_dir):
    return learn.pca(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "label", F.transform("map", lambda v: F.round(v, 3)).alias("map"))


# --- validators and censuses ---


@query(f"""WITH {SIGNAL}, d AS (SELECT *, lag(us) OVER w AS pu, lag(x) OVER w AS px, lag(jaw) OVER w AS pj FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i))
SELECT episode, count(*) AS "rows", count(*) FILTER (us < pu) AS backwards, count(*) FILTER (us = pu) AS same_clock, count(*) FILTER (x = px AND jaw = pj) AS repeats, count(*) FILTER (x IS NULL) AS nulls, max((x <> px)::INT + 2 * (jaw <> pj)::INT) AS changed FROM d GROUP BY ALL""")
def validator_report(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("i")
    d = signal(spark, sf_dir).select("episode", "us", "x", "jaw", F.lag("us").over(w).alias("pu"), F.lag("x").over(w).alias("px"), F.lag("jaw").over(w).alias("pj"))
    return d.groupBy("episode").agg(F.count("*").alias("rows"), F.count_if(F.col("us") < F.col("pu")).alias("backwards"), F.count_if(F.col("us") == F.col("pu")).alias("same_clock"), F.count_if((F.col("x") == F.col("px")) & (F.col("jaw") == F.col("pj"))).alias("repeats"), F.count_if(F.col("x").isNull()).alias("nulls"), F.max((F.col("x") != F.col("px")).cast("int") + 2 * (F.col("jaw") != F.col("pj")).cast("int")).alias("changed"))


@query(f"""WITH {SIGNAL}, h AS (SELECT episode, t, (x < 20)::INT AS low FROM sig), g AS (SELECT p::INT AS p, f::INT AS f FROM range(1, 9) a(p), range(4) b(f)),
m AS (SELECT p, f, low, floor(t / 3600) % (p + 1) = f % (p + 1) AS hit FROM h, g)
SELECT p, f, round((count(*) FILTER (low = 1 AND hit) / greatest(count(*) FILTER (low = 1), 1)::DOUBLE + count(*) FILTER (low = 0 AND NOT hit) / greatest(count(*) FILTER (low = 0), 1)::DOUBLE) / 2, 6) AS balanced FROM m GROUP BY ALL""")
def beat_model(spark, sf_dir):
    h = signal(spark, sf_dir).select((F.col("x") < 20).alias("low"), F.floor(F.col("t") / HOUR).alias("h"))
    # hours repeat their phase after 2520 = lcm(1..9) hours: count by phase and state first, then the grid
    c = h.groupBy("low", (F.col("h") % 2520).alias("h")).agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p in range(1, 9) for f in range(4)]))
    m = c.select("low", "h", "n", grid.alias("g")).select("low", "n", "g.p", "g.f", (F.col("h") % (F.col("g.p") + 1) == F.col("g.f") % (F.col("g.p") + 1)).alias("hit"))
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    low, hit = F.col("low"), F.col("hit")
    b = (s(low & hit) / F.greatest(s(low), F.lit(1)) + s(~low & ~hit) / F.greatest(s(~low), F.lit(1))) / 2
    return m.groupBy("p", "f").agg(F.round(b, 6).alias("balanced"))


@query(f"""WITH {SIGNAL}, s AS (SELECT episode, t, x, floor(t / 43200)::BIGINT AS slot FROM sig), a AS (SELECT episode, slot, avg(x) AS v, count(*) AS n FROM s GROUP BY ALL)
SELECT a.episode, a.slot, round(b.v - a.v, 6) AS slide FROM a JOIN a b ON a.episode = b.episode AND b.slot = a.slot + 1 WHERE abs(b.v - a.v) >= 30""")
def slide_scan(spark, sf_dir):
    a = signal(spark, sf_dir).groupBy("episode", F.floor(F.col("t") / (12 * HOUR)).alias("slot")).agg(F.avg("x").alias("v"))
    w = Window.partitionBy("episode").orderBy("slot")
    d = a.withColumn("v1", F.lead("v").over(w)).withColumn("s1", F.lead("slot").over(w)).filter("s1 = slot + 1 and abs(v1 - v) >= 30")
    return d.select("episode", "slot", F.round(F.col("v1") - F.col("v"), 6).alias("slide"))


@query(f"""WITH {SIGNAL}, a AS (SELECT s.episode, s.i, p.i AS pi, s.x, p.x AS px, s.t - p.t AS gap FROM sig s JOIN sig p ON p.episode = s.episode AND p.i = s.i - 1 WHERE s.label = 'click' AND p.label <> 'click')
SELECT episode, count(*) AS exits, count(*) FILTER (gap < 14400) AS sync, count(*) FILTER (gap >= 14400 AND x > px) AS late, count(*) FILTER (gap >= 14400 AND x <= px) AS early FROM a GROUP BY ALL""")
def exit_asymmetry(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("i")
    d = signal(spark, sf_dir).select("episode", "label", "x", (F.col("t") - F.lag("t").over(w)).alias("gap"), F.lag("label").over(w).alias("pl"), F.lag("x").over(w).alias("px")).filter("label = 'click' and pl <> 'click'")
    return d.groupBy("episode").agg(F.count("*").alias("exits"), F.count_if(F.col("gap") < 4 * HOUR).alias("sync"), F.count_if((F.col("gap") >= 4 * HOUR) & (F.col("x") > F.col("px"))).alias("late"), F.count_if((F.col("gap") >= 4 * HOUR) & (F.col("x") <= F.col("px"))).alias("early"))


@query(f"""WITH {SIGNAL}, w AS (SELECT episode, i, t, x, avg(x) OVER (PARTITION BY episode ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND 1 PRECEDING) AS pre, avg(x) OVER (PARTITION BY episode ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 43200000000 FOLLOWING) AS post FROM sig)
SELECT episode, i, round(pre, 6) AS pre, round(post, 6) AS post, round(CASE WHEN pre > 1 THEN post / pre END, 6) AS retention FROM w WHERE x > 150""")
def load_retention(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("us")
    pre, post = F.avg("x").over(w.rangeBetween(-43_200_000_000, -1)), F.avg("x").over(w.rangeBetween(1, 43_200_000_000))
    d = signal(spark, sf_dir).withColumn("pre", pre).withColumn("post", post).filter("x > 150").withColumn("retention", F.when(F.col("pre") > 1, F.col("post") / F.col("pre")))
    return rounded(d.select("episode", "i", "pre", "post", "retention"), "pre", "post", "retention")


@query(f"""WITH {SIGNAL}, p AS (SELECT episode, max(x) AS top, arg_max(t, x) AS at0 FROM sig GROUP BY ALL), a AS (SELECT s.episode, min(s.t) AS t80 FROM sig s JOIN p USING (episode) WHERE s.t > at0 AND s.x <= 0.8 * top GROUP BY ALL), b AS (SELECT s.episode, min(s.t) AS t20 FROM sig s JOIN p USING (episode) JOIN a USING (episode) WHERE s.t >= t80 AND s.x <= 0.2 * top GROUP BY ALL)
SELECT episode, top, round(t20 - t80, 6) AS unload FROM p LEFT JOIN a USING (episode) LEFT JOIN b USING (episode)""")
def unload_time(spark, sf_dir):
    whole = Window.partitionBy("episode")
    d = signal(spark, sf_dir).withColumn("top", F.max("x").over(whole)).withColumn("at", F.min(F.when(F.col("x") == F.col("top"), F.col("t"))).over(whole))
    d = d.withColumn("t80", F.min(F.when((F.col("t") > F.col("at")) & (F.col("x") <= 0.8 * F.col("top")), F.col("t"))).over(whole))
    g = d.groupBy("episode").agg(F.first("top").alias("top"), F.first("t80").alias("t80"), F.min(F.when((F.col("t") >= F.col("t80")) & (F.col("x") <= 0.2 * F.col("top")), F.col("t"))).alias("t20"))
    return g.select("episode", "top", F.round(F.col("t20") - F.col("t80"), 6).alias("unload"))


@query(f"""WITH {FRAMES}, r AS (SELECT episode, count(*) AS n, string_agg(q::INT::VARCHAR, ',' ORDER BY i) AS s FROM fr GROUP BY ALL) SELECT a.episode, min(b.episode) AS source FROM r a JOIN r b ON a.s = b.s AND b.episode < a.episode GROUP BY ALL""")
def slice_align(spark, sf_dir):
    """Episodes whose rows equal those of an earlier episode: by hash of all rows, then by the rows."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("q").cast("int").alias("q")))), lambda r: r["q"])
    r = frames(spark, sf_dir).groupBy("episode").agg(seq.alias("s"))
    least = r.groupBy("s").agg(F.min("episode").alias("source"))
    return r.join(least, "s").filter("source < episode").select("episode", "source")


@query("""WITH r AS (SELECT o_custkey AS episode, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY ALL) SELECT (attempts = 1 + failed) AS agrees, count(*) AS n FROM r GROUP BY ALL""")
def attempt_agreement(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return r.groupBy((F.col("a") == 1 + F.col("f")).alias("agrees")).agg(F.count("*").alias("n"))


@query(f"""WITH {SIGNAL}, r AS (SELECT episode, label, x, i FROM sig), w AS (SELECT episode, count(*) AS n, count(*) FILTER (label = 'click') AS ok, count(*) FILTER (x > 200) AS flagged, count(DISTINCT label) AS kinds, round(avg(x) FILTER (label = 'view'), 6) AS took FROM r GROUP BY ALL)
SELECT count(*) AS total, sum(ok)::BIGINT AS ok, count(*) FILTER (flagged > 0) AS flagged, count(*) FILTER (kinds < 5) AS partial, round(avg(took), 6) AS took FROM w""")
def batch_summary(spark, sf_dir):
    w = signal(spark, sf_dir).groupBy("episode").agg(F.count_if(F.col("label") == "click").alias("ok"), F.count_if(F.col("x") > 200).alias("flagged"), F.count_distinct("label").alias("kinds"), F.round(F.avg(F.when(F.col("label") == "view", F.col("x"))), 6).alias("took"))
    return w.agg(F.count("*").alias("total"), F.sum("ok").alias("ok"), F.count_if(F.col("flagged") > 0).alias("flagged"), F.count_if(F.col("kinds") < 5).alias("partial"), F.round(F.avg("took"), 6).alias("took"))


@query("""SELECT o_custkey AS episode, o_orderkey AS done FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def latest_run(spark, sf_dir):
    return setops.first_of(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("done"))


@query(f"""WITH {SIGNAL}, c AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY episode ORDER BY i) <= 21600000000 THEN 0 ELSE 1 END AS c FROM sig), g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT episode, min(us) AS "start", count(*) AS n FROM g GROUP BY episode, g""")
def session_windows(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    return s.groupBy("episode", F.session_window("ts", "21600000001 microseconds").alias("w")).agg(F.count("*").alias("n")).select("episode", F.unix_micros("w.start").alias("start"), "n")


@query(f"""WITH {SIGNAL}, b AS (SELECT episode, i, x > 34 AS a, jaw > 50 AS b FROM sig) SELECT episode, round(corr(a::INT, b::INT), 6) AS phi FROM b GROUP BY ALL HAVING count(DISTINCT a) = 2 AND count(DISTINCT b) = 2""")
def phi_coefficient(spark, sf_dir):
    b = signal(spark, sf_dir).select("episode", (F.col("x") > 34).cast("int").alias("a"), (F.col("jaw") > 50).cast("int").alias("b"))
    g = b.groupBy("episode").agg(F.round(stats.correlation("a", "b"), 6).alias("phi"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    return g.filter("na = 2 and nb = 2").select("episode", "phi")


@query(f"""WITH {SIGNAL}, d AS (SELECT episode, i, x, CASE WHEN jaw < 20 AND lag(jaw) OVER w >= 20 THEN 1 ELSE 0 END AS c, jaw < 20 AS low FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i)), g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM d)
SELECT episode, count(DISTINCT g) AS dwells, max(n) AS longest FROM (SELECT episode, g, count(*) AS n FROM g WHERE low GROUP BY ALL) GROUP BY ALL""")
def jaw_dwells(spark, sf_dir):
    d = islands.run_ids(signal(spark, sf_dir), K, ["i"], F.col("jaw") < 20).filter("_f")
    r = d.groupBy("episode", "run").agg(F.count("*").alias("n"))
    return r.groupBy("episode").agg(F.count("*").alias("dwells"), F.max("n").alias("longest"))


@query(f"""WITH {SIGNAL}, p AS (SELECT *, lag(x, 1) OVER w AS a, lead(x, 1) OVER w AS b FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i)) SELECT episode, count(*) FILTER (a < 50 AND x > 150 AND b < 50) AS brief, count(*) FILTER (a > 50 AND x < 10 AND b > 50) AS gaps FROM p GROUP BY ALL""")
def brief_contacts(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("i")
    d = signal(spark, sf_dir).select("episode", "x", F.lag("x").over(w).alias("a"), F.lead("x").over(w).alias("b"))
    return d.groupBy("episode").agg(F.count_if((F.col("a") < 50) & (F.col("x") > 150) & (F.col("b") < 50)).alias("brief"), F.count_if((F.col("a") > 50) & (F.col("x") < 10) & (F.col("b") > 50)).alias("gaps"))
