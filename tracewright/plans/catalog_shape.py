"""Registered queries: shaping of series and blocks, lookups, rollout scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, islands, kernels, shape, stats
from .catalog import HOUR, K, query, rounded
from .views import ATOMS, FRAMES, SIGNAL, atoms, frames, signal, table


@query(f"""WITH {SIGNAL}, c AS (SELECT *, count(*) FILTER (t <= 600000) OVER (PARTITION BY episode) AS n FROM sig) SELECT episode, i, x FROM c WHERE t <= 600000 OR n < 5""")
def clip_series(spark, sf_dir):
    return shape.clipped(signal(spark, sf_dir), K, "t", F.lit(600_000.0)).select("episode", "i", "x")


@query("""SELECT DISTINCT 'action | ' || p_brand AS action, 'state | ' || p_brand AS state FROM part""")
def pair_by_suffix(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    names = brands.select(F.explode(F.array(F.concat(F.lit("action | "), "p_brand"), F.concat(F.lit("state | "), "p_brand"))).alias("name"))
    return shape.pair_by_suffix(names, "name")


_Z = ", ".join(f"embedding[{3 * k + 3}]::DOUBLE" for k in range(21))


@query(f"""WITH b AS (SELECT vec_id, [{_Z}] AS zs, [{", ".join(f"embedding[{3 * k + 1}]::DOUBLE" for k in range(21))}] AS xs, [{", ".join(f"embedding[{3 * k + 2}]::DOUBLE" for k in range(21))}] AS ys FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(zs, lambda z: greatest(z, 0))), 5) AS fn, round(sqrt(pow(list_sum(xs), 2) + pow(list_sum(ys), 2)), 5) AS fs,
round(CASE WHEN list_sum(list_transform(zs, lambda z: CASE WHEN z > 0.05 THEN z ELSE 0 END)) > 0.2 THEN list_sum(list_transform(zs, lambda z, k: CASE WHEN z > 0.05 THEN z * (((k - 1) // 3) * 5.0::DOUBLE) ELSE 0 END)) / list_sum(list_transform(zs, lambda z: CASE WHEN z > 0.05 THEN z ELSE 0 END)) END, 5) AS cop_y,
len(list_filter(zs, lambda z: z > 0.15))::INT AS active FROM b""")
def tactile_reduce(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", *shape.block_channels(F.col("embedding"), 21, [5.0 * (k // 3) for k in range(21)]))
    return rounded(d, "fn", "fs", "cop_y", digits=5)


@query("""WITH a AS (SELECT unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS axis FROM embeddings)
SELECT axis, count(v) AS n, round(min(v), 5) AS "min", round(max(v), 5) AS "max", round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(quantile_cont(v, 0.5), 5) AS q50 FROM a GROUP BY ALL""")
def axis_stats(spark, sf_dir):
    return rounded(shape.axis_stats(table(spark, sf_dir, "embeddings"), "embedding"), "min", "max", "mean", "std", "q50", digits=5)


@query(f"""WITH {SIGNAL}, s AS (SELECT *, max(t) OVER (PARTITION BY episode) AS len, count(*) OVER (PARTITION BY episode) AS n FROM sig)
SELECT episode, i AS rank, round(i / greatest(n - 1, 1)::DOUBLE * 100, 6) AS "at", CASE WHEN x > 300 THEN jaw ELSE x END AS progress FROM s""")
def progress_curve(spark, sf_dir):
    d = signal(spark, sf_dir).withColumn("a", F.when(F.col("x") > 300, F.lit(float("nan"))).otherwise(F.col("x")))
    return rounded(shape.progress(d, "episode", ["i"], ["a", "jaw"], F.lit(100.0)), "at")


@query(f"""WITH {SIGNAL}, g AS (SELECT episode, max(jaw) - min(jaw) AS range, greatest(max(jaw) - arg_min(jaw, i), arg_min(jaw, i) - min(jaw)) AS moved FROM sig GROUP BY ALL) SELECT *, range >= 0.15::DOUBLE * 100 AND moved > 0.35::DOUBLE * range AS actuated FROM g""")
def gripper_actuated(spark, sf_dir):
    return shape.actuated(signal(spark, sf_dir), K, "jaw", 100.0)


@query(f"""WITH {FRAMES} SELECT task, s_name, count(*) AS n FROM fr LEFT JOIN supplier ON s_suppkey = task GROUP BY ALL""")
def task_lookup(spark, sf_dir):
    n = frames(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"))
    return n.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), "s_name"), "task", "left")


@query(f"""WITH {SIGNAL}, m AS (SELECT episode, i, t, label, CASE label WHEN 'purchase' THEN 1 WHEN 'signup' THEN 0 END AS mark FROM sig)
SELECT episode, i, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY episode ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS partner_holds FROM m QUALIFY label = 'click'""")
def partner_holding(spark, sf_dir):
    w = Window.partitionBy("episode").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("label") == "purchase", 1).when(F.col("label") == "signup", 0)
    d = signal(spark, sf_dir).withColumn("m", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)) == 1)
    return d.filter("label = 'click'").select("episode", "i", F.col("m").alias("partner_holds"))


@query(f"""WITH {ATOMS}, s AS (SELECT episode, t FROM (SELECT DISTINCT episode FROM atoms), (VALUES (0.1), (0.6), (1.1), (1.6)) v(t)), p AS (SELECT episode, ts, min(content) AS content FROM atoms WHERE style = 'subtask' GROUP BY ALL)
SELECT s.episode, s.t::DOUBLE AS ts, coalesce(b.content, f.content) AS stage FROM s ASOF LEFT JOIN p b ON s.episode = b.episode AND s.t >= b.ts LEFT JOIN (SELECT episode, arg_min(content, ts) AS content FROM p GROUP BY ALL) f ON f.episode = s.episode""")
def stage_at_frame(spark, sf_dir):
    a = atoms(spark, sf_dir)
    s = a.select("episode").distinct().select("episode", F.explode(F.array(*[F.lit(v) for v in (0.1, 0.6, 1.1, 1.6)])).alias("ts"))
    p = a.filter("style = 'subtask'").groupBy("episode", "ts").agg(F.min("content").alias("content"))
    return asof.backward(s, p, K, "ts", "content", "stage", clamp=True)


@query(f"""WITH {SIGNAL}, f AS (SELECT episode, x / 10 AS spot FROM sig WHERE label = 'view'), n AS (SELECT episode, count(*) AS n FROM sig GROUP BY ALL) SELECT episode, spot, least(floor(spot * 2 + 0.5)::BIGINT, n - 1) AS frame FROM f JOIN n USING (episode)""")
def frame_index(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("episode"))
    d = signal(spark, sf_dir).withColumn("n", n).filter("label = 'view'").withColumn("spot", F.col("x") / 10)
    return d.select("episode", "spot", F.least(F.floor(F.col("spot") * 2 + 0.5), F.col("n") - 1).alias("frame"))


@query("""WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders), p AS (SELECT c_custkey, TIMESTAMP '1995-06-17' AS limit_at FROM customer),
b AS (SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM p JOIN s ON o_custkey = c_custkey AND o_orderdate <= limit_at GROUP BY ALL), l AS (SELECT o_custkey AS c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM s GROUP BY ALL)
SELECT l.c_custkey, coalesce(b.k, l.k) AS session FROM l JOIN customer USING (c_custkey) LEFT JOIN b USING (c_custkey)""")
def session_pick(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.struct("o_orderdate", "o_orderkey")
    before = F.expr("o_orderdate <= TIMESTAMP_NTZ '1995-06-17 00:00:00'")
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(before, key)).alias("b"), F.max(key).alias("l"))
    return g.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", F.coalesce("b.o_orderkey", "l.o_orderkey").alias("session"))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS folder, count(*) AS files, min(page_id) AS first, string_agg(DISTINCT split_part(split_part(regexp_extract(url, '^[a-z]+://[^/?#]+/(.*)$', 1), '/', 1), '?', 1), ',' ORDER BY split_part(split_part(regexp_extract(url, '^[a-z]+://[^/?#]+/(.*)$', 1), '/', 1), '?', 1)) AS parts FROM pages WHERE url LIKE '%/%' GROUP BY ALL""")
def folder_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter(F.col("url").contains("/"))
    rest = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/(.*)$", 1)
    part = F.split(F.split(rest, "/")[0], r"\?")[0]
    return p.groupBy(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("folder")).agg(F.count("*").alias("files"), F.min("page_id").alias("first"), F.array_join(F.array_sort(F.collect_set(part)), ",").alias("parts"))


@query(f"""WITH {SIGNAL}, r AS (SELECT episode, min(i) FILTER (x > 100) AS a, max(i) FILTER (x > 100) AS b FROM sig GROUP BY ALL) SELECT episode, '{{"' || episode || '":[' || a || ',' || b || ']}}' AS cuts FROM r WHERE a IS NOT NULL""")
def cuts_document(spark, sf_dir):
    """One JSON line for each episode that has a cut."""
    r = signal(spark, sf_dir).filter("x > 100").groupBy("episode").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return r.select("episode", F.concat(F.lit('{"'), "episode", F.lit('":['), "a", F.lit(","), "b", F.lit("]}")).alias("cuts"))


@query(f"""WITH {SIGNAL}, c AS (SELECT *, CASE WHEN (x > 34) = (lag(x) OVER (PARTITION BY episode ORDER BY i) > 34) THEN 0 ELSE 1 END AS c FROM sig), g AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c),
r AS (SELECT episode, g, min(t) AS s, max(t) AS e, max(x) AS peak FROM g WHERE x > 34 GROUP BY ALL) SELECT r.episode, count(*) AS spans, count(*) FILTER (low < 2) AS air, count(*) FILTER (NOT coalesce(low < 2, FALSE) AND peak < 60) AS weak FROM (SELECT r.*, (SELECT min(z.jaw) FROM sig z WHERE z.episode = r.episode AND z.t BETWEEN r.s AND r.e) AS low FROM r) r GROUP BY ALL""")
def attempt_classes(spark, sf_dir):
    d = islands.run_ids(signal(spark, sf_dir), K, ["i"], F.col("x") > 34).filter("_f")
    # rows inside a span's times are those of the span: spans are maximal runs of rows
    r = d.groupBy("episode", "run").agg(F.max("x").alias("peak"), F.min("jaw").alias("low"))
    air = F.col("low") < 2
    return r.groupBy("episode").agg(F.count("*").alias("spans"), F.count_if(air).alias("air"), F.count_if(~F.coalesce(air, F.lit(False)) & (F.col("peak") < 60)).alias("weak"))


@query(f"""WITH {SIGNAL}, d AS (SELECT episode, t - lag(t) OVER (PARTITION BY episode ORDER BY i) AS d FROM sig), g AS (SELECT episode, count(*) FILTER (d > 28800) AS slow, max(d) / 28800 AS worst FROM d GROUP BY ALL) SELECT episode, slow, slow >= 2 AND worst >= 1.2 AS hesitation FROM g""")
def hesitation(spark, sf_dir):
    d = signal(spark, sf_dir).select("episode", (F.col("t") - F.lag("t").over(Window.partitionBy("episode").orderBy("i"))).alias("d"))
    g = d.groupBy("episode").agg(F.count_if(F.col("d") > 8 * HOUR).alias("slow"), (F.max("d") / (8 * HOUR)).alias("worst"))
    return g.select("episode", "slow", ((F.col("slow") >= 2) & (F.col("worst") >= 1.2)).alias("hesitation"))


@query("""SELECT event_id, CASE WHEN k IS NULL THEN NULL WHEN k % 2 = 0 THEN 'count' ELSE 'attribute' END AS kind, k FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def vqa_parse(spark, sf_dir):
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    d = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    return d.select("event_id", F.when(F.col("k").isNull(), None).when(F.col("k") % 2 == 0, "count").otherwise("attribute").alias("kind"), "k")


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS instruction FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(trim(text)) > 0) GROUP BY ALL""")
def language_instruction(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").filter("role = 'user' and length(trim(text)) > 0")
    return u.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("s")))), lambda r: r["s"]), "\n").alias("instruction"))


@query(f"""WITH {SIGNAL}, g AS (SELECT thr::INT AS thr, hold::INT AS hold FROM (VALUES (10), (20), (50)) a(thr), (VALUES (1), (2), (3)) b(hold)), f AS (SELECT episode, i, thr, x > thr AS f FROM sig, (VALUES (10), (20), (50)) a(thr)),
c AS (SELECT *, CASE WHEN f = lag(f) OVER w THEN 0 ELSE 1 END AS c FROM f WINDOW w AS (PARTITION BY episode, thr ORDER BY i)), r AS (SELECT episode, thr, run, min(i) AS a, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY episode, thr ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c) WHERE f GROUP BY ALL),
o AS (SELECT r.episode, g.thr, g.hold, min(a) AS onset FROM g JOIN r ON r.thr = g.thr AND r.n >= g.hold GROUP BY ALL), m AS (SELECT thr, hold, quantile_cont(onset, 0.5) AS median FROM o GROUP BY ALL)
SELECT o.thr, o.hold, count(*) AS episodes, median, round(count(*) FILTER (abs(onset - median) <= 3) / count(*)::DOUBLE, 6) AS near FROM o JOIN m USING (thr, hold) GROUP BY ALL""")
def trim_rule_search(spark, sf_dir):
    s = signal(spark, sf_dir).select("episode", "i", "x", F.explode(F.array(*[F.lit(v) for v in (10, 20, 50)])).alias("thr"))
    d = islands.run_ids(s, ["episode", "thr"], ["i"], F.col("x") > F.col("thr")).filter("_f").groupBy("episode", "thr", "run").agg(F.min("i").alias("a"), F.count("*").alias("n"))
    o = d.withColumn("hold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter("n >= hold").groupBy("episode", "thr", "hold").agg(F.min("a").alias("onset"))
    m = o.groupBy("thr", "hold").agg(F.percentile("onset", F.lit(0.5)).alias("median"))
    g = o.join(F.broadcast(m), ["thr", "hold"]).groupBy("thr", "hold").agg(F.count("*").alias("episodes"), F.first("median").alias("median"), F.count_if(F.abs(F.col("onset") - F.col("median")) <= 3).alias("k"))
    return g.select("thr", "hold", "episodes", "median", F.round(F.col("k") / F.col("episodes"), 6).alias("near"))


@query()
def scale_groups(spark, sf_dir):
    """Series of each task by scale: the few series of one task meet in one small group."""
    long = frames(spark, sf_dir).select("task", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in "qpdx"])).alias("e")).groupBy("task", "e.name").agg(F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = kernels.scale_groups(list(pdf[["name", "lo", "hi"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"scale": range(len(g)), "names": [",".join(x) for x in g]})

    return kernels.per_episode(long, "task", "name", run, "scale int, names string")


@query()
def clock_map(spark, sf_dir):
    """Anchors between two clocks: each episode's resampled frames (one for each slot of its device grid)
    against its raw rows, by value."""
    s = signal(spark, sf_dir)
    grid = islands.first_per_slot(s, K, "t", 0.0001, ["i"]).select("episode", "i", F.col("slot").cast("double").alias("slot"))
    both = s.select("episode", "i", "t", "x").join(grid, ["episode", "i"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf[pdf["slot"].notna()]
        a = kernels.clock_map(some["slot"].to_numpy(float), some["x"].to_numpy(float), pdf["t"].to_numpy(float), pdf["x"].to_numpy(float), 0.051, 5)
        return pd.DataFrame(a, columns=["frame", "raw"]).astype(float)

    return kernels.per_episode(both, "episode", "i", run, "frame double, raw double")


@query(f"""WITH {SIGNAL}, d AS (SELECT label, x - avg(x) OVER (PARTITION BY episode) AS d FROM sig), r AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS r, count(*) OVER (PARTITION BY label) AS n FROM d)
SELECT label, round(max(CASE WHEN r = least(floor(n * 0.05::DOUBLE) + 1, n) THEN d END), 6) AS p05, round(max(CASE WHEN r = least(floor(n * 0.5::DOUBLE) + 1, n) THEN d END), 6) AS p50, round(max(CASE WHEN r = least(floor(n * 0.95::DOUBLE) + 1, n) THEN d END), 6) AS p95 FROM r GROUP BY ALL""")
def deviation_ranks(spark, sf_dir):
    d = signal(spark, sf_dir).select("label", (F.col("x") - F.avg("x").over(Window.partitionBy("episode"))).alias("d"))
    return rounded(stats.rank_values(d, ["label"], "d", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), "p05", "p50", "p95")
