"""Registered queries: scalars, annotations, trimming, screening, detection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotate, detect, kernels, screen, trim
from .catalog import K, query, rounded
from .views import ATOMS, FRAMES, SIGNAL, atoms, frames, signal, table

# --- scalars ---


@query(f"""WITH {SIGNAL} SELECT episode, i, concat_ws(' ', '[auto:' || CASE WHEN x > 200 THEN 'high' ELSE 'low' END || '] ' || label, CASE WHEN i % 3 > 0 THEN 'f' || (i % 3 - 1) END, printf('%.2fs', floor(t)), CASE WHEN x > 50 THEN printf('n %.1f', floor(x)) END, CASE WHEN i % 2 = 0 THEN '(even)' END) AS content FROM sig""")
def atom_format(spark, sf_dir):
    s = signal(spark, sf_dir)
    conf, finger = F.when(F.col("x") > 200, "high").otherwise("low"), F.when(F.col("i") % 3 > 0, (F.col("i") % 3 - 1).cast("int"))
    return s.select("episode", "i", scalars.atom_content(F.col("label"), conf, finger, F.floor("t").cast("double"), F.when(F.col("i") % 2 == 0, "even"), n=F.when(F.col("x") > 50, F.floor("x").cast("double"))).alias("content"))


@query(f"""WITH {SIGNAL}, c AS (SELECT episode, i, '[auto:' || CASE WHEN x > 200 THEN 'high' ELSE 'low' END || '] ' || label || CASE WHEN i % 3 > 0 THEN ' f' || (i % 3 - 1) ELSE '' END || CASE WHEN i % 2 = 0 THEN printf(' %.2fs', x) ELSE '' END AS content FROM sig)
SELECT episode, i, regexp_extract(content, '^\\[auto:(\\w+)\\]', 1) AS conf, regexp_extract(content, '^\\[auto:\\w+\\] (\\w+)', 1) AS label, nullif(regexp_extract(content, ' (f\\d)', 1), '') AS finger, try_cast(nullif(regexp_extract(content, ' ([\\d.]+)s$', 1), '') AS DOUBLE) AS seconds FROM c""")
def atom_parse(spark, sf_dir):
    s = signal(spark, sf_dir)
    content = F.concat(F.lit("[auto:"), F.when(F.col("x") > 200, "high").otherwise("low"), F.lit("] "), "label", F.when(F.col("i") % 3 > 0, F.concat(F.lit(" f"), F.col("i") % 3 - 1)).otherwise(""), F.when(F.col("i") % 2 == 0, F.format_string(" %.2fs", "x")).otherwise(""))
    return s.select("episode", "i", scalars.atom_parts(content).alias("p")).select("episode", "i", "p.*")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref FROM pages WHERE url SIMILAR TO '[!-~]+'""")
def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter(F.col("url").rlike("^[!-~]+$"))
    return p.select("page_id", scalars.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice > 0 THEN least(1.0, greatest(0.0, (ln(p_retailprice) - ln(900.0)) / (ln(1900.0) - ln(900.0)))) END, 6) AS log_unit, round(least(1.0, greatest(0.0, (p_retailprice - 900.0) / 1000.0)), 6) AS unit FROM part""")
def depth_norm(spark, sf_dir):
    u = lambda log: scalars.depth_unit(F.col("p_retailprice"), F.lit(900.0), F.lit(1900.0), log)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(u(True), 6).alias("log_unit"), F.round(u(False), 6).alias("unit"))


@query("""SELECT o_orderkey, 'data/chunk-' || lpad((o_orderkey // 1000)::VARCHAR, greatest(3, length((o_orderkey // 1000)::VARCHAR))::INT, '0') || '/file-' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.parquet' AS path,
CASE WHEN o_custkey < 60 THEN o_custkey || ' s' WHEN o_custkey < 3600 THEN (o_custkey // 60) || ' m ' || lpad((o_custkey % 60)::VARCHAR, 2, '0') || ' s' ELSE (o_custkey // 3600) || ' h ' || (o_custkey % 3600 // 60) || ' m' END AS took FROM orders""")
def paths_and_durations(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.chunk_path("data", F.floor(k / 1000), k % 1000, ".parquet").alias("path"), scalars.duration(F.col("o_custkey").cast("double")).alias("took"))


@query(f"""WITH {SIGNAL} SELECT episode, i, round(CASE WHEN x / 490 < 0 THEN 0.0 WHEN x / 490 < 0.5 THEN 0 + 40 * x / 490 / 0.5 WHEN x / 490 < 1 THEN 40 + 60 * (x / 490 - 0.5) / 0.5 ELSE 100 END, 6) AS colour FROM sig""")
def colour_ramp(spark, sf_dir):
    u = F.col("x") / 490
    return signal(spark, sf_dir).select("episode", "i", F.round(scalars.ramp(u, [(0.0, 0.0), (0.5, 40.0), (1.0, 100.0)]), 6).alias("colour"))


# --- shaping ---


@query(f"""WITH {FRAMES} SELECT episode, i, dim, v FROM (UNPIVOT (SELECT episode, i, q AS "state | q", p AS "state | p", d AS "action | q" FROM fr) ON COLUMNS(* EXCLUDE (episode, i)) INTO NAME dim VALUE v)""")
def series_flatten(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("episode", "i", F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(c).alias("v")) for n, c in (("state | q", "q"), ("state | p", "p"), ("action | q", "d"))])).alias("e")).select("episode", "i", "e.*")


@query("""SELECT suffix, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM (SELECT DISTINCT o_orderstatus || ' | ' || o_orderpriority AS name, o_orderpriority AS suffix FROM orders) GROUP BY suffix""")
def suffix_groups(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.concat_ws(" | ", "o_orderstatus", "o_orderpriority").alias("name")).distinct()
    return names.withColumn("suffix", F.split("name", r" \| ")[1]).groupBy("suffix").agg(F.concat_ws(",", F.array_sort(F.collect_list("name"))).alias("names"), F.count("*").alias("n"))


@query(f"""WITH {SIGNAL}, s AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM sig) SELECT episode, i, x FROM s WHERE i % greatest(1, floor(n / 20)::BIGINT) = 0""")
def chart_decimation(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("episode"))
    return signal(spark, sf_dir).withColumn("n", n).filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 20)) == 0).select("episode", "i", "x")


@query(f"""WITH {FRAMES} SELECT task, CASE WHEN max(abs(q)) > 49 THEN 'ticks' WHEN max(abs(q)) > 6.3 THEN 'degrees' ELSE 'radians' END AS unit FROM fr GROUP BY ALL""")
def joint_units(spark, sf_dir):
    top = F.max(F.abs("q"))
    return frames(spark, sf_dir).groupBy("task").agg(F.when(top > 49, "ticks").when(top > 6.3, "degrees").otherwise("radians").alias("unit"))


# --- annotations ---

MADE = """kept AS (SELECT episode, ts, style, CASE WHEN episode % 4 = 0 AND style = 'interjection' THEN '[auto:high] slip f0 1.00s' ELSE content END AS content, CASE WHEN episode % 3 = 0 AND style = 'subtask' THEN 'auto' END AS origin FROM atoms),
made AS (SELECT episode, ts + 0.1 AS ts, style, CASE WHEN episode % 2 = 0 THEN content ELSE '[auto:low] phantom' END AS content, 'auto' AS origin FROM atoms WHERE style <> 'memory')"""


def _made(spark, sf_dir):
    a = atoms(spark, sf_dir)
    content = F.when(F.expr("episode % 4 = 0 and style = 'interjection'"), "[auto:high] slip f0 1.00s").otherwise(F.col("content"))
    kept = a.select("episode", "ts", "style", content.alias("content"), F.when(F.expr("episode % 3 = 0 and style = 'subtask'"), "auto").alias("origin"))
    made = a.filter("style <> 'memory'").select("episode", (F.col("ts") + 0.1).alias("ts"), "style", F.when(F.expr("episode % 2 = 0"), F.col("content")).otherwise("[auto:low] phantom").alias("content"), F.lit("auto").alias("origin"))
    return kept, made


@query(f"""WITH {ATOMS}, {MADE}, human AS (SELECT * FROM kept WHERE NOT ((style = 'interjection' AND starts_with(content, '[auto:')) OR (style = 'subtask' AND coalesce(origin, '') = 'auto')))
SELECT style, origin, count(*) AS n, round(sum(ts), 3) AS s FROM (SELECT * FROM human UNION ALL SELECT * FROM made m WHERE NOT EXISTS (SELECT 1 FROM human h WHERE h.style = 'subtask' AND h.episode = m.episode AND h.style = m.style AND h.content = m.content) AND NOT regexp_matches(content, '^\\[auto:\\w+\\] (finger_unload|sensor_residual|phantom)\\b')) GROUP BY ALL""")
def atom_merge(spark, sf_dir):
    out = annotate.merge(*_made(spark, sf_dir), "episode", verified=False)
    return out.groupBy("style", "origin").agg(F.count("*").alias("n"), F.round(F.sum("ts"), 3).alias("s"))


@query(f"""WITH {ATOMS}, {SIGNAL}, f AS (SELECT episode, t / 100000 AS ts FROM sig GROUP BY ALL), e AS (SELECT a.episode, a.ts, a.content, (SELECT min(struct_pack(g := abs(f.ts - a.ts), f := f.ts)) FROM f WHERE f.episode = a.episode) AS m FROM atoms a WHERE style = 'interjection')
SELECT f.episode, count(*) AS frames, sum(coalesce(p.n, 0))::BIGINT AS persistent, sum(coalesce(e.n, 0))::BIGINT AS events FROM f LEFT JOIN (SELECT episode, count(*) AS n FROM atoms WHERE style IN ('subtask', 'memory', 'plan') GROUP BY ALL) p USING (episode) LEFT JOIN (SELECT episode, m.f AS ts, count(*) AS n FROM e WHERE m.f IS NOT NULL GROUP BY ALL) e ON e.episode = f.episode AND e.ts = f.ts GROUP BY ALL""")
def language_export(spark, sf_dir):
    f = signal(spark, sf_dir).select("episode", (F.col("t") / 100000).alias("ts")).distinct()
    out = annotate.with_language(f, atoms(spark, sf_dir), "episode", "ts")
    return out.groupBy("episode").agg(F.count("*").alias("frames"), F.sum(F.size("language_persistent")).cast("long").alias("persistent"), F.sum(F.size("language_events")).cast("long").alias("events"))


@query(f"""WITH {SIGNAL} SELECT label AS kind, string_agg(episode::VARCHAR, ', ' ORDER BY episode) AS ids FROM (SELECT DISTINCT label, episode FROM sig WHERE x > 150) GROUP BY ALL""")
def flagged_export(spark, sf_dir):
    return annotate.flagged_ids(signal(spark, sf_dir).filter("x > 150").select(F.col("label").alias("kind"), "episode"), "episode")


# --- trimming ---

PROPOSED = f"""{SIGNAL}, s AS (SELECT episode, i, coalesce(abs(jaw - lag(jaw) OVER w), 0) > 20 AS c, coalesce(abs(x - lag(x) OVER w), 0) > 20 AS m FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i)),
k AS (SELECT *, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS cc, CASE WHEN m = lag(m) OVER w THEN 0 ELSE 1 END AS mc FROM s WINDOW w AS (PARTITION BY episode ORDER BY i)), g AS (SELECT *, sum(cc) OVER w AS cg, sum(mc) OVER w AS mg FROM k WINDOW w AS (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING)),
a AS (SELECT episode, min(i) AS onset FROM (SELECT episode, cg, min(i) AS i FROM g WHERE c GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL), b AS (SELECT episode, max(i) AS stop FROM (SELECT episode, mg, max(i) AS i FROM g WHERE m GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
p AS (SELECT episode, n AS frames, onset, stop, greatest(coalesce(onset - 1, 0), 0) AS "start", least(coalesce(stop + 2, n - 1), n - 1) AS "end" FROM (SELECT episode, count(*) AS n FROM sig GROUP BY ALL) LEFT JOIN a USING (episode) LEFT JOIN b USING (episode))"""


def _proposed(spark, sf_dir):
    return trim.propose(signal(spark, sf_dir), K, "i", "jaw", "x", 20.0, 2, 2, 1, 2)


@query(f"WITH {PROPOSED} SELECT * FROM p")
def trim_propose(spark, sf_dir):
    return _proposed(spark, sf_dir)


@query(f"""WITH {PROPOSED}, r AS (SELECT episode, i - "start" AS frame_index, x FROM sig JOIN p USING (episode) WHERE i BETWEEN "start" AND "end"), l AS (SELECT episode, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT episode, coalesce(sum(n) OVER (ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, row_number() OVER (ORDER BY episode) - 1 AS e FROM l)
SELECT e AS new_episode, frame_index, round(frame_index / 30.0::DOUBLE, 6) AS timestamp, (o + frame_index)::BIGINT AS "index", x FROM r JOIN o USING (episode)""")
def trim_rebase(spark, sf_dir):
    cuts = trim.check_cuts(_proposed(spark, sf_dir))
    out = trim.rebase(signal(spark, sf_dir), cuts, "episode", "i", 30.0, renumber=True)
    return rounded(out.select("new_episode", "frame_index", "timestamp", "index", "x"), "timestamp")


@query("""WITH n AS (SELECT l_orderkey AS episode, count(*) AS length FROM lineitem GROUP BY ALL) SELECT episode, length, (sum(length) OVER (ORDER BY episode ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS from_index, (sum(length) OVER (ORDER BY episode ROWS UNBOUNDED PRECEDING))::BIGINT AS to_index, row_number() OVER (ORDER BY episode) - 1 AS episode_number FROM n""")
def trim_metadata(spark, sf_dir):
    return trim.metadata(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode")), "episode")


@query(f"""WITH {ATOMS}, w AS (SELECT DISTINCT episode, (episode % 3) * 0.5::DOUBLE AS shift, 1.0::DOUBLE AS kept FROM atoms) SELECT episode, greatest(ts - shift, 0) AS ts, style, content FROM atoms JOIN w USING (episode) WHERE ts - shift BETWEEN -1e-9 AND kept + 1e-9""")
def atom_shift(spark, sf_dir):
    a = atoms(spark, sf_dir).drop("role")
    w = a.select("episode").distinct().withColumn("shift", (F.col("episode") % 3) * 0.5).withColumn("kept", F.lit(1.0))
    return trim.shift_atoms(a, w, "episode", "ts")


# --- screening ---

KNN = """q AS (SELECT vec_id, embedding::DOUBLE[64] AS e, vec_id % 11 AS g FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query, x.vec_id AS id, x.label, array_distance(q.e, x.embedding::DOUBLE[64]) AS distance FROM q, embeddings x WHERE x.vec_id % 11 <> q.g), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 7)"""


def _knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("g", F.col("vec_id") % 11)
    return screen.nearest(e.filter("vec_id % 50 = 0"), e, 7, "vec_id", "embedding", "g", "label")


@query(f"WITH {KNN} SELECT query, rank::INT AS rank, id, label, round(distance, 5) AS distance FROM k")
def knn_nearest(spark, sf_dir):
    return rounded(_knn(spark, sf_dir), "distance", digits=5)


@query(f"WITH {KNN} SELECT query, CASE WHEN count(*) >= 7 THEN count(*) FILTER (label = 3) END AS votes FROM k GROUP BY ALL")
def knn_votes(spark, sf_dir):
    return screen.votes(_knn(spark, sf_dir), 7, 3)


@query(f"""WITH {SIGNAL}, s AS (SELECT episode, avg(x) AS m, greatest(stddev_pop(x), 1e-9) AS s FROM sig GROUP BY ALL) SELECT episode, i, round((x - m) / s, 6) AS x FROM sig JOIN s USING (episode)""")
def zscore(spark, sf_dir):
    return rounded(screen.zscores(signal(spark, sf_dir).select("episode", "i", "x"), ["x"], ["episode"]).select("episode", "i", "x"), "x")


@query()
def window_features(spark, sf_dir):
    s = signal(spark, sf_dir)
    out = screen.window_features(s.groupBy("episode", "t").agg(F.max("x").alias("x")), s.filter("label = 'purchase'").select("episode", "t").distinct(), K, "t", "x", 7200.0, 16)
    return out.select("episode", F.round("centre", 3).alias("centre"), F.transform("features", lambda v: F.round(v, 4)).alias("features"))


# --- kernels and the detector ---


# The SQL of these queries folds row by row, so that it shares no step with the Spark code.


@query(f"""WITH RECURSIVE {SIGNAL.replace("sig AS (", "sig AS MATERIALIZED (")}, n AS MATERIALIZED (SELECT episode, (count(*) - 1) / nullif(max(t), 0) AS rate FROM sig GROUP BY ALL),
st AS (SELECT episode, -1::BIGINT AS i, 0.0::DOUBLE AS zero, NULL::DOUBLE AS t, 0.0::DOUBLE AS rest FROM sig WHERE i = 0
  UNION ALL SELECT g.episode, g.i, CASE WHEN abs(g.x - zero) < 40 THEN zero + least(1.0, (CASE WHEN st.t IS NULL THEN 1 / coalesce(rate, 30.0) ELSE g.t - st.t END) / 86400.0::DOUBLE) * (g.x - zero) ELSE zero END, g.t, greatest(g.x - zero, 0) FROM st JOIN sig g ON g.episode = st.episode AND g.i = st.i + 1 JOIN n ON n.episode = g.episode)
SELECT episode, i, round(rest, 6) AS rest FROM st WHERE i >= 0""")
def adaptive_baseline(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"], "rest": kernels.baseline(pdf["t"].to_numpy(), pdf["x"].to_numpy(), 0.0, 86400.0, 40.0).round(6)})

    return kernels.per_episode(signal(spark, sf_dir).select("episode", "i", "t", "x"), "episode", "i", run, "i int, rest double")


GATE = """f AS (SELECT episode, i, t, x > 34 AS f, lead(t) OVER w AS nx, t - lag(t) OVER w AS d, CASE WHEN (x > 34) = (lag(x) OVER w > 34) THEN 0 ELSE 1 END AS c FROM sig WINDOW w AS (PARTITION BY episode ORDER BY i)),
m AS (SELECT episode, coalesce(quantile_cont(d, 0.5), 0) AS step FROM f GROUP BY ALL), r0 AS (SELECT *, sum(c) OVER (PARTITION BY episode ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS MATERIALIZED (SELECT episode, run, f, max(coalesce(nx, t + step)) - min(t) >= 14400 AS long FROM r0 JOIN m USING (episode) GROUP BY ALL),
st AS (SELECT episode, run, f AND long AS seen, FALSE AS armed FROM r WHERE run = 1
  UNION ALL SELECT r.episode, r.run, st.seen OR (f AND long), CASE WHEN f AND long THEN FALSE WHEN NOT f AND long AND st.seen THEN TRUE ELSE armed END FROM st JOIN r ON r.episode = st.episode AND r.run = st.run + 1)"""


@query(f"""WITH RECURSIVE {SIGNAL}, {GATE} SELECT episode, i, NOT armed AS open FROM r0 JOIN st USING (episode, run)""")
def residual_gate(spark, sf_dir):
    return detect.residual_gate(signal(spark, sf_dir).select("episode", "i", "t", "x"), "episode", "i", "t", "x", 34.0, 14400.0).select("episode", "i", "open")


@query()
def changepoints(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernels.changepoints(pdf["x"].to_numpy(), 14, 0.02, 3), columns=["at", "gain"]).round({"gain": 4})

    return kernels.per_episode(signal(spark, sf_dir).select("episode", "i", "x"), "episode", "i", run, "at int, gain double")


@query(f"""WITH RECURSIVE {SIGNAL.replace("sig AS (", "sig AS MATERIALIZED (")},
st AS (SELECT episode, 0::BIGINT AS i, FALSE AS falling, jaw AS xp, t AS tp, NULL::DOUBLE AS xl, NULL::DOUBLE AS tl, NULL::DOUBLE AS p, NULL::DOUBLE AS l, NULL::DOUBLE AS e FROM sig WHERE i = 0
  UNION ALL SELECT g.episode, g.i, CASE WHEN falling THEN NOT g.jaw - xl >= 60 ELSE xp - g.jaw >= 60 END,
    CASE WHEN falling THEN CASE WHEN g.jaw - xl >= 60 THEN g.jaw ELSE xp END WHEN g.jaw > xp THEN g.jaw ELSE xp END, CASE WHEN falling THEN CASE WHEN g.jaw - xl >= 60 THEN g.t ELSE tp END WHEN g.jaw > xp THEN g.t ELSE tp END,
    CASE WHEN falling THEN least(xl, g.jaw) WHEN xp - g.jaw >= 60 THEN g.jaw END, CASE WHEN falling AND g.jaw >= xl THEN tl WHEN falling OR xp - g.jaw >= 60 THEN g.t END,
    CASE WHEN falling AND g.jaw - xl >= 60 THEN tp END, CASE WHEN falling AND g.jaw - xl >= 60 THEN tl END, CASE WHEN falling AND g.jaw - xl >= 60 THEN g.t END FROM st JOIN sig g ON g.episode = st.episode AND g.i = st.i + 1)
SELECT episode, round(p, 6) AS peak, round(l, 6) AS trough, round(e, 6) AS "end" FROM st WHERE e IS NOT NULL""")
def air_miss(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernels.cycles(pdf["t"].to_numpy(), pdf["jaw"].to_numpy(), 60.0), columns=["peak", "trough", "end"]).astype(float).round(6)

    return kernels.per_episode(signal(spark, sf_dir).select("episode", "i", "t", "jaw"), "episode", "i", run, "peak double, trough double, end double")


RULES = detect.Rules(enter=34.0, leave=20.0, enter_s=3600.0, leave_s=3600.0, stable_least=40.0, stable_spread=0.8, window=4, slip_rough=80.0, open_travel=10.0, weak_peak=150.0, merge_s=7200.0, short_s=36000.0)

LATCH = f"""{SIGNAL.replace("sig AS (", "sig AS MATERIALIZED (")},
latch AS (SELECT episode, -1::BIGINT AS i, FALSE AS held, NULL::DOUBLE AS since, NULL::VARCHAR AS kind, NULL::DOUBLE AS "start", NULL::DOUBLE AS fired FROM sig WHERE i = 0
  UNION ALL SELECT episode, i, held <> fire, CASE WHEN wanted AND NOT fire THEN began END, CASE WHEN fire THEN CASE WHEN held THEN 'terminal' ELSE 'onset' END END, CASE WHEN fire THEN began END, CASE WHEN fire THEN t END
  FROM (SELECT *, coalesce(wanted AND t - began >= 3600, FALSE) AS fire FROM (SELECT g.episode, g.i, g.t, held, coalesce(CASE WHEN held THEN g.x < 20 ELSE g.x > 34 END, FALSE) AS wanted, coalesce(latch.since, g.t) AS began FROM latch JOIN sig g ON g.episode = latch.episode AND g.i = latch.i + 1)))"""


@query(f"""WITH RECURSIVE {LATCH} SELECT episode, kind, round("start", 6) AS "start", round(fired, 6) AS fired FROM latch WHERE kind IS NOT NULL""")
def contact_latch(spark, sf_dir):
    return rounded(detect.contacts(signal(spark, sf_dir), "episode", "i", "t", "x", RULES), "start", "fired")


@query()
def detect_events(spark, sf_dir):
    s = signal(spark, sf_dir)
    return detect.detect(s, "episode", "i", "t", "x", "jaw", RULES)


@query()
def recorded_events(spark, sf_dir):
    s = signal(spark, sf_dir)
    spans = detect.detect(s, "episode", "i", "t", "x", "jaw", RULES)
    return detect.recorded(s.select("episode", "i", F.col("t").alias("start"), F.col("label").alias("kind")), spans, "episode").groupBy("episode").agg(F.count("*").alias("n"))
