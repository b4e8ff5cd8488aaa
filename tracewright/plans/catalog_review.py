"""Registered queries: annotation upgrade, validation, review and commit rules, trim decisions, series picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotate, shape, trim
from .catalog import query, rounded
from .views import ATOMS, FRAMES, SIGNAL, atoms, frames, signal, table


def _legacy(spark, sf_dir):
    """One old annotation document a conversation: answers as subtasks, prompts and system texts as high levels."""
    c = table(spark, sf_dir, "conversations").withColumn("start", F.col("turn") * 0.5)
    is_ = lambda role: F.when(F.col("role") == role, F.col("text"))
    sub = F.collect_list(F.when(F.col("role") == "assistant", F.struct(F.col("text").alias("label"), "start")))
    high = F.collect_list(F.when(F.col("role") != "assistant", F.struct("start", is_("user").alias("user_prompt"), is_("system").alias("robot_utterance"))))
    return c.groupBy(F.col("conv_id").alias("episode")).agg(F.to_json(F.struct(sub.alias("subtasks"), high.alias("high_levels"))).alias("document"))


def _upgraded(spark, sf_dir):
    return annotate.upgraded(_legacy(spark, sf_dir), "episode", "document")


@query("""SELECT conv_id AS episode, turn * 0.5::DOUBLE AS "timestamp", CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, CASE role WHEN 'user' THEN 'interjection' WHEN 'assistant' THEN 'subtask' END AS style, CASE WHEN role <> 'system' THEN text END AS content
FROM conversations WHERE text IS NOT NULL AND (role = 'assistant' OR (role IN ('user', 'system') AND length(text) > 0))""")
def legacy_upgrade(spark, sf_dir):
    return _upgraded(spark, sf_dir).drop("tool_calls")


@query("""SELECT conv_id AS episode, turn * 0.5::DOUBLE AS "timestamp", text AS say FROM conversations WHERE role = 'system' AND length(text) > 0""")
def speech_atoms(spark, sf_dir):
    say = annotate.speech_text(F.col("role"), F.col("style"), F.col("tool_calls"))
    return _upgraded(spark, sf_dir).select("episode", "timestamp", say.alias("say")).filter("say is not null")


@query(f"""WITH {ATOMS}, a AS (SELECT episode, ts, CASE WHEN ts = 1 THEN 'narration' WHEN ts = 1.5 THEN NULL ELSE style END AS style, CASE WHEN ts <> 0.5 THEN content END AS content, CASE WHEN length(content) > 80 THEN 1 ELSE 0 END AS calls, CASE WHEN length(content) > 60 THEN 'front' ELSE '' END AS camera FROM atoms)
SELECT episode, ts, CASE WHEN style NOT IN ('subtask', 'plan', 'memory', 'motion', 'task_aug', 'interjection', 'vqa', 'trace') THEN 'style' WHEN content IS NULL AND calls = 0 THEN 'empty' WHEN style IS NULL AND calls = 0 THEN 'speech' WHEN camera <> '' AND style NOT IN ('vqa', 'trace') THEN 'camera' END AS fault FROM a""")
def atom_faults(spark, sf_dir):
    style = F.when(F.col("ts") == 1, "narration").when(F.col("ts") != 1.5, F.col("style"))
    content, long = F.when(F.col("ts") != 0.5, F.col("content")), F.length("content")
    return atoms(spark, sf_dir).select("episode", "ts", annotate.fault(style, content, F.when(long > 80, 1).otherwise(0), F.when(long > 60, "front").otherwise("")).alias("fault"))


@query(f"""WITH {ATOMS}, a AS (SELECT *, CASE WHEN length(content) > 90 THEN 'front' WHEN length(content) > 60 THEN 'wrist' END AS camera FROM atoms)
SELECT k AS camera, style, count(*) AS n, count(DISTINCT episode) AS episodes FROM a JOIN (VALUES ('front'), ('wrist'), ('top')) c(k) ON camera IS NULL OR camera = k GROUP BY ALL""")
def camera_atoms(spark, sf_dir):
    long = F.length("content")
    a = atoms(spark, sf_dir).withColumn("camera", F.when(long > 90, "front").when(long > 60, "wrist"))
    return annotate.seen_by(a, ["front", "wrist", "top"]).groupBy("camera", "style").agg(F.count("*").alias("n"), F.count_distinct("episode").alias("episodes"))


@query(f"""WITH {ATOMS} SELECT episode, ts, style, CASE WHEN NOT coalesce(length(content) > 60, FALSE) THEN 'auto' END AS origin FROM atoms""")
def edits_clear_origin(spark, sf_dir):
    a = atoms(spark, sf_dir).withColumn("origin", F.lit("auto"))
    return annotate.cleared(a, F.length("content") > 60).select("episode", "ts", "style", "origin")


@query(f"""WITH {ATOMS}, n AS (SELECT episode, count(*) AS n FROM atoms GROUP BY ALL),
l AS (SELECT episode, coalesce(list(ts || '|' || style || '|' || coalesce(content, '~') ORDER BY ts, style, content) FILTER (n <= 3 OR (n <= 5 AND style <> 'memory') OR (n <= 7 AND n > 5 AND ts < 1)), []) AS l,
  list(ts || '|' || style || '|' || coalesce(content, '~') ORDER BY ts, style, content) AS h, coalesce(list(ts || '|' || style || '|' || coalesce(content, '~') ORDER BY ts, style, content) FILTER (style <> 'memory'), []) AS m,
  list(ts || '|' || style || '|' || coalesce(content, '~') ORDER BY ts, style, content) FILTER (ts < 1 AND n <= 6) AS s FROM atoms JOIN n USING (episode) GROUP BY episode)
SELECT episode, l IS DISTINCT FROM h AND l IS DISTINCT FROM m AND coalesce(l <> s, TRUE) AS edited FROM l""")
def local_edits(spark, sf_dir):
    a = atoms(spark, sf_dir).select("episode", "ts", "style", F.coalesce("content", F.lit("~")).alias("content"))
    a = a.join(a.groupBy("episode").agg(F.count("*").alias("n")), "episode")
    cols = ["ts", "style", "content"]
    there = F.expr("n <= 3 or (n <= 5 and style <> 'memory') or (n <= 7 and n > 5 and ts < 1)")
    local = a.select("episode", *[F.when(there, F.col(c)).alias(c) for c in cols])
    return annotate.local_edits(local, a, a.filter("style <> 'memory'"), a.filter("ts < 1 and n <= 6"), "episode", cols)


@query("""WITH l AS (SELECT o_custkey AS e, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), f AS (SELECT o_custkey AS e, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey AS episode, CASE WHEN l.n IS NOT NULL THEN 'local' WHEN f.n IS NOT NULL THEN 'file' ELSE 'missing' END AS origin, coalesce(l.n, f.n, 0) AS atoms FROM customer LEFT JOIN l ON l.e = c_custkey LEFT JOIN f ON f.e = c_custkey WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'""")
def commit_entries(spark, sf_dir):
    report = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode"), (F.col("c_acctbal") > 0).alias("staged"), (F.col("c_mktsegment") == "BUILDING").alias("committed"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "episode")
    copies = lambda status: o.filter(F.col("o_orderstatus") == status).groupBy("episode").agg(F.count("*").alias("atoms"))
    return annotate.commit_entries(report, copies("O"), copies("F"), "episode").fillna(0, ["atoms"])


@query("""WITH c AS (SELECT c_custkey AS episode, CASE c_mktsegment WHEN 'BUILDING' THEN 'human' WHEN 'MACHINERY' THEN NULL ELSE 'auto' END AS source, c_mktsegment AS stage, c_nationkey::BIGINT AS score FROM customer WHERE c_acctbal > 0),
e AS (SELECT o_custkey AS episode, max(o_orderstatus) AS stage, count(*) AS score FROM orders GROUP BY ALL),
j AS (SELECT coalesce(c.episode, e.episode) AS episode, c.stage AS cs, c.score AS cn, c.source, e.stage AS es, e.score AS en, e.episode IS NOT NULL AND (c.episode IS NULL OR coalesce(source = 'auto', FALSE)) AS written FROM c FULL JOIN e ON c.episode = e.episode)
SELECT episode, CASE WHEN written THEN es ELSE cs END AS stage, CASE WHEN written THEN en ELSE cn END AS score, CASE WHEN written THEN 'auto' ELSE source END AS source, written FROM j""")
def review_merge(spark, sf_dir):
    source = F.when(F.col("c_mktsegment") == "BUILDING", "human").when(F.col("c_mktsegment") != "MACHINERY", "auto")
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("episode"), source.alias("source"), F.col("c_mktsegment").alias("stage"), F.col("c_nationkey").cast("long").alias("score"))
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode")).agg(F.max("o_orderstatus").alias("stage"), F.count("*").alias("score"))
    return annotate.reviewed(c, e, "episode", ["stage", "score"])


@query("""WITH x AS (SELECT p_partkey AS episode, 0::BIGINT AS "start", p_size::BIGINT AS "end", CASE WHEN p_size > 40 THEN 'adjusted' ELSE 'rule' END AS source, p_retailprice > 1200 AS reviewed FROM part WHERE p_size > 10),
p AS (SELECT l_partkey AS episode, 1::BIGINT AS "start", count(*) AS "end" FROM lineitem GROUP BY ALL), j AS (SELECT coalesce(x.episode, p.episode) AS episode, x.episode IS NOT NULL AND (p.episode IS NULL OR source = 'adjusted' OR reviewed) AS old, x."start" AS xs, x."end" AS xe, source, reviewed, p."start" AS ps, p."end" AS pe FROM x FULL JOIN p ON x.episode = p.episode)
SELECT episode, CASE WHEN old THEN xs ELSE ps END AS "start", CASE WHEN old THEN xe ELSE pe END AS "end", CASE WHEN old THEN source ELSE 'rule' END AS source, CASE WHEN old THEN reviewed ELSE FALSE END AS reviewed FROM j""")
def trim_decisions(spark, sf_dir):
    old = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("episode"), F.lit(0).cast("long").alias("start"), F.col("p_size").cast("long").alias("end"), F.when(F.col("p_size") > 40, "adjusted").otherwise("rule").alias("source"), (F.col("p_retailprice") > 1200).alias("reviewed"))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("episode")).agg(F.lit(1).cast("long").alias("start"), F.count("*").alias("end"))
    return trim.decided(old, new, "episode", overwrite=True)


@query(f"""WITH {SIGNAL}, c AS (SELECT episode, CASE WHEN max(x) > 100 THEN min(us) * 1000 END AS b, count(*) AS n FROM sig GROUP BY ALL),
d AS (SELECT episode, b + round_even(n / 0.0002::DOUBLE * 1e9::DOUBLE, 0)::BIGINT AS begin_ns, round_even(2 * n / 0.0002::DOUBLE * 1e9::DOUBLE, 0)::BIGINT AS span FROM c)
SELECT episode, i, begin_ns FROM sig JOIN d USING (episode) WHERE begin_ns IS NULL OR (us * 1000 >= begin_ns AND us * 1000 < begin_ns + span)""")
def sidecar_cut(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("ns", F.col("us") * 1000)
    cuts = s.groupBy("episode").agg(F.when(F.max("x") > 100, F.min("ns")).alias("begin_ns"), F.count("*").alias("start_frame"), (2 * F.count("*")).alias("kept_frames"))
    return trim.cut_sidecar(s, cuts, "episode", "ns", 0.0002).select("episode", "i", "begin_ns")


@query(f"""WITH {SIGNAL}, k AS (SELECT episode, row_number() OVER (ORDER BY episode) - 1 AS n FROM (SELECT DISTINCT episode FROM sig WHERE x > 100)) SELECT n AS episode, label, count(*) AS "rows" FROM sig JOIN k USING (episode) GROUP BY ALL""")
def curation_rekey(spark, sf_dir):
    s = signal(spark, sf_dir)
    new = trim.metadata(s.filter("x > 100"), "episode")
    return trim.rekeyed(s.groupBy("episode", "label").agg(F.count("*").alias("rows")), new, "episode", "episode_number")


@query("""SELECT c_nationkey::BIGINT AS episode, 0 AS part, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_nationkey, 1, s_name, NULL, s_acctbal::DOUBLE FROM supplier""")
def frames_together(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("episode"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("episode"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"))
    return trim.together([c, s], "episode", ["name"])


def _long(spark, sf_dir):
    """Each frame's four series as rows; the elbow has gaps."""
    f = frames(spark, sf_dir)
    series = [("action.gripper.pos", F.col("x")), ("observation.gripper.pos", F.when(F.col("d") > 0.02, F.col("d"))), ("shoulder.pos", F.col("q")), ("elbow.pos", F.when(F.col("x") > 0.01, F.col("p")))]
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("place"), x.alias("value")) for k, (name, x) in enumerate(series)])
    return f.select("episode", "i", F.explode(rows).alias("s")).select("episode", "i", "s.*")


@query(f"""WITH {FRAMES}, g AS (SELECT episode, i, d AS value, count(*) OVER (PARTITION BY episode) AS n FROM fr WHERE d > 0.02) SELECT episode, i, value FROM g WHERE n > 2""")
def gripper_series(spark, sf_dir):
    return shape.gripper_series(_long(spark, sf_dir), "episode", "i", "name", "place", "value")


@query(f"""WITH {FRAMES}, g AS (SELECT episode, i, [q, p] AS joints, count(*) OVER (PARTITION BY episode) AS n FROM fr WHERE x > 0.01) SELECT episode, i, joints FROM g WHERE n > 2""")
def arm_series(spark, sf_dir):
    return shape.arm_series(_long(spark, sf_dir), "episode", "i", "name", "place", "value")


@query("""WITH f AS (SELECT p_brand AS dataset, p_size AS size, CASE WHEN p_brand LIKE 'Brand#1%' THEN NULL ELSE p_size END AS tag FROM part), e AS (SELECT DISTINCT dataset, size AS episode FROM f)
SELECT dataset, episode::BIGINT AS episode, count(*) AS files FROM e JOIN f USING (dataset) WHERE tag IS NULL OR tag = episode GROUP BY ALL""")
def sidecar_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_size").cast("long").alias("episode"), F.col("p_partkey").cast("string").alias("k"))
    folder = F.when(F.col("dataset").startswith("Brand#1"), "raw/").otherwise(F.concat(F.lit("raw/episode_"), F.lpad(F.col("episode").cast("string"), 6, "0"), F.lit("/")))
    files = p.select("dataset", F.concat(folder, "k", F.lit(".csv")).alias("path"))
    return shape.episode_files(files, p.select("dataset", "episode").distinct(), "dataset", "episode", "path").groupBy("dataset", "episode").agg(F.count("*").alias("files"))


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS c, list_transform(embedding::DOUBLE[], lambda v: CASE WHEN embedding[1] > 0.1 THEN 0 WHEN v > 0 THEN v ELSE 0.5 * v END) AS r FROM embeddings),
z AS (SELECT label, c, r, c[3:len(c):3] AS cz, r[3:len(r):3] AS rz FROM e), s AS (SELECT *, list_sum(cz) - list_sum(rz) AS o FROM z)
SELECT label, count(*) AS frames, sum(len(list_filter(cz, lambda v: v < 0)))::BIGINT AS negative, count(*) FILTER (list_max(list_transform(r, lambda v: abs(v))) = 0 AND list_max(list_transform(c, lambda v: abs(v))) > 0) AS made, count(*) FILTER (o > 1e-9) AS above, round(greatest(max(o), 0), 6) AS worst FROM s GROUP BY ALL""")
def paradox_monitor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("c"))
    raw = F.transform("c", lambda v: F.when(F.col("c")[0] > F.lit(0.1), 0.0).when(v > 0, v).otherwise(0.5 * v))
    e = e.withColumn("r", raw)
    negative, made, above, worst = shape.block_faults(F.col("r"), F.col("c"))
    d = e.groupBy("label").agg(F.count("*").alias("frames"), F.sum(negative).alias("negative"), F.count_if(made).alias("made"), F.count_if(above).alias("above"), F.max(worst).alias("worst"))
    return rounded(d, "worst")


@query(f"""WITH {FRAMES} SELECT task, count(*) AS timed, round(avg(q), 6) AS load, round(avg(p), 6) AS raw, round(avg(d), 6) AS hub, round(avg(x), 6) AS annotate FROM fr WHERE d > 0 GROUP BY ALL""")
def timing_averages(spark, sf_dir):
    timed = F.when(F.col("d") > 0, F.struct(F.col("q").alias("load"), F.col("p").alias("raw"), F.col("d").alias("hub"), F.col("x").alias("annotate")))
    f = frames(spark, sf_dir).select("task", timed.alias("timing")).filter("timing is not null")
    names = ["load", "raw", "hub", "annotate"]
    return rounded(f.groupBy("task").agg(F.count("*").alias("timed"), *[F.avg(f"timing.{c}").alias(c) for c in names]), *names)


@query("""SELECT p_partkey AS episode, 'data/chunk-' || p_size || '/' || p_brand || '_' || p_partkey || '.parquet' AS path FROM part""")
def template_fill(spark, sf_dir):
    path = scalars.filled(F.lit("data/chunk-{chunk:03d}/{folder}_{episode:06d}.parquet"), chunk=F.col("p_size"), folder=F.col("p_brand"), episode=F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("episode"), path.alias("path"))


@query("""SELECT event_id, value FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 300""")
def background_sample(spark, sf_dir):
    """A seeded choice of 300 rows without replacement (the sample is the feature)."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return e.orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string"))), "event_id").limit(300)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, greatest(least(len(embedding), 40), len(embedding) - 40))) AS r FROM embeddings)
SELECT vec_id, r::INTEGER AS "row", CASE WHEN r < 40 THEN e[r + 1] END AS state, e[r + 41] AS action FROM e""")
def state_action_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return shape.paired_rows(e, ["vec_id"], "e", 40, ("state", "action"))


@query(f"""WITH {SIGNAL}, a AS (SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY i) - 1 AS k, x AS bought FROM sig WHERE label = 'purchase'), b AS (SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY i) - 1 AS k, x AS failed FROM sig WHERE label = 'error')
SELECT episode, k, coalesce(bought, -1) AS bought, coalesce(failed, -1) AS failed FROM a FULL JOIN b USING (episode, k)""")
def chart_groups_merged(spark, sf_dir):
    s = signal(spark, sf_dir)
    w = Window.partitionBy("episode").orderBy("i")
    one = lambda label, name: s.filter(F.col("label") == label).select("episode", (F.row_number().over(w) - 1).alias("k"), F.col("x").alias(name))
    return shape.by_position([one("purchase", "bought"), one("error", "failed")], ["episode"], "k").fillna(-1.0, ["bought", "failed"])


@query("""SELECT n_regionkey AS region, string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY ALL""")
def csv_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return shape.csv_text(n, [F.col("n_regionkey").alias("region")], "n_nationkey", ["n_nationkey", "n_name"])


@query("""WITH i AS (SELECT count(*) AS frames, count(DISTINCT l_partkey) AS episodes, count(DISTINCT l_suppkey) AS tasks, sum(l_quantity::DOUBLE) AS kb FROM lineitem)
SELECT frames, episodes, tasks, floor(kb / 1000 * 10 + 0.5) / 10 AS size_mb, CASE WHEN frames // 36000 > 0 THEN (frames // 36000) || 'h ' ELSE '' END || ((frames % 36000) // 600) || 'm' AS total_time FROM i""")
def dataset_info(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.agg(F.count("*").alias("frames"), F.count_distinct("l_partkey").alias("episodes"), F.count_distinct("l_suppkey").alias("tasks"), F.sum(F.col("l_quantity").cast("double")).alias("kb"))
    seconds = F.floor(F.col("frames") / 10)
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    told = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""), minutes.cast("string"), F.lit("m"))
    return d.select("frames", "episodes", "tasks", (F.floor(F.col("kb") / 1000 * 10 + 0.5) / 10).alias("size_mb"), told.alias("total_time"))
