"""Registered queries: exits read from atoms, their signatures, and models that tell losses from releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exits, folds
from .catalog import K, O, query, rounded
from .views import SIGNAL, signal

#: One "second" of an exit's window in the clock of ``events``, and the folds of the models.
UNIT, FOLDS = 864_000.0, 16
REACH = exits.Reach().times(UNIT)
R = REACH

# Roles: every second row of an episode is a finger's; four taxels press in turn by the jaw (over 3.7, so that means of
# two-digit values do not end in a half); atoms and flags come from the rows.
TOUCH = f"""{SIGNAL}, tx AS (SELECT *, i % 2 AS finger, list_transform([0, 1, 2, 3], lambda k: x * ((jaw + 7 * k) % 5 - 1) / 3.7::DOUBLE) AS fz FROM sig),
ty AS (SELECT *, list_transform([1, 2, 3, 4], lambda k: fz[k] * (jaw - 50) / 100) AS fx, list_transform([1, 2, 3, 4], lambda k: x * ((jaw * k) % 7 - 3) / 100) AS fy, list_transform(fz, lambda z: CASE WHEN z > 0 THEN z ELSE 0 END) AS pz FROM tx),
tz AS (SELECT episode, i, finger, t, list_sum(fz) AS fn, list_sum(fx) AS sfx, list_sum(fy) AS sfy, len(list_filter(fz, lambda z: z > 0))::DOUBLE AS active, list_sum(pz) AS m,
  3 * (pz[2] + pz[4] - pz[1] - pz[3]) AS mx, 2 * (pz[3] + pz[4] - pz[1] - pz[2]) AS my, 3 * (fy[2] + fy[4] - fy[1] - fy[3]) - 2 * (fx[3] + fx[4] - fx[1] - fx[2]) AS spin FROM ty),
cp AS (SELECT *, sqrt(sfx * sfx + sfy * sfy) AS fs, CASE WHEN m > 0.2 THEN mx / m END AS copx, CASE WHEN m > 0.2 THEN my / m END AS copy FROM tz),
ch AS (SELECT *, CASE WHEN m > 0.2 THEN spin - copx * sfy + copy * sfx ELSE 0 END AS tau, CASE WHEN fn > 0.3 THEN fs / fn END AS mu FROM cp),
g0 AS (SELECT *, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, fs - lag(fs) OVER w AS d0, lead(fs) OVER w - fs AS d1 FROM ch WINDOW w AS (PARTITION BY episode, finger ORDER BY i)),
g1 AS (SELECT *, CASE WHEN h0 IS NULL THEN d1 / h1 WHEN h1 IS NULL THEN d0 / h0 ELSE (h0 * (d1 / h1) + h1 * (d0 / h0)) / (h0 + h1) END AS g FROM g0),
s AS (SELECT *, sqrt(sum(g * g) OVER (PARTITION BY episode, finger ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10) AS hf FROM g1)"""

LABELS = {"error": "drop", "purchase": "release", "click": "finger_unload", "signup": "slip"}
ATOMS_OF = f"""ao AS (SELECT episode, t, CASE WHEN label = 'view' THEN 'vqa' ELSE 'interjection' END AS style, '[auto:' || CASE WHEN jaw < 50 THEN 'low' ELSE 'high' END || '] ' || CASE label {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in LABELS.items())} ELSE 'note' END || ' f' || (i % 2)
  || CASE WHEN jaw < 30 THEN '' ELSE ' 0.50s (jaw' || CASE WHEN jaw < 60 THEN '-' ELSE '+' END || jaw::INT || '.5u)' END AS content FROM sig WHERE x > 20),
wk AS (SELECT episode, floor(t) AS a, floor(t) + 7200 AS b FROM sig WHERE label = 'view' AND x > 60),
ex AS (SELECT a.*, regexp_extract(content, '\\] (\\w+) f', 1) AS label, regexp_extract(content, ' f(\\d)', 1)::INT AS finger, regexp_extract(content, 'auto:(\\w+)', 1) AS conf, nullif(regexp_extract(content, 'jaw([+-][\\d.]+)u', 1), '')::DOUBLE AS jaw FROM ao a WHERE style = 'interjection'
  AND NOT EXISTS (SELECT 1 FROM wk WHERE wk.episode = a.episode AND a.t BETWEEN wk.a - 600 AND wk.b + 600)),
ec AS (SELECT episode, finger, t, label, conf, jaw, CASE label WHEN 'drop' THEN 'loss' WHEN 'release' THEN 'deliberate' ELSE 'unload' END AS class FROM ex WHERE label IN ('drop', 'release', 'finger_unload'))"""


def _exits(spark, sf_dir):
    s = signal(spark, sf_dir)
    label = F.coalesce(*[F.when(F.col("label") == a, F.lit(b)) for a, b in LABELS.items()], F.lit("note"))
    jaw = F.when(F.col("jaw") < 30, "").otherwise(F.concat(F.lit(" 0.50s (jaw"), F.when(F.col("jaw") < 60, "-").otherwise("+"), F.col("jaw").cast("int").cast("string"), F.lit(".5u)")))
    content = F.concat(F.lit("[auto:"), F.when(F.col("jaw") < 50, "low").otherwise("high"), F.lit("] "), label, F.lit(" f"), (F.col("i") % 2).cast("string"), jaw)
    atoms = s.filter("x > 20").select("episode", "t", F.when(F.col("label") == "view", "vqa").otherwise("interjection").alias("style"), content.alias("content"))
    a = F.floor("t").cast("long")
    flags = s.filter("label = 'view' and x > 60").select("episode", F.concat(F.lit("no_arm weak_contact@"), a.cast("string"), F.lit("-"), (a + 7200).cast("string"), F.lit("s")).alias("flag"))
    return exits.exit_atoms(atoms, flags, K, "t", "content", "style", "flag", margin=600.0, width=7200.0)


def _samples(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("finger", (F.col("i") % 2).cast("int"))
    places = [(-3.0, -2.0), (3.0, -2.0), (-3.0, 2.0), (3.0, 2.0)]
    taxels = []
    for k, (x, y) in enumerate(places):
        fz = F.col("x") * ((F.col("jaw") + 7 * k) % 5 - 1) / 3.7
        taxels.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), (fz * (F.col("jaw") - 50) / 100).alias("fx"), (F.col("x") * ((F.col("jaw") * (k + 1)) % 7 - 3) / 100).alias("fy"), fz.alias("fz")))
    s = exits.taxel_channels(s.withColumn("taxels", F.array(*taxels)), "taxels")
    return exits.roughness(s, [*K, "finger"], O, "t")


def _features(spark, sf_dir):
    return exits.exit_features(_samples(spark, sf_dir), _exits(spark, sf_dir), K, "i", REACH)


@query(f"WITH {SIGNAL}, {ATOMS_OF} SELECT episode, finger, round(t, 6) AS t, label, conf, jaw, class FROM ec")
def exit_atoms(spark, sf_dir):
    return rounded(_exits(spark, sf_dir), "t")


@query(f"""WITH {TOUCH} SELECT episode, i, {', '.join(f'round({c}, 6) AS {c}' for c in exits.CHANNELS)} FROM s""")
def taxel_channels(spark, sf_dir):
    return rounded(_samples(spark, sf_dir).select("episode", "i", *exits.CHANNELS), *exits.CHANNELS)


HOLD, NEAR = f"s.t BETWEEN e.t - {R.pre} AND e.t - {R.near}", f"s.t BETWEEN e.t - {R.near} AND e.t - {R.near_end}"
LAST, POST = f"s.t BETWEEN e.t - {R.last} AND e.t - {R.last_end}", f"s.t BETWEEN e.t + {R.near_end} AND e.t + {R.post}"


def _slope(x: str, where: str) -> str:
    return f"CASE WHEN count({x}) FILTER ({where}) >= 4 THEN regr_slope({x}, dt) FILTER ({where}) END"


def _travel(x: str) -> str:
    return f"CASE WHEN count({x}) FILTER (own AND near) > 3 THEN arg_max({x}, i) FILTER (own AND near AND {x} IS NOT NULL) - arg_min({x}, i) FILTER (own AND near AND {x} IS NOT NULL) END"


def _heading(part: str) -> str:
    x, y = f"avg(sfx) FILTER (own AND {part})", f"avg(sfy) FILTER (own AND {part})"
    return f"CASE WHEN sqrt(({x}) ** 2 + ({y}) ** 2) > 0.05 THEN degrees(atan2({y}, {x})) END"


FEATURES = f"""{TOUCH}, {ATOMS_OF}, en AS (SELECT episode, finger, min(t) AS t0, max(t) AS t1 FROM s GROUP BY ALL),
asked AS (SELECT DISTINCT ec.* FROM ec JOIN en USING (episode, finger) WHERE t - {R.pre} >= t0 AND t + {R.post} <= t1),
pr AS (SELECT e.episode, e.finger, e.t, e.label, e.conf, e.jaw, e.class, s.finger = e.finger AS own, s.t AS st, s.t - e.t AS dt, s.i, {HOLD} AS hold, {NEAR} AS near, {LAST} AS last, {POST} AS post, fn, fs, sfx, sfy, active, copx, copy, tau, mu, hf
  FROM asked e JOIN s ON s.episode = e.episode AND s.t BETWEEN e.t - {R.pre} AND e.t + {R.post}),
lv AS (SELECT *, avg(fn) FILTER (own AND hold) OVER w AS lvl FROM pr WINDOW w AS (PARTITION BY episode, finger, t, label, conf, jaw)),
l8 AS (SELECT *, min(st) FILTER (own AND st > t - {R.fall} AND fn <= 0.8::DOUBLE * lvl) OVER w AS t80 FROM lv WINDOW w AS (PARTITION BY episode, finger, t, label, conf, jaw)),
ft AS (SELECT episode, finger, t, label, conf, jaw, class, any_value(lvl) AS fn_hold_N, avg(fn) FILTER (own AND near) AS fn_near_N, avg(fn) FILTER (own AND last) AS fn_last_N,
  CASE WHEN any_value(lvl) > 0 THEN avg(fn) FILTER (own AND near) / any_value(lvl) END AS fn_near_ratio, CASE WHEN any_value(lvl) > 0 THEN ({_slope('fn', 'own AND near')}) / any_value(lvl) END AS fn_slope_near_rel,
  min(st) FILTER (own AND st >= t80 AND fn <= 0.2::DOUBLE * lvl) - any_value(t80) AS unload_80to20_s, avg(fn) FILTER (own AND post) AS fn_post_N,
  avg(active) FILTER (own AND hold) AS active_hold, avg(active) FILTER (own AND last) AS active_last, {_slope('active', 'own AND near')} AS active_slope_near,
  {_travel('copy')} AS copy_travel_near_mm, {_travel('copx')} AS copx_travel_near_mm, {_slope('copy', 'own AND near')} AS cop_speed_near_mm_s, avg(copy) FILTER (own AND hold) AS copy_hold_mm,
  avg(fs) FILTER (own AND hold) AS fs_hold_N, avg(fs) FILTER (own AND near) AS fs_near_N, avg(mu) FILTER (own AND hold) AS mu_hold, avg(mu) FILTER (own AND near) AS mu_near, max(mu) FILTER (own AND near) AS mu_max_near, {_slope('mu', 'own AND near')} AS mu_slope_near,
  ({_heading('hold')}) - ({_heading('last')}) AS swing, max(abs(tau)) FILTER (own AND near) AS tau_max_near, avg(abs(tau)) FILTER (own AND hold) AS tau_hold, max(hf) FILTER (own AND near) AS hf_max_near, avg(hf) FILTER (own AND hold) AS hf_hold,
  avg(fn) FILTER (NOT own AND near) AS partner_fn_near_N, avg(fn) FILTER (NOT own AND post) AS partner_fn_post_N, CASE WHEN avg(fn) FILTER (NOT own AND hold) > 0.3 THEN ({_slope('fn', 'NOT own AND near')}) / avg(fn) FILTER (NOT own AND hold) END AS partner_slope_near_rel, avg(mu) FILTER (NOT own AND near) AS partner_mu_near FROM l8 GROUP BY episode, finger, t, label, conf, jaw, class)"""
#: Slopes are per second of the clock, so they are reported by the window's unit.
SLOPES = ("fn_slope_near_rel", "active_slope_near", "cop_speed_near_mm_s", "mu_slope_near", "partner_slope_near_rel", "hf_max_near", "hf_hold")
SHOWN = ", ".join(f"round({'abs(((swing + 180) % 360 + 360) % 360 - 180)' if f == 'shear_swing_deg' else f'{f} * {UNIT}' if f in SLOPES else f}, 5) AS {f}" for f in exits.EXIT_FEATURES)


@query(f"WITH {FEATURES} SELECT episode, finger, round(t, 6) AS t, class, {SHOWN} FROM ft")
def exit_signatures(spark, sf_dir):
    shown = [(F.col(f) * UNIT if f in SLOPES else F.col(f)).alias(f) for f in exits.EXIT_FEATURES]
    d = _features(spark, sf_dir).select("episode", "finger", "t", "class", *shown)
    return rounded(rounded(d, "t"), *exits.EXIT_FEATURES, digits=5)


def _predictions(spark, sf_dir):
    """Losses against deliberate exits, episodes dealt to folds; unloads are left out."""
    rows = _features(spark, sf_dir).filter("class in ('loss', 'deliberate')")
    rows = rows.withColumns({"target": (F.col("class") == "loss").cast("double"), "fold": F.col("episode") % FOLDS})
    return folds.out_of_fold(rows, exits.EXIT_FEATURES, "target", "fold", ["episode", "finger", "t", "label", "conf"])


@query()
def exit_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir)


@query()
def exit_model_scores(spark, sf_dir):
    return folds.model_scores(_predictions(spark, sf_dir), "target", ["knn5", "knn7", "knn11", "mlp"])
