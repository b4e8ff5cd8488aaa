"""Results and volumes that the review of larger tables asked about."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import exits, fingers, folds, hand, intervals, metric, screen, trajectory
from tracewright.operators import timeseries as ts
from tracewright.operators.tables import kept
from tracewright.plans import catalog_hand, catalog_stream
from tracewright.streaming import runner


def test_text_of_times_is_rounded_from_the_exact_value(spark):
    x = [k + h / 1000 for k in (0, 1, 7, 123, 2_591_999) for h in range(5, 1000, 10)] + [0.0, -0.125, -3.005, 1e15]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", scalars.fixed(F.col("x"), 2).alias("two"), scalars.fixed(F.col("x"), 1).alias("one")).collect()
    assert len(got) == len(x)
    assert [(r.two, r.one) for r in got] == [(f"{r.x:.2f}", f"{r.x:.1f}") for r in got]


def test_deviation_that_ends_in_a_half(spark):
    rows = [(0, i, v) for i, v in enumerate((76.14, 62.1, 59.99))] + [(1, i, v) for i, v in enumerate((7.56, 2.68, 21.18))] + [(2, i, v) for i, v in enumerate((1.0, None, 3.0, 5.0))]
    d = ts.relative_std(spark.createDataFrame(rows, "k long, i int, x double"), ["k"], ["i"], "x", 9, "r").withColumn("r", F.round("r", 6))
    got = {(r.k, r.i): r.r for r in d.collect()}
    assert (got[0, 2], got[1, 2], got[2, 3]) == (0.101563, 0.476563, 0.5)
    assert {got[k, i] for k in (0, 1, 2) for i in (0, 1)} | {got[2, 2]} == {float("inf")}


def test_rounding_ends_where_the_sql_ends(spark):
    import duckdb

    from tracewright.plans.catalog import rounded

    x = [0.2590625, 0.5203125, 0.13218749999999999, 0.21031249999999999, -0.2590625, 0.5, 2.5, 1e300, 1e305, 0.0, float("inf"), None] + [k / 2**7 / 10**4 for k in range(1, 2000, 2)]
    got = [r.y for r in rounded(spark.createDataFrame([(n, v, v) for n, v in enumerate(x)], "n int, x double, y double"), "y").orderBy("n").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in x]
    # two rows whose deviation over the mean is 0.2590625
    rows = [(0, 0, 125.90625), (0, 1, 74.09375), (0, 2, 1.0)]
    d = ts.relative_std(spark.createDataFrame(rows, "k long, i int, x double"), ["k"], ["i"], "x", 9, "r").filter("i = 2")
    assert d.first().r == 0.2590625 and rounded(d, "r").first().r == 0.259062


def test_moments_of_a_regular_array_are_rounded_as_in_the_sql(spark):
    rng, rows, want = np.random.default_rng(6), [], {}
    for n in range(300):
        fx, fy, fz = np.round(rng.normal(0.3, 1, (3, 4)), 2).tolist()
        at = [(-3.0, -2.0), (3.0, -2.0), (-3.0, 2.0), (3.0, 2.0)]
        rows.append((n, [(*p, a, b, c) for p, a, b, c in zip(at, fx, fy, fz, strict=True)]))
        p = [max(z, 0.0) for z in fz]
        m, sfx, sfy = p[0] + p[1] + p[2] + p[3], fx[0] + fx[1] + fx[2] + fx[3], fy[0] + fy[1] + fy[2] + fy[3]
        if m > 0.2:
            cx, cy = 3 * (p[1] + p[3] - p[0] - p[2]) / m, 2 * (p[2] + p[3] - p[0] - p[1]) / m
            spin = 3 * (fy[1] + fy[3] - fy[0] - fy[2]) - 2 * (fx[2] + fx[3] - fx[0] - fx[1])
            want[n] = (cx, cy, spin - cx * sfy + cy * sfx, (sfx * sfx + sfy * sfy) ** 0.5)
    d = spark.createDataFrame(rows, "n int, taxels array<struct<x:double,y:double,fx:double,fy:double,fz:double>>")
    got = {r.n: (r.copx, r.copy, r.tau, r.fs) for r in exits.taxel_channels(d, "taxels").filter("copx is not null").collect()}
    assert got == want and len(got) > 100


def test_means_of_an_exit_are_summed_in_order(spark):
    """Values whose sum depends on its order, from shuffled rows."""
    values = [1e16, 1.0, -1e16, 3.0, 0.1, 1e16, 0.7, -1e16] * 5
    zero = {c: F.lit(0.0).alias(c) for c in exits.CHANNELS}
    s = spark.createDataFrame([(0, 0, n, n / 20 if n < 40 else 3.0, v) for n, v in enumerate([*values, 0.0])], "k int, finger int, i int, t double, fn double")
    s = s.select("k", "finger", "i", "t", *[F.col("fn") if c == "fn" else zero[c] for c in exits.CHANNELS])
    e = spark.createDataFrame([(0, 0, 2.4)], "k int, finger int, t double")
    reach = exits.Reach(pre=2.4, near=0.4)
    held = [v for n, v in enumerate(values) if n / 20 <= 2.4 - 0.4]
    total = 0.0
    for v in held:
        total += v
    for seed in range(3):
        got = exits.exit_features(s.orderBy(F.xxhash64(F.lit(seed), "i")), e, ["k"], "i", reach).first()
        assert got.fn_hold_N == total / len(held)


def test_blocks_of_neighbours_are_exact(monkeypatch):
    monkeypatch.setattr(metric, "TILE_QUERIES", 16)
    monkeypatch.setattr(metric, "TILE_ROWS", 32)
    monkeypatch.setattr(metric, "MOST_PAIRS", 64)
    rng = np.random.default_rng(3)
    for far in (0.0, 1e7):  # far from the origin the products alone would not tell the distances
        x = np.round(rng.normal(size=(300, 6)), 1) + far
        x[:90] = x[:3].repeat(30, 0)
        grp, rank = np.arange(300) % 5, rng.permutation(300)
        for k in (1, 7, 280):
            i, j, d = metric.compared(x[::9], grp[::9], x, grp, rank, k)
            for n, q in enumerate(range(0, 300, 9)):
                gap = np.sqrt(((x - x[q]) ** 2).sum(1))
                other = np.flatnonzero(grp != grp[q])
                want = other[np.lexsort((rank[other], gap[other]))][:k]
                assert j[i == n].tolist() == want.tolist()
                assert (d[i == n] == gap[want]).all()


def test_neighbours_of_few_rows_and_what_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(metric, "LEAST", 1)
    rows = spark.createDataFrame([(n, [float(n), 0.0], str(n % 3), "a") for n in range(5)], "id long, v array<double>, g string, label string")
    got = metric.nearest(metric.build(rows, "id", "v", "g", "label"), rows.limit(2), 2, "id", "v", "g").collect()
    assert sorted((r.query, r["rank"], r.id) for r in got) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2)]
    # a query goes to each block of rows once, not to each ring of each cell
    monkeypatch.setattr(metric, "LEAST", 500)
    many = spark.range(2000).select("id", F.array(*[F.rand(k) for k in range(8)]).alias("v"), F.lit(None).cast("string").alias("g"), F.lit("a").alias("label"))
    index = metric.build(many, "id", "v", "g", "label", block_rows=16)
    plan = metric.nearest(index, many, 3, "id", "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "ring" not in plan.split("RepartitionByExpression")[1]


def test_queries_meet_only_boxes_that_may_hold_a_neighbour(spark, monkeypatch):
    monkeypatch.setattr(metric, "LEAST", 40)
    monkeypatch.setattr(metric, "AXES", 3)
    tables = {}
    monkeypatch.setattr(metric, "kept", lambda df, name: tables.setdefault(name, kept(df, name)))
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(size=(120, 5)) + 1000 * c for c in range(4)] + [np.full((60, 5), 7000.0)]), 1)
    rows = spark.createDataFrame([(n, v.tolist(), str(n % 6), f"l{n % 3}") for n, v in enumerate(x)], "id long, v array<double>, g string, label string")
    got = {}
    for r in metric.nearest(metric.build(rows, "id", "v", "g", "label"), rows, 5, "id", "v", "g").orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.distance, r.label))
    for n, q in enumerate(x):
        d = np.sqrt(((x - q) ** 2).sum(1))
        other = np.flatnonzero(np.arange(len(x)) % 6 != n % 6)
        want = other[np.lexsort((other, d[other]))][:5]
        assert got[n] == [(i, d[i], f"l{i % 3}") for i in want]
    assert tables["boxed"].select("box").distinct().count() > 4
    # a known k-th distance leaves out all beyond it, and nothing within it
    i, j, d = metric.compared(x[:9], np.arange(9) % 6, x, np.arange(len(x)) % 6, np.arange(len(x)), 5, np.full(9, 1.5))
    assert len(d) and (d <= 1.5 * (1 + metric.SLACK)).all()
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(n, m) for n in range(9) for m, far, _ in got[n] if far <= 1.5}


def test_blocks_are_met_in_jobs_of_bounded_size(spark, monkeypatch):
    """More copies than one job may shuffle: neighbours as before, and tables that nothing reads are gone."""
    import os

    monkeypatch.setattr(metric, "LEAST", 40)
    monkeypatch.setattr(metric, "COPIES", 100, raising=False)
    made = []
    monkeypatch.setattr(metric, "kept", lambda df, name: made.append((name, kept(df, name))) or made[-1][1])
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(size=(500, 4)), 1)
    rows = spark.createDataFrame([(n, v.tolist(), str(n % 6), f"l{n % 3}") for n, v in enumerate(x)], "id long, v array<double>, g string, label string")
    got = {}
    for r in screen.nearest(rows, rows, 5, "id", "v", "g", "label").orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.distance))
    for n, q in enumerate(x):
        d = np.sqrt(((x - q) ** 2).sum(1))
        other = np.flatnonzero(np.arange(len(x)) % 6 != n % 6)
        assert got[n] == [(i, d[i]) for i in other[np.lexsort((other, d[other]))][:5]]
    there = {name: os.path.exists(t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) if name not in ("cells", "asked") else os.path.exists(t._kept.removeprefix("file:")) for name, t in made}
    assert [name for name, _ in made].count("met") > 2
    assert there == {"cells": False, "boxed": True, "asked": False, "home": True, "visits": True, "met": True}


def test_points_in_spans_are_shuffled_once(spark):
    points = [(k, f, t / 2) for k in (0, 1, None) for f in (0, 1, None) for t in (-5, 0, 1, 4, 9, 20, 41)] + [(0, 0, 0.5), (0, 1, None)]
    spans = [(0, None, 0.0, 0.5), (0, 0, 2.0, 30.0), (0, 0, 4.0, 4.5), (0, 1, 10.0, 9.0), (1, 1, -9.0, -2.5), (1, None, None, 9.0), (1, 0, 20.5, 20.5), (None, None, -9.0, 99.0)]
    p = spark.createDataFrame(points, "k int, finger int, t double")
    s = spark.createDataFrame(spans, "k int, finger int, a double, b double")
    d = intervals.stabbed(p, s, ["k"], "t", "a", "b", 1.0, "inside", wild="finger")
    held = lambda k, f, t: any(t is not None and k is not None and k == c and w in (None, f) and a is not None and a <= t <= b for c, w, a, b in spans)
    assert sorted(map(repr, ((r.k, r.finger, r.t, r.inside) for r in d.collect()))) == sorted(repr((*q, held(*q))) for q in points)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_tasks_of_the_finger_passes_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fingers, "TASK_ROWS", 50, raising=False)
    zero = F.lit(0.0)
    rows = spark.range(2000).select((F.col("id") % 40).alias("k"), (F.col("id") % 2).alias("finger"), F.col("id").alias("i"), F.col("id").cast("double").alias("t"), *[zero.alias(c) for c in ("fn", "fs", "hf", "div", "edge", "tau", "gv")])
    plan = fingers.finger_events(rows, "k")._jdf.queryExecution().executedPlan().toString()
    assert ", 40), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1


def test_neighbours_of_several_k_measure_few_pairs_once(monkeypatch):
    rng = np.random.default_rng(5)
    for far in (0.0, 1e6, 1e200):  # where squares overflow every pair is measured
        train = np.round(rng.normal(size=(500, 6)), 1) * max(far, 1.0) + far
        train[:60] = train[:3].repeat(20, 0)
        y, x = rng.integers(0, 2, 500).astype(float), np.concatenate([train[::9], np.round(rng.normal(size=(260, 6)), 1) + far])
        with np.errstate(all="ignore"):
            got = folds.neighbours(train, y, x, (5, 7, 900))
            for k, share in zip((5, 7, 500), got, strict=True):
                for n, q in enumerate(x):
                    d = np.sqrt(((q - train) ** 2).sum(1))
                    at = np.argsort(d, kind="stable")[:k]
                    w = (d[at] == 0).astype(float) if (d[at] == 0).any() else 1 / d[at]
                    assert np.isclose(share[n], (w * y[at]).sum() / w.sum(), equal_nan=True)


def test_models_learn_from_every_row(spark, monkeypatch):
    """2,600 labelled rows, more than the sample that models once came from, in several blocks and jobs."""
    monkeypatch.setattr(folds, "MET_ROWS", 700, raising=False)
    monkeypatch.setattr(folds, "COPIES", 6000, raising=False)
    rng = np.random.default_rng(12)
    x, y, fold = rng.normal(size=(2600, 3)), rng.integers(0, 2, 2600).astype(float), np.arange(2600) % 2
    x[:, 1:][rng.random((2600, 2)) < 0.1] = np.nan
    x[:1300, 2] = 7.25  # the median is a value that many rows share
    rows = [(n, int(f), float(t), *(None if np.isnan(v) else float(v) for v in r)) for n, (f, t, r) in enumerate(zip(fold, y, x, strict=True))]
    d = spark.createDataFrame(rows, "id long, fold long, y double, a double, b double, c double").repartition(3)
    got = folds.out_of_fold(d, "abc", "y", "fold", ["id"], ks=(5,), block=500).toPandas().sort_values("id")
    for f in (0, 1):
        tr = fold != f
        full = np.where(np.isnan(x), np.nanmedian(x[tr], 0), x)
        z = (full - full[tr].mean(0)) / full[tr].std(0)
        for q in np.flatnonzero(~tr)[::7]:
            gap = np.sqrt(((z[tr] - z[q]) ** 2).sum(1))
            at = np.argsort(gap)[:5]
            assert np.isclose(got["knn5"].iloc[q], np.average(y[tr][at], weights=1 / gap[at]))
        net = folds.network(z[tr], y[tr])
        assert np.allclose(got["mlp"].to_numpy()[~tr], folds._logistic(folds._forward(net, z[~tr])[-1][:, 0]), atol=1e-6)


def test_scores_are_ranked_from_kept_counts(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    scored = spark.createDataFrame([(float(n % 2), n / 40) for n in range(40)], "target double, a double").repartition(2).mapInPandas(count, "target double, a double")
    got = folds.model_scores(scored, "target", ["a"]).collect()
    assert [r["rows"] for r in got] == [40] and seen.value == 40


def test_slips_of_equal_values_have_no_correlation(spark):
    """All ranks tied: under ANSI rules a correlation divides by zero there."""
    from tracewright.operators import stats

    rows = [(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 5.0), (3, 1.0, 4.0), (3, 2.0, 6.0), (3, 3.0, 5.0), (4, 1.0, 2.0), (4, 1.0, 3.0)]
    got = {r.k: (r.n, r.rho) for r in stats.spearman(spark.createDataFrame(rows, "k int, t double, x double"), ["k"], "x", "t").collect()}
    assert got == {1: (2, None), 2: (1, None), 3: (3, 0.5), 4: (2, None)}
    rng = np.random.default_rng(15)
    data = [(n % 6, n / 7, *([3.0] * 3 if n % 6 == 0 else rng.normal(size=3).tolist()), rng.normal(size=4).tolist()) for n in range(48)]
    slips = spark.createDataFrame(data, "ep int, t double, grip double, cop_y double, dcop double, v array<double>")
    anchors = spark.createDataFrame([(n, 3.0) for n in range(6)], "ep int, at double")
    got = trajectory.slip_trajectory(slips, anchors, ["ep"], "t", "v", "at")
    rhos = {r.ep: (r.grip_rho, r.cop_rho, r.pc1_rho) for r in got.collect()}
    assert len(rhos) == 6 and rhos[0][:2] == (None, None) and None not in rhos[0][2:] + rhos[1] + rhos[5]
    # no side of a join goes to the driver, however small it is here
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_slips_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    kind = "ep int, t double, grip double, cop_y double, dcop double, v array<double>"
    rng = np.random.default_rng(8)
    rows = [(n % 60, n / 7, *rng.normal(size=3).tolist(), rng.normal(size=4).tolist()) for n in range(480)]
    slips = spark.createDataFrame(rows, kind).repartition(2).mapInPandas(count, kind)
    anchors = spark.createDataFrame([(n, 30.0) for n in range(60)], "ep int, at double")
    assert len(trajectory.slip_trajectory(slips, anchors, ["ep"], "t", "v", "at").collect()) == 60
    assert seen.value == 480


def test_episodes_of_one_block_share_a_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(n % 60, n / 7, *rng.normal(size=2).tolist()) for n in range(480)]
    dealt = []
    monkeypatch.setattr(trajectory, "kept", lambda df, name: dealt.append((name, df)) or kept(df, name))
    points = spark.createDataFrame(rows, "ep int, t double, grip double, dcop double").withColumn("p", F.col("t") > 30)
    assert trajectory.phase_silhouette(points, ["ep"], "p", ["grip", "dcop"], block=2048).count() == 60
    last = dict(dealt)["phase-dealt"]
    assert last.select("_g").distinct().count() == 1


def test_levels_of_blocks_follow_the_times(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(k), float(t), float(x)) for k, t, x in zip(rng.integers(0, 3, 200), np.round(rng.uniform(-40, 90, 200), 1), rng.normal(size=200), strict=True)]
    asked = [(int(k), float(a), float(a + d)) for k, a, d in zip(rng.integers(0, 4, 150), np.round(rng.uniform(-120, 120, 150), 1), rng.choice([0.0, 3.7, 30.0, 1e6, 1e17, -1.0], 150), strict=True)]
    made = []
    blocks = intervals.block_extremes
    monkeypatch.setattr(intervals, "block_extremes", lambda *a: made.append(blocks(*a)) or made[-1])
    q, d = spark.createDataFrame(asked, "k int, a double, b double"), spark.createDataFrame(rows, "k int, t double, x double")
    got = intervals.extremes(q, d, ["k"], "a", "b", "t", "x", 4.0).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [x for k, t, x in rows if k == r.k and r.a <= t <= r.b]
        assert (r.least, r.greatest, r["rows"]) == (min(own, default=None), max(own, default=None), len(own))
    # 33 blocks of 4: six levels above the first, not sixteen
    assert made[0].agg(F.max("level")).first()[0] == 6
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert intervals.extremes(q, d.limit(0), ["k"], "a", "b", "t", "x", 4.0).filter("least is null and rows = 0").count() == len(asked)


def test_a_fold_turns_only_what_it_reads_into_rows(spark):
    rows = [(k, n, float(n), f"{k}-{n}") for k in (0, 1) for n in range(5)]
    d = spark.createDataFrame(rows, "k int, n int, x double, more string")

    def step(state, row):
        assert set(row) == {"k", "x"}
        state["sum"] += row["x"]
        return state["sum"] > 3

    got = hand.folded(d, ["k"], ["n"], lambda: {"sum": 0.0}, step, "far", "boolean", ["x"]).collect()
    assert {(r.k, r.n, r.x, r.more): r.far for r in got} == {r: sum(range(r[1] + 1)) > 3 for r in rows}


def test_the_latch_runs_no_batch_without_data(spark, tmp_path, monkeypatch):
    """Rows longer apart than the watermark's delay of 400 days, some of which wait for the closing rows."""
    day = 86_400
    rows = [(n, t, k, v) for k in (1, 2) for n, (t, v) in enumerate([(0, 50.0), (7200, 50.0), (9000, 5.0), (day, 5.0), (500 * day, 60.0), (500 * day + 9000, 60.0), (900 * day, 1.0), (901 * day, 1.0)])]
    table = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(s + 1700000000)::timestamp_ntz AS ts", "user_id", "value")
    parts = [table.filter(f"event_id between {a} and {a + 1}") for a in (0, 2, 4, 6)]
    for n, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"events.parquet/part={n}"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet/*"))
    roots = []
    monkeypatch.setattr(runner.uuid, "uuid4", lambda make=runner.uuid.uuid4: roots.append(make()) or roots[-1])
    before = spark.conf.get(runner.IDLE)
    got = catalog_stream.latch_of(stream, table).collect()
    assert spark.conf.get(runner.IDLE) == before
    zero = 1_700_000_000
    want = {("onset", 0, 7200), ("terminal", 9000, day), ("onset", 500 * day, 500 * day + 9000), ("terminal", 900 * day, 901 * day)}
    assert sorted((r.episode, r.kind, r.start / 1e6 - zero, r.fired / 1e6 - zero) for r in got) == sorted((k, *w) for k in (1, 2) for w in want)
    from pathlib import Path

    batches = Path(runner.shared_dir(spark).removeprefix("file:")).glob(f"stream-{roots[0].hex}/batch=*")
    assert len({b.name for b in batches}) == 5  # four files and the closing rows


def test_the_signal_is_ordered_once_for_events_and_once_for_times(spark, sf, monkeypatch):
    read, signal = [], catalog_hand.signal
    monkeypatch.setattr(catalog_hand, "signal", lambda *a: read.append(a) or signal(*a))
    assert catalog_hand.failure_override(spark, sf).count() > 0
    assert len(read) == 2


def test_vectors_of_a_search_are_not_broadcast(spark):
    """What is small as compressed would be, and its size in the driver follows the table."""
    from tracewright.llm import kmeans_tree

    rng = np.random.default_rng(13)
    d = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rng.normal(size=(900, 8)))], "vec_id long, embedding array<double>")
    got = kmeans_tree.neighbours(kmeans_tree.build(d, k=3), d.filter("vec_id % 100 = 0"))
    assert got.count() == 27
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 2
    assert plan.count("BroadcastHashJoin") == 2  # the numbers of blocks of each leaf, of queries and of rows
