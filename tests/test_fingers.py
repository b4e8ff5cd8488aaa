"""The passes of a finger against one plain loop, and the whole detector on a known episode."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import fingers, hand

R = fingers.Finger(stable_rows=4, place_rows=4, place_hold_rows=6)
SAMPLE = "episode long, finger int, i int, t double, fn double, fs double, hf double, div double, edge double, tau double, gv double"


def finger(rng, key, f, n=160):
    rows, fn = [], 0.0
    hf, tau, div, gv = 0.0, 0.0, 0.0, 0.0
    for i in range(n):
        if rng.random() < 0.12:
            fn = rng.choice([0.0, 0.0, 0.12, 0.2, 1.0, 4.0])
        if rng.random() < 0.2:
            hf, tau, div, gv = rng.choice([0.0, 3.0, 10.0, 30.0]), rng.choice([0.0, 10.0, -40.0]), rng.choice([0.0, 0.1, 0.6]), rng.choice([0.0, 0.0, 3.0])
        ramp = fn + 0.02 * (i % 7) * (fn > 0.5) * rng.choice([0, 0, 5])
        rows.append((key, f, i, round(i * 0.05, 3), round(ramp, 3), round(rng.uniform(0, 2), 3), hf, div, rng.choice([1.0, 5.0, 5.0]), tau, gv))
    return rows


def plain(rows, r):
    """Row by row, as a recorder would see it."""
    out, held, since, start, began = [], False, None, None, None
    stable, lift, slip, inc, rot, last = False, None, None, None, None, None
    t, fn = [x[3] for x in rows], [x[4] for x in rows]
    slope = lambda c, i: (rows[i][c] - rows[i - 1][c]) / (t[i] - t[i - 1]) if i else 0.0
    for i, x in enumerate(rows):
        _, _, _, now, f, _, hf, div, edge, tau, gv = x
        wanted = f < r.leave if held else f > r.enter
        since = (i if since is None else since) if wanted else None
        if wanted and now - t[since] >= (r.leave_s if held else r.enter_s):
            if held:
                out.append(("terminal", t[since], t[since]))
                held = False
                slip = inc = rot = lift = None
            else:
                held, began, stable, lift = True, since, False, None
                out.append(("contact_onset", t[since], t[since]))
            since = None
        if not held:
            continue
        if not stable and i - began >= r.stable_rows and f > r.stable_least and div < r.slip_div:
            part = fn[i - r.stable_rows : i]
            mean = sum(part) / len(part)
            if abs(mean) >= 1e-9 and max(sum(v * v for v in part) / len(part) - mean * mean, 0) ** 0.5 / abs(mean) < r.stable_spread:
                stable = True
                out.append(("grasp_stable", now, now))
        if stable and abs(gv) < r.still and slope(4, i) > r.lift_rate:
            if lift is None:
                lift = i
            elif lift != "done" and now - t[lift] >= r.lift_s:
                out.append(("lift", t[lift], now))
                lift = "done"
        elif lift != "done":
            lift = None
        if slip is None and f > r.stable_least and hf > r.rough_enter and abs(slope(5, i)) > r.shear_rate:
            slip = now
        elif slip is not None and hf < r.rough_leave:
            out.append(("slip", slip, now))
            slip = None
        for name, yes, least in (("incipient_slip", div > r.slip_div and edge > r.edge_rate, r.incipient_s), ("rotation", abs(tau) > r.torque, r.rotation_s)):
            at = inc if name == "incipient_slip" else rot
            if at is None and yes:
                at = now
            elif at is not None and not yes:
                if now - at >= least:
                    out.append((name, at, now))
                at = None
            inc, rot = (at, rot) if name == "incipient_slip" else (inc, at)
        w = r.place_rows
        if stable and i >= w and abs(gv) < r.still and fn[i - w] > r.stable_least and f < fn[i - w] * (1 - r.place_drop) and all(v <= 0.5 * fn[i - w] for v in fn[i + 1 : i + r.place_hold_rows]):
            if last is None or now - last >= r.place_gap_s:
                out.append(("place", t[i - w], now))
            last = now
    return out


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(4)
    return {(k, f): finger(rng, k, f) for k in range(40) for f in (0, 1)}


def test_passes_equal_a_plain_loop(spark, samples):
    df = spark.createDataFrame([r for rows in samples.values() for r in rows], SAMPLE)
    got = {}
    for r in fingers.finger_events(df, "episode", R).collect():
        got.setdefault((r.episode, r.finger), []).append((r.label, r.start, r.end))
    want = {k: plain(rows, R) for k, rows in samples.items()}
    for k in samples:
        assert sorted(got.get(k, [])) == sorted(want[k]), k
    seen = {x[0] for v in want.values() for x in v}
    assert seen == {"contact_onset", "terminal", "grasp_stable", "lift", "slip", "incipient_slip", "rotation", "place"}


def test_one_exchange(spark, samples):
    df = spark.createDataFrame(samples[0, 0], SAMPLE)
    plan = fingers.finger_events(df, "episode", R)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_detector_on_a_known_episode(spark):
    """A grab that is lost with the jaw reopening, then a grasp that is held, placed and released; at the end a residue."""
    rate, rows, jaw = 30, [], []
    for i in range(int(14 * rate)):
        t = i / rate
        fn = 3.0 if 2 <= t < 2.8 or 6 <= t < 10 else 0.0
        fn = 2.9 if 12 <= t < 12.25 else fn  # after the task, too short for a grasp
        fn1 = 3.0 if 6.1 <= t < 10.1 else 0.0
        pos = 40.0 if t < 1.5 else 20.0 if t < 4.2 else 45.0 if t < 5.5 else 12.0 if t < 9.9 else 45.0
        rows += [(1, f, i, t, v, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0) for f, v in ((0, fn), (1, fn1))]
        jaw.append((1, t, pos))
    s, j = spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(jaw, "episode long, t double, pos double")
    e = fingers.detected(s, j, "episode")
    got = [(r.finger, r.label, round(r.start, 1)) for r in e.orderBy("seq").collect()]
    assert (0, "contact_onset", 2.0) in got and (0, "drop", 2.8) in got and (0, "release", 10.0) in got and (1, "release", 10.1) in got
    anchors = spark.range(1).select(F.lit(1).cast("long").alias("episode"), F.lit(14.0).alias("length"), F.expr("array(named_struct('label', 'approach', 'start', 0.0D, 'end', 6.0D), named_struct('label', 'place_release', 'start', 9.9D, 'end', 14.0D))").alias("stages"))
    raw = s.withColumn("raw", F.col("fn"))
    full = hand.interpret(e, raw, j, anchors, "episode")
    base = hand.interpret(e, raw, j, anchors, "episode", full=False)
    assert [(r.kind, round(r.start, 1), round(r.end, 1)) for r in full.spans.filter("kind = 'failed_attempt'").collect()] == [("failed_attempt", 2.0, 2.8)]
    assert base.spans.count() == 0
    key = lambda d: sorted((r.finger, r.was if "was" in d.columns else r.label, r.start) for r in d.collect())
    assert key(full.events) == key(base.events)  # the taxonomy of the base is the same in both
    assert {r.label for r in base.events.collect()} <= {"contact_onset", "grasp_stable", "place", "release", "drop", "slip", "lift"}


def test_registered_queries_equal_a_plain_loop(spark, sf):
    from tracewright.plans import catalog_hand as c
    from tracewright.plans import registry

    rows = {}
    for r in c._channels(spark, sf).select(*[x.split()[0] for x in SAMPLE.split(", ")]).orderBy("episode", "finger", "i").collect():
        rows.setdefault((r.episode, r.finger), []).append(tuple(r))
    want = sorted((k[0], k[1], *e) for k, v in rows.items() for e in plain([x if x[6] is not None else (*x[:6], 0.0, *x[7:]) for x in v], c.FINGER))
    got = sorted((r.episode, r.finger, r.label, r.start, r.end) for r in registry.QUERIES["finger_events"](spark, sf).collect())
    assert [(a[:3], round(a[3], 6), round(a[4], 6)) for a in want] == [(a[:3], a[3], a[4]) for a in got] and len(got) > 100
    labels = {r.label for r in registry.QUERIES["detected_episodes"](spark, sf).select("label").distinct().collect()}
    assert labels >= {"contact_onset", "drop", "release"}


def test_detected_episodes_orders_the_rows_in_tables_only(spark, sf):
    from tracewright.plans import registry

    files = registry.QUERIES["detected_episodes"](spark, sf).inputFiles()
    assert files and not any("events.parquet" in f for f in files)
