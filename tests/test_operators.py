"""Operators on small inputs whose results are known."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import annotate, detect, islands, kernels, passes, screen, setops, shape, trim
from tracewright.operators import timeseries as ts
from tracewright.sources import sidecar as src
from tracewright.streaming import online


def test_latch_stamps_and_waits():
    t = np.arange(0, 3, 0.1)
    x = np.where((t > 0.45) & (t < 1.55), 1.0, 0.0)
    got = kernels.latch(t, x, 0.15, 0.1, 0.2, 0.3)
    assert [(k, round(s, 1)) for k, s, _ in got] == [("onset", 0.5), ("terminal", 1.6)]
    assert kernels.latch(t[:17], x[:17], 0.15, 0.1, 0.2, 0.3)[-1][0] == "onset"  # the end still waits
    assert kernels.latch(t, np.zeros(30), 0.15, 0.1, 0.2, 0.3) == []


def test_baseline_follows_small_offsets_only():
    t = np.arange(0, 6, 1 / 30)
    x = np.where(t < 4.5, 0.4, 3.4)
    out = kernels.baseline(t, x, 0.0, 1.5, 1.0)
    assert out[int(4.4 * 30)] < 0.05 and out[-1] > 2.9


def test_changepoints():
    x = np.concatenate([np.zeros(20), np.ones(20) * 5, np.ones(20)])
    assert [k for k, _ in kernels.changepoints(x, 14, 0.02, 3)] == [20, 40]
    assert kernels.changepoints(np.zeros(10), 14, 0.02, 3) == []
    assert kernels.changepoints(np.empty(0), 14, 0.02, 3) == []


def test_cycles_and_gate_and_clock():
    t = np.arange(8.0)
    assert kernels.cycles(t, np.array([10, 12, 2, 1, 3, 11, 12, 12.0]), 8) == [(1.0, 3.0, 5.0)]
    anchors = kernels.clock_map(np.arange(6.0), np.arange(6) * 10.0, np.arange(12) / 2, np.repeat(np.arange(6) * 10.0, 2), 0.05, 5)
    assert anchors == [(float(k), float(k)) for k in range(6)]
    assert kernels.clock_map(np.arange(3.0), np.arange(3.0), np.arange(3.0), np.arange(3.0), 0.05, 5) == []


def test_residual_gate(spark):
    x = [0, 0, 1, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1.0]
    df = spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(x)] + [(2, 0, 0.0, 1.0)], "k int, i int, t double, x double")
    got = detect.residual_gate(df, "k", "i", "t", "x", 0.5, 2.0).orderBy("k", "i").collect()
    assert [r.open for r in got] == [True] * 5 + [False] * 5 + [True] * 3 + [True]


def test_contacts_are_the_latch(spark):
    """The windowed form against the row-by-row latch, on noise with ties of time and nulls."""
    rng = np.random.default_rng(5)
    rows = [(k, i, float(t), float(v)) for k in range(12) for i, (t, v) in enumerate(zip(np.cumsum(rng.choice([0, 0.1, 0.3], 300)), np.cumsum(rng.normal(0, 0.06, 300)), strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, t double, x double")
    got = sorted((r.k, r.kind, r.start, r.fired) for r in detect.contacts(df, "k", "i", "t", "x", detect.Rules()).collect())
    want = sorted((k, *e) for k in range(12) for e in kernels.latch(*(np.array(c) for c in zip(*[(r[2], r[3]) for r in rows if r[0] == k], strict=True)), 0.15, 0.1, 0.2, 0.3))
    assert got == want and len(got) > 20


def test_clock_map_is_the_plain_search():
    rng = np.random.default_rng(6)
    for _ in range(50):
        raw = rng.integers(0, 30, 80) / 10
        frames = rng.choice(raw, 20) + rng.normal(0, 0.03, 20)
        t, want, at = np.cumsum(rng.choice([0, 1.0], 80)), [], 0
        for k, v in enumerate(frames):
            hit = [j for j in range(at, 80) if abs(raw[j] - v) <= 0.05]
            if hit:
                at = hit[0]
                if not want or t[at] > want[-1][1]:
                    want.append((float(k), float(t[at])))
        assert kernels.clock_map(np.arange(20.0), frames, t, raw, 0.05, 1) == want


def test_scale_groups():
    got = kernels.scale_groups([("a", 1, 10), ("b", 2, 20), ("c", 1e5, 1e7), ("d", 3, 3), ("e", 0.5, float("inf"))])
    assert got == [["a", "b"], ["c"], ["d"], ["e"]]


def test_median_cuts_edges(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([9, 1, 5, 3, 7])], "k int, i int, x double")
    got = [r.m for r in ts.median5(df, ["k"], ["i"], "x", "m").orderBy("i").collect()]
    assert got == [5.0, 5.0, 5.0, 5.0, 5.0]
    inner = [r.m for r in ts.median5(df, ["k"], ["i"], "x", "m", interior=True).orderBy("i").collect()]
    assert inner == [9.0, 1.0, 5.0, 3.0, 7.0]


def test_runs_and_merge(spark):
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate([0.0, 5.0, 6.0, 0.0, 7.0, 0.0, 0.0, 0.0, 8.0])], "k int, i int, t double, x double")
    r = islands.runs(df, ["k"], ["i"], F.col("x") > 1, "t", "x", 0.5).orderBy("start").collect()
    assert [(a.start, a.end, a.n, a.peak) for a in r] == [(1.0, 3.0, 2, 6.0), (4.0, 5.0, 1, 7.0), (8.0, 8.5, 1, 8.0)]
    m = islands.bouts(df, ["k"], ["i"], "t", "x", 1.0, 0.5, 1.0).orderBy("start").collect()
    assert [(a.start, a.end, a.spans) for a in m] == [(1.0, 5.0, 2)]


def test_trim(spark):
    df = spark.createDataFrame([(e, i, float(i)) for e in (3, 7, 9) for i in range(20)], "episode long, i long, x double")
    cuts = spark.createDataFrame([(3, 3, 14), (7, 5, 9)], "episode long, start long, end long")
    out = trim.rebase(df, trim.check_cuts(cuts), "episode", "i", 30.0, renumber=True)
    rows = out.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(12 + 5 + 20))
    assert [r.frame_index for r in rows if r.episode == 7] == list(range(5))
    assert {r.episode: r.new_episode for r in rows} == {3: 0, 7: 1, 9: 2}
    with pytest.raises(Exception, match="bad cut"):
        trim.check_cuts(spark.createDataFrame([(3, 9, 4)], "episode long, start long, end long")).collect()
    atoms = spark.createDataFrame([(3, 0.1), (3, 0.2), (3, 0.5), (3, 0.6), (3, None)], "episode long, ts double")
    w = spark.createDataFrame([(3, 0.1, 0.4)], "episode long, shift double, kept double")
    assert sorted(round(r.ts, 6) for r in trim.shift_atoms(atoms, w, "episode", "ts").collect()) == [0.0, 0.0, 0.1, 0.4]


def test_three_way(spark):
    ours = spark.createDataFrame([(1, "s", "a", 0.0), (1, "s", "b", 1.0), (1, "s", "c", 5.0)], "k int, style string, content string, t double")
    theirs = spark.createDataFrame([(1, "s", "a", 0.0), (1, "s", "b", 1.2), (1, "s", "z", 5.1), (1, "s", "q", 9.0)], "k int, style string, content string, t double")
    got = sorted(r.status for r in setops.three_way_diff(ours, theirs, ["k"], "style", "content", "t", 0.5).collect())
    assert got == ["modified", "moved", "only_theirs", "unchanged"]


def test_annotations(spark, tmp_path):
    f = tmp_path / "episode_000001_x.json"
    f.write_text(json.dumps({"schema_version": 1, "episode_index": 1, "saved_at": "now", "atoms": [{"role": "user", "content": "[auto:high] slip f0 1.00s", "style": "interjection", "timestamp": 0.5, "camera": None}, {"role": "assistant", "content": "grasp", "style": "subtask", "timestamp": 0.0, "camera": None}]}))
    atoms = src.annotations(spark, str(f))
    assert [(r.style, r.timestamp) for r in atoms.orderBy("timestamp").collect()] == [("subtask", 0.0), ("interjection", 0.5)]
    src.write_annotations(atoms, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select(F.explode("atoms")).count() == 2
    frames = spark.createDataFrame([(1, 0.0), (1, 0.4), (1, 0.6)], "episode_index long, timestamp double")
    out = {r.timestamp: r for r in annotate.with_language(frames, atoms, "episode_index", "timestamp").collect()}
    assert len(out[0.0].language_persistent) == 1 and len(out[0.4].language_events) == 1 and not out[0.6].language_events


def test_sidecar(spark, tmp_path):
    f = tmp_path / "s.csv"
    rows = ["﻿timestamp_ns,fx,fy,fz,p_00_fx,p_00_fy,p_00_fz", "1000000000,0,0,1,0.1,0.2,0.3", "1011000000,0,0,1,0,0,0", "1022000000,0,0,0,0,0,0"]
    f.write_text("\n".join(rows))
    got = src.sidecar(spark, str(f)).orderBy("ns").collect()
    assert [round(r.t, 3) for r in got] == [0.0, 0.011, 0.022]
    assert [r.points[0].fz for r in got] == [0.3, 0.3, 0.0]
    assert src.epoch_range(spark, str(f), "fx").count() == 0
    assert [x.name for x in src.feature_schema({"a": {"dtype": "float32", "shape": [6]}, "v": {"dtype": "video"}, "i": {"dtype": "int64", "shape": [1]}})] == ["a", "i"]
    assert src.present(spark.range(1), {"id": "long", "z": "double"}).collect()[0].z is None


def test_detector(spark):
    t = np.arange(0, 12, 1 / 30)
    x = np.where((t > 5.5) & (t < 8), 3.0, 0.0)
    jaw = np.where(t < 5.5, 40.0, np.where(t < 8, 10.0, 45.0))
    df = spark.createDataFrame([(1, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, x, jaw, strict=True))], "episode long, i int, t double, x double, jaw double")
    got = detect.detect(df, "episode", "i", "t", "x", "jaw").collect()
    assert [(r.kind, r.terminal, round(r.start, 1), round(r.end, 1)) for r in got] == [("grasp", "release", 5.5, 8.0)]


def test_knn_excludes_group(spark):
    rows = [(i, [float(i), 0.0], i % 2, i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g long, label long")
    got = screen.nearest(df.filter("id = 4"), df, 3, "id", "v", "g", "label").orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(3, 1.0), (5, 1.0), (1, 3.0)]
    assert screen.nearest(df.limit(0), df, 3, "id", "v", "g", "label").count() == 0


def test_stream_latch_in_any_order(spark, sf, tmp_path):
    """Rows out of order over many files, read a few files at a time: the same events as the batch latch."""
    from tracewright.plans import catalog_stream as c

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy(F.xxhash64("event_id")).repartition(11).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in c.latch_of(stream, events).collect())
    rows = collections.defaultdict(list)
    for r in events.selectExpr("user_id", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS us", "event_id", "value").collect():
        rows[r.user_id].append((float(r.us), r.event_id, r.value))
    want = sorted((e, *x) for e, own in rows.items() for x in kernels.latch(*(np.array(col) for col in list(zip(*sorted(own), strict=True))[::2]), 34.0, 20.0, 3.6e9, 3.6e9))
    assert got == want and len(got) > 5


def test_streams_equal_batch(spark, tmp_path):
    rows = [(e, float(k), 1.0 if (k // 5) % 2 else 0.0) for e in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "episode long, t double, x double")
    for k, part in enumerate((df.filter("t < 13"), df.filter("t >= 13 and t < 27"), df.filter("t >= 27"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = stream.withColumn("ts", F.timestamp_seconds("t"))
    q = online.windowed(timed, "ts", ["episode"], "x", "10 seconds", "1 minute").writeStream.format("memory").outputMode("complete").queryName("windowed").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.episode, r.n) for r in spark.table("windowed").collect()} == {(1, 10), (2, 10)}


def test_session_csv(spark, tmp_path):
    from tracewright.sources import session_csv as s

    names = [f"e{k}_{a}" for k in range(12) for a in "xyz"]
    lines = [",".join(["t_epoch_ns", *names])] + [",".join([str(10**9 + n * 10**7), *(["3", "4", "0"] + ["0"] * 33)]) for n in range(11)]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    (tmp_path / "base.csv").write_text("element,x,y,z\n0,0,0,0\nbad,1,1,1\n1,0,0,0")
    base = s.baseline(spark, str(tmp_path / "base.csv"))
    assert base.count() == 2
    w = s.session_window(spark, str(tmp_path / "raw.csv"), 10**9, 10**9 + 5 * 10**7, 10**9, base)
    r = w.orderBy("ns").collect()
    assert len(r) == 6 and r[0].peak_dev == 5.0 and abs(r[0].mean_dev - 5 / 12) < 1e-9
    assert abs(s.measured_rate(w).collect()[0].hz - 100) < 1e-6
    (tmp_path / "sheet.csv").write_text("Episode_index,scene,auto_stage,failure_mode,notes\n1,a,S5 done,,x\n2,b,S2,F4 slip,\n,c,S1,,")
    good, bad = s.scorer_sheet(spark, str(tmp_path / "sheet.csv"))
    assert sorted((r.episode, r.stage, r.failure, r.score) for r in good.collect()) == [(1, "S5", None, 1.0), (2, "S2", "F4", 0.4)]
    assert bad.count() == 1


def test_batch_isolates_errors_and_resumes(spark, tmp_path):
    from tracewright.plans import batch

    df = spark.createDataFrame([(e, i, float(i)) for e in (1, 2, 3) for i in range(5)], "episode long, i long, x double")

    def work(pdf):
        if pdf["episode"].iloc[0] == 2:
            raise ValueError("no signal")
        return len(pdf), ["long"] if pdf["episode"].iloc[0] == 3 else []

    got = batch.run(df, "episode", "i", work)
    assert {r.episode: (r.status, r.rows, r.error) for r in got.collect()} == {1: ("ok", 5, None), 2: ("failed", None, "ValueError: no signal"), 3: ("ok", 5, None)}
    assert tuple(batch.summary(got).collect()[0]) == (3, 2, 1, 1)
    assert {r.episode for r in batch.remaining(df, got.filter("episode < 3"), "episode").collect()} == {3}
    cuts = spark.createDataFrame([(1, 1, 3), (3, 0, 0)], "episode long, start long, end long")
    batch.write_trimmed(df, cuts, str(tmp_path / "out"), "episode", "i", 30.0)
    meta = sorted((r.episode_index, r.length, r.from_index, r.to_index) for r in spark.read.parquet(str(tmp_path / "out/meta/episodes")).collect())
    assert meta == [(0, 3, 0, 3), (1, 5, 3, 8), (2, 1, 8, 9)]
    with pytest.raises(Exception, match="exists"):
        batch.write_trimmed(df, cuts, str(tmp_path / "out"), "episode", "i", 30.0)


def test_closed_spans_leave_out_what_no_row_ends(spark):
    d = spark.createDataFrame([("a", k, float(k), v) for k, v in enumerate([0, 9, 7, None, 9, 0, 9])], "k string, i int, t double, x int")
    got = sorted(map(tuple, passes.closed_spans(d, ["k"], ["i"], "t", F.col("x") > 5, F.col("x"), 1.0).collect()))
    assert got == [("a", 1.0, 3.0, 9, 9), ("a", 4.0, 5.0, 9, 9)]
    assert passes.closed_spans(d.limit(0), ["k"], ["i"], "t", F.col("x") > 5, F.col("x"), 1.0).count() == 0


def test_flags_by_time_and_evaluation(spark):
    d = spark.createDataFrame([("a", 0, "late@9-9s", False), ("a", 1, "plain", False), ("a", 2, "air@2.5-3s", True), ("a", 3, "early@1-2s", False)], "k string, p int, f string, span boolean")
    assert passes.flags_in_time(d, ["k"], "p", "f", F.col("span"), False).first().flags == ["early@1-2s", "air@2.5-3s", "late@9-9s", "plain"]
    assert passes.flags_in_time(d, ["k"], "p", "f", F.col("span"), True).first().flags == ["early@1-2s", "late@9-9s", "plain"]
    e = spark.createDataFrame([(["x", "hesitation", "hesitation"], "fail", True), (["hesitation"], "success", True), (["hesitation"], None, True)], "f array<string>, r string, rel boolean")
    assert [r[0] for r in e.select(passes.evaluation_flags(F.col("f"), F.col("r"), F.col("rel"))).collect()] == [["x", "hesitation", "result_fail"], ["hesitation"], ["hesitation"]]


def test_upgrade_and_faults(spark):
    doc = json.dumps({"subtasks": [{"label": "grasp", "start": 1}, {"start": 2}], "high_levels": [{"user_prompt": "go", "robot_utterance": ""}, {"start": 3, "robot_utterance": "yes"}]})
    d = annotate.upgraded(spark.createDataFrame([(1, doc), (2, None), (3, "not json")], "e int, d string"), "e", "d")
    say = annotate.speech_text(F.col("role"), F.col("style"), F.col("tool_calls"))
    assert sorted((r.timestamp, r.style or "", r.content or "", r.say or "") for r in d.withColumn("say", say).collect()) == [(0.0, "interjection", "go", ""), (1.0, "subtask", "grasp", ""), (3.0, "", "", "yes")]
    rows = [("odd", "x", 0, None), ("vqa", None, 0, None), (None, "x", 0, None), ("subtask", "x", 0, "front"), ("vqa", "x", 0, "front"), (None, None, 1, None), ("plan", "x", None, "")]
    f = spark.createDataFrame(rows, "s string, c string, n int, cam string")
    assert [r[0] for r in f.select(annotate.fault(*map(F.col, ("s", "c", "n", "cam")))).collect()] == ["style", "empty", "speech", "camera", None, None, None]


def test_local_edits_compare_multisets(spark):
    one = lambda rows: spark.createDataFrame(rows, "e int, ts double, c string")
    hub = one([(1, 0.0, "a"), (1, 0.0, "a"), (2, 0.0, "a"), (3, 1.0, "b")])
    local = one([(1, 0.0, "a"), (2, 0.0, "a"), (3, None, None), (4, None, None)])
    got = annotate.local_edits(local, hub, hub.limit(0), hub.limit(0), "e", ["ts", "c"])
    # 1: one copy less; 3: emptied, but the proposal is empty too; 4: empty everywhere
    assert {r.e: r.edited for r in got.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_decisions_and_reviews_keep_what_people_made(spark):
    old = spark.createDataFrame([(1, 0, 9, "adjusted", False), (2, 0, 9, "rule", True), (3, 0, 9, "rule", False)], "e int, start int, end int, source string, reviewed boolean")
    new = spark.createDataFrame([(k, 1, 5) for k in (1, 2, 3, 4)], "e int, start int, end int")
    assert sorted((r.e, r.start) for r in trim.decided(old, new, "e").collect()) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    assert sorted((r.e, r.start) for r in trim.decided(old, new, "e", True).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]
    c = spark.createDataFrame([(1, "human", "S1"), (2, "auto", "S2"), (3, None, "S3")], "e int, source string, stage string")
    n = spark.createDataFrame([(k, "S5") for k in (1, 2, 3, 4)], "e int, stage string")
    assert {r.e: (r.stage, r.written) for r in annotate.reviewed(c, n, "e", ["stage"]).collect()} == {1: ("S1", False), 2: ("S5", True), 3: ("S3", False), 4: ("S5", True)}


def test_files_and_series_of_an_episode(spark):
    f = spark.createDataFrame([("a", "r/episode_000001/x.csv"), ("a", "r/other.csv"), ("b", "x.csv"), ("b", "y.csv")], "d string, p string")
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "d string, e long")
    assert sorted(map(tuple, shape.episode_files(f, e, "d", "e", "p").collect())) == [("a", 1, "r/episode_000001/x.csv"), ("b", 7, "x.csv"), ("b", 7, "y.csv")]
    d = spark.createDataFrame([(1, t, n, p, v) for t in range(3) for n, p, v in (("Action.Gripper.pos", 0, 1.0), ("my.GRIPPER.pos", 1, 2.0), ("a.pos", 2, 3.0), ("b.pos", 3, None if t == 1 else 4.0))], "e int, t int, n string, p int, v double")
    assert {r.v for r in shape.gripper_series(d, "e", "t", "n", "p", "v").collect()} == {2.0}
    assert shape.arm_series(d, "e", "t", "n", "p", "v").count() == 0  # two whole frames are too few
    assert sorted(r.joints for r in shape.arm_series(d.fillna(5.0), "e", "t", "n", "p", "v").collect()) == [[3.0, 4.0], [3.0, 4.0], [3.0, 5.0]]
