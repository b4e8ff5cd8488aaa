"""The exact neighbour index and the signal screen: a load step on known series, brute force, and what is visited."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import metric, screen

RULES = screen.Screen()
CHANNELS = ["fn", "fs", "active", "rough"]


def series(spark, keys, step=5.0, load=4.0, seconds=10, hz=91):
    rows = []
    for k in keys:
        for i in range(seconds * hz):
            on = i / hz >= step
            rows.append((k, i / hz, load + 0.05 * math.sin(i) if on else 0.0, load / 3 if on else 0.0, 10.0 if on else 0.0))
    d = spark.createDataFrame(rows, "episode long, t double, fn double, fs double, active double")
    return screen.with_roughness(d, ["episode"], "t", "fn", 10, "rough")


@pytest.fixture(scope="module")
def windows(spark):
    s = series(spark, range(30)).cache()
    centres = [(k, 5 + 0.001 * k, "release") for k in range(30)] + [(k, 2 + 0.001 * k, "background") for k in range(30)]
    centres += [(0, 0.1, "early"), (0, 9.99, "late"), (1, 2.5, "flat"), (1, 5.0, "step")]
    return screen.terminal_windows(s, spark.createDataFrame(centres, "episode long, t double, label string"), ["episode"], "t", CHANNELS).cache()


def test_windows(windows):
    got = {(r.label, r.t): r.v for r in windows.collect()}
    assert not any(label in ("early", "late") for label, _ in got)
    v = got["step", 5.0]
    assert len(v) == 68 and v[-3] > v[-4] and abs(v[-2] - (v[-3] - v[-4])) < 1e-9
    assert v[-1] == max(v[48:64])
    assert not any(got["flat", 2.5])


def corpus(spark, windows):
    rows = windows.filter("label in ('release', 'background')").withColumn("id", F.concat_ws(":", "episode", "t", "label"))
    m = np.array([r.v for r in rows.collect()]).mean(0)
    return screen.Reference(rows, spark.createDataFrame([(m.tolist(), [1.0] * 68)], "mean array<double>, std array<double>"), ("episode",))


def test_votes(spark, windows):
    ref = corpus(spark, windows)
    asked = windows.filter("label in ('flat', 'step')")
    for exclude in (True, False):
        got = {r.label: r for r in screen.screened(screen.background_votes(ref, asked, ["episode"], "t", exclude=exclude), "label").collect()}
        assert (got["flat"].votes, got["step"].votes) == (RULES.k, 0)
        assert got["flat"].artifact and not got["step"].artifact and got["flat"].flag is None  # only places, releases and drops are flagged
    few = screen.Reference(ref.rows.limit(10), ref.scaler, ref.keys)
    assert {r.votes for r in screen.background_votes(few, asked, ["episode"], "t").collect()} == {None}


def test_reference_takes_background_far_from_events(spark):
    s = series(spark, range(3))
    events = spark.createDataFrame([(k, 5.0, "release") for k in range(3)] + [(0, 0.05, "drop")], "episode long, t double, label string")
    ref = screen.reference(s, events, ["episode"], "t", CHANNELS)
    rows = ref.rows.collect()
    assert sorted((r.episode, r.label) for r in rows) == sorted([(k, "release") for k in range(3)] + [(k, "background") for k in range(3) for _ in range(2)])
    assert all(abs(r.t - 5) >= RULES.gap and 0.35 <= r.t <= 9.64 for r in rows if r.label == "background")
    one = ref.scaler.first()
    assert len(one["mean"]) == len(one["std"]) == 68


def test_index_is_exact_and_stays_in_bounds(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 10
    x = np.concatenate([centres[rng.integers(6, size=380)] + rng.normal(size=(380, 4)) * 0.3, np.repeat(centres[:1], 40, axis=0)])
    data = [(i, v.tolist(), int(i % 7) if i % 50 else None, f"l{i % 3}") for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id long, v array<double>, g int, label string")
    for k in (1, 7, 500):
        index = metric.build(df, "id", "v", "g", "label", pivots=8, block_rows=16)
        got = {}
        for r in metric.nearest(index, df.filter("id % 5 = 0"), k, "id", "v", "g").collect():
            got.setdefault(r.query, []).append((r["rank"], r.id, r.distance))
        for q in range(0, len(x), 5):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            own = data[q][2]
            best = [(d[i], i) for i in range(len(x)) if own is None or data[i][2] != own]
            want = [(n + 1, i, dist) for n, (dist, i) in enumerate(sorted(best)[:k])]
            assert [(a, b) for a, b, _ in sorted(got[q])] == [(a, b) for a, b, _ in want]
            assert np.allclose([c for *_, c in sorted(got[q])], [c for *_, c in want], rtol=1e-12)
    index = metric.build(df, "id", "v", "g", "label", pivots=8, block_rows=16)
    kth = np.array([np.sort(np.sqrt(((x - v) ** 2).sum(1)))[20] for v in x[:60]])
    visited = list(metric.bounds(index, x[:60], kth, 7, False))
    r = metric.to_pivots(x, index.pivots)
    cell, own = r.argmin(1), r[np.arange(len(x)), r.argmin(1)]
    seen = 0
    for i, c, lo, hi in visited:
        inside = (cell == c) & (own >= lo) & (own <= hi)
        seen += inside.sum()
        # nothing beyond the bound by the triangle inequality is in the range, and nothing within the k-th distance is left out
        assert (np.abs(own[inside] - r[i, c]) <= kth[i] * (1 + 1e-6)).all()
    for i in range(60):
        near = np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(1)) <= kth[i])
        ranges = {c: (lo, hi) for j, c, lo, hi in visited if j == i}
        for n in near:
            if cell[n] != cell[i]:
                assert ranges[cell[n]][0] <= own[n] <= ranges[cell[n]][1]
    assert seen < 0.5 * 60 * len(x)
