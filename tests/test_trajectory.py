"""Slips over an episode's time against plain versions."""

import numpy as np
import pandas as pd
import pytest

from tracewright.operators import trajectory


def silhouette(x, p):
    """Row by row."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = (p == p[i]) & (np.arange(len(x)) != i)
        a, b = (d[i, own].mean() if own.any() else None), d[i, p != p[i]].mean()
        out.append(0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_in_blocks(spark):
    draw = np.random.default_rng(2)
    pdf = pd.DataFrame({"ep": draw.integers(0, 4, 300), "p": draw.random(300) > 0.6, "x": draw.normal(size=300).round(1), "y": draw.normal(size=300).round(1)})
    pdf.loc[pdf.p, "x"] += 1.5
    pdf = pd.concat([pdf, pdf.head(40), pd.DataFrame({"ep": [9, 9, 8, 8, 8], "p": [True, True, True, False, False], "x": [0.0, 1, 0, 0, 0], "y": [0.0, 1, 0, 0, 0]})], ignore_index=True)
    got = {r.ep: r for r in trajectory.phase_silhouette(spark.createDataFrame(pdf), ["ep"], "p", ["x", "y"], block=17).collect()}
    assert set(got) == {0, 1, 2, 3, 8}
    for ep, g in pdf.groupby("ep"):
        if ep != 9:
            assert got[ep]["rows"] == len(g)
            assert got[ep].silhouette == pytest.approx(silhouette(g[["x", "y"]].to_numpy(), g["p"].to_numpy()))


def test_silhouette_edges(spark):
    kind = "ep int, p boolean, x double, y double"
    assert trajectory.phase_silhouette(spark.createDataFrame([], kind), ["ep"], "p", ["x", "y"]).count() == 0
    rows = [(1, True, None, 0.0), (1, None, 1.0, 0.0), (1, True, 1.0, 0.0), (1, False, float("nan"), 0.0)]
    assert trajectory.phase_silhouette(spark.createDataFrame(rows, kind), ["ep"], "p", ["x", "y"]).count() == 0


def test_slip_summaries(spark):
    draw = np.random.default_rng(4)
    s = pd.DataFrame([(ep, f, i, i * 0.05, *draw.normal(0.7, 0.5, 3), draw.normal()) for ep in (0, 1) for f in (0, 1) for i in range(80)], columns=["ep", "finger", "i", "t", "fn", "sfx", "sfy", "copy"])
    slips = [(ep, f, at) for ep in (0, 1) for f in (0, 1) for at in (0.2, 1.333, 3.0, 3.99)]
    got = trajectory.slip_summaries(spark.createDataFrame(s), spark.createDataFrame([*slips, slips[0], (7, 0, 1.0)], "ep int, finger int, t double"), ["ep"], "i", 0.5).toPandas()
    assert len(got) == len(slips)
    for r in got.to_dict("records"):
        w = s[(s.ep == r["ep"]) & (s.finger == r["finger"]) & (s.t >= r["t"] - 0.5) & (s.t <= r["t"] + 0.5)]
        cop = w["copy"].where(w["fn"] > 0.5).to_numpy()
        want = [w["fn"].mean(), np.degrees(np.arctan2(w["sfy"].mean(), w["sfx"].mean())), np.nanmean(cop), np.nanmean(cop[-8:]) - np.nanmean(cop[:8])]
        assert np.allclose([r["grip"], r["shear_ang"], r["cop_y"], r["dcop"]], want)


def test_trajectory_against_plain_numpy(spark):
    draw = np.random.default_rng(6)
    pdf = pd.DataFrame({"ep": np.arange(90) % 3, "t": draw.permutation(90) * 0.1, "grip": draw.normal(size=90), "cop_y": draw.normal(size=90), "dcop": draw.normal(size=90)})
    v = draw.normal(size=(90, 6)) * [1, 2, 3, 4, 5, 6] + np.outer(pdf["t"], [1, 0.5, 0, 0, 2, 0]) + np.outer(draw.normal(size=90), [0, 0, 2, 3, 0, 9])
    pdf["v"] = v.tolist()
    anchors = spark.createDataFrame([(0, 4.0), (1, 100.0)], "ep int, at double")
    got = trajectory.slip_trajectory(spark.createDataFrame(pdf), anchors, ["ep"], "t", "v", "at").toPandas().set_index("ep")
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    _, _, axes = np.linalg.svd(z - z.mean(0), full_matrices=False)
    pc = z @ axes[:2].T
    for ep, g in pdf.groupby("ep"):
        r = got.loc[ep]
        rho = lambda x: g["t"].rank().corr(pd.Series(x, index=g.index).rank())
        assert r["slips"] == 30 and r["drift"] == pytest.approx(g["dcop"].sum())
        assert r["grip_rho"] == pytest.approx(rho(g["grip"])) and r["cop_rho"] == pytest.approx(rho(g["cop_y"]))
        assert abs(r["pc1_rho"]) == pytest.approx(abs(rho(pc[g.index, 0]))) and abs(r["pc2_rho"]) == pytest.approx(abs(rho(pc[g.index, 1])))
        if ep == 0:
            assert r["silhouette"] == pytest.approx(silhouette(pc[g.index], (g["t"] >= 4.0).to_numpy()))
        else:
            assert pd.isna(r["silhouette"])
