"""Exit signatures and out-of-fold models against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest

from tracewright.operators import exits, folds


def test_exit_atoms(spark):
    atoms = spark.createDataFrame([
        (1, 2.0, "interjection", "[auto:high] drop f0 0.50s (jaw-3.5u)"), (1, 5.04, "interjection", "[auto:low] release f1"),
        (1, 5.3, "interjection", "[auto:low] release f1 jaw+2.0u"), (1, 6.0, "vqa", "[auto:high] drop f0"), (1, 7.0, "interjection", "drop f0"),
        (2, 5.0, "interjection", "[auto:high] finger_unload f1"), (1, 8.0, "interjection", "[auto:high] slip f0"), (1, None, "interjection", "[auto:high] drop f0"), (1, 9.0, "interjection", None),
    ], "ep int, ts double, style string, content string")
    flags = spark.createDataFrame([(1, "no_arm weak_contact@4.0-5.0s weak_contact@8.5-9.5s"), (3, "weak_contact@0.0-99.0s"), (1, None)], "ep int, flag string")
    found = exits.exit_atoms(atoms, flags, ["ep"], "ts", "content", "style", "flag").orderBy("ep", "t")
    got = [(r.ep, r.finger, r.t, r.label, r.conf, r.jaw, r["class"]) for r in found.collect()]
    assert got == [(1, 0, 2.0, "drop", "high", -3.5, "loss"), (1, 1, 5.3, "release", "low", 2.0, "deliberate"), (2, 1, 5.0, "finger_unload", "high", None, "unload")]
    seen = spark.createDataFrame([(1, 5.28)], "ep int, t double")
    assert {(r.t, r["class"]) for r in exits.seen_losses(found, seen, ["ep"]).collect()} == {(2.0, "loss"), (5.3, "loss"), (5.0, "unload")}


def plain_features(own, other, at, reach):
    """One exit by plain numpy: own and other are frames of one finger, in order."""
    t = own["t"].to_numpy()
    seg = lambda d, a, b: d[(d["t"] >= at + a) & (d["t"] <= at + b)]
    hold, near, last, post = ((-reach.pre, -reach.near), (-reach.near, -reach.near_end), (-reach.last, -reach.last_end), (reach.near_end, reach.post))
    mean = lambda d, c, w: seg(d, *w)[c].mean()

    def slope(d, c, w):
        part = seg(d, *w).dropna(subset=[c])
        return np.polyfit(part["t"] - at, part[c], 1)[0] if len(part) >= 4 else math.nan

    def travel(c):
        v = seg(own, *near)[c].dropna().to_numpy()
        return v[-1] - v[0] if len(v) > 3 else math.nan

    def heading(w):
        x, y = mean(own, "sfx", w), mean(own, "sfy", w)
        return math.degrees(math.atan2(y, x)) if math.hypot(x, y) > 0.05 else math.nan

    level, partner = mean(own, "fn", hold), mean(other, "fn", hold)
    t80 = t20 = math.nan
    for when, v in zip(t, own["fn"], strict=True):
        if at - reach.pre <= when <= at + reach.post:
            if math.isnan(t80) and v <= 0.8 * level and when > at - reach.fall:
                t80 = when
            if not math.isnan(t80) and v <= 0.2 * level:
                t20 = when
                break
    turn = heading(hold) - heading(last)
    slip, twist = own.assign(tau=own["tau"].abs()), seg(own, *near)
    return dict(
        fn_hold_N=level, fn_near_N=mean(own, "fn", near), fn_last_N=mean(own, "fn", last), fn_near_ratio=mean(own, "fn", near) / level if level > 0 else math.nan,
        fn_slope_near_rel=slope(own, "fn", near) / level if level > 0 else math.nan, unload_80to20_s=t20 - t80, fn_post_N=mean(own, "fn", post),
        active_hold=mean(own, "active", hold), active_last=mean(own, "active", last), active_slope_near=slope(own, "active", near),
        copy_travel_near_mm=travel("copy"), copx_travel_near_mm=travel("copx"), cop_speed_near_mm_s=slope(own, "copy", near), copy_hold_mm=mean(own, "copy", hold),
        fs_hold_N=mean(own, "fs", hold), fs_near_N=mean(own, "fs", near), mu_hold=mean(own, "mu", hold), mu_near=mean(own, "mu", near), mu_max_near=twist["mu"].max(), mu_slope_near=slope(own, "mu", near),
        shear_swing_deg=abs((turn + 180) % 360 - 180), tau_max_near=twist["tau"].abs().max(), tau_hold=mean(slip, "tau", hold), hf_max_near=twist["hf"].max(), hf_hold=mean(own, "hf", hold),
        partner_fn_near_N=mean(other, "fn", near), partner_fn_post_N=mean(other, "fn", post), partner_slope_near_rel=slope(other, "fn", near) / partner if partner > 0.3 else math.nan, partner_mu_near=mean(other, "mu", near),
    )


def plain_channels(t, taxels):
    """Channels of one finger by plain numpy; taxels: [n, k, (x, y, fx, fy, fz)]."""
    x, y, fx, fy, fz = np.moveaxis(taxels, 2, 0)
    press = np.where(fz > 0, fz, 0)
    m = press.sum(1)
    with np.errstate(all="ignore"):
        cx, cy = (np.where(m > 0.2, (press * a).sum(1) / m, np.nan) for a in (x, y))
    sfx, sfy, fn = fx.sum(1), fy.sum(1), fz.sum(1)
    fs = np.hypot(sfx, sfy)
    tau = np.where(m > 0.2, ((x - np.nan_to_num(cx)[:, None]) * fy - (y - np.nan_to_num(cy)[:, None]) * fx).sum(1), 0)
    with np.errstate(all="ignore"):
        mu = np.where(fn > 0.3, fs / fn, np.nan)
    hf = np.sqrt(np.convolve(np.gradient(fs, t) ** 2, np.ones(10) / 10, mode="same"))
    return pd.DataFrame(dict(t=t, fn=fn, fs=fs, sfx=sfx, sfy=sfy, active=(fz > 0).sum(1).astype(float), copx=cx, copy=cy, tau=tau, mu=mu, hf=hf))


def test_signatures_against_plain_numpy(spark):
    draw, rows, plain = np.random.default_rng(5), [], {}
    for ep in (0, 1):
        for finger in (0, 1):
            t = np.cumsum(draw.uniform(0.02, 0.09, 160))
            force = draw.normal(0.1, 0.4, (160, 4, 5))
            force[:, :, :2] = [(-3, -2), (3, -2), (-3, 2), (3, 2)]
            force[:, :, 4] *= (np.sin(t * 2 + ep) + 1)[:, None]
            plain[ep, finger] = plain_channels(t, force)
            rows += [(ep, finger, i, float(a), [tuple(map(float, p)) for p in f]) for i, (a, f) in enumerate(zip(t, force, strict=True))]
    s = spark.createDataFrame(rows, "ep int, finger int, i int, t double, taxels array<struct<x:double,y:double,fx:double,fy:double,fz:double>>")
    s = exits.roughness(exits.taxel_channels(s, "taxels"), ["ep", "finger"], ["i"], "t")
    asked = [(ep, f, float(at), "drop") for ep in (0, 1) for f in (0, 1) for at in np.linspace(0.2, 9.5, 23)]
    got = exits.exit_features(s, spark.createDataFrame(asked + asked[:3], "ep int, finger int, t double, label string"), ["ep"], "i").toPandas()
    reach, want = exits.Reach(), {}
    for ep, f, at, _ in asked:
        own = plain[ep, f]
        if at - reach.pre >= own["t"].iloc[0] and at + reach.post <= own["t"].iloc[-1]:
            want[ep, f, at] = plain_features(own, plain[ep, 1 - f], at, reach)
    assert len(got) == len(want) > 20
    for r in got.to_dict("records"):
        for name, value in want[r["ep"], r["finger"], r["t"]].items():
            assert np.isclose(r[name], value, rtol=1e-6, atol=1e-9, equal_nan=True), (name, r[name], value)
    assert len(exits.EXIT_FEATURES) == 29


def test_exits_without_partner_or_samples(spark):
    none = spark.createDataFrame([], "ep int, finger int, i int, t double, taxels array<struct<x:double,y:double,fx:double,fy:double,fz:double>>")
    ex = spark.createDataFrame([(1, 0, 2.0)], "ep int, finger int, t double")
    s = exits.roughness(exits.taxel_channels(none, "taxels"), ["ep", "finger"], ["i"], "t")
    assert exits.exit_features(s, ex, ["ep"], "i").count() == 0
    some = [(1, 0, i, i * 0.1, [(1.0, 1.0, 0.1, 0.1, 1.0)]) for i in range(40)]
    s = exits.roughness(exits.taxel_channels(spark.createDataFrame(some, none.schema), "taxels"), ["ep", "finger"], ["i"], "t")
    r = exits.exit_features(s, ex, ["ep"], "i").first()
    assert r.fn_hold_N == pytest.approx(1) and r.partner_fn_near_N is None and r.partner_mu_near is None and r.unload_80to20_s is None


def labelled(n=240, folds_=8, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.2 * draw.normal(size=n) > 0.4).astype(float)
    x[draw.random((n, 5)) < 0.1] = np.nan
    x[:, 4] = np.nan
    d = pd.DataFrame(x, columns=list("abcde")).astype(object).where(~np.isnan(x), None)
    return d.assign(id=range(n), fold=np.arange(n) % folds_, y=y)


SCHEMA = "a double, b double, c double, d double, e double, id long, fold long, y double"


def plain_knn(pdf, k):
    """Leave one fold out, row by row."""
    x = pdf[list("abcd")].to_numpy(float)
    y, fold, out = pdf["y"].to_numpy(float), pdf["fold"].to_numpy(), np.zeros(len(pdf))
    for f in np.unique(fold):
        tr = fold != f
        med = np.nanmedian(x[tr], axis=0)
        full = np.where(np.isnan(x), med, x)
        z = (full - full[tr].mean(0)) / full[tr].std(0)
        for q in np.flatnonzero(~tr):
            d = np.sqrt(((z[tr] - z[q]) ** 2).sum(1))
            near = np.argsort(d)[:k]
            out[q] = np.average(y[tr][near], weights=1 / d[near])
    return out


def test_out_of_fold(spark):
    pdf = labelled()
    rows = spark.createDataFrame(pdf, SCHEMA)
    got = folds.out_of_fold(rows, "abcde", "y", "fold", ["id"], block=11).toPandas().sort_values("id")
    assert got["id"].tolist() == pdf["id"].tolist()
    for k in (5, 7, 11):
        assert np.allclose(got[f"knn{k}"], plain_knn(pdf, k))
    assert ((got["mlp"] >= 0.5) == (pdf["y"].to_numpy() == 1)).mean() > 0.8
    # a fold's own labels never reach its scores
    other = pdf.assign(y=np.where(pdf["fold"] == 2, 1 - pdf["y"], pdf["y"]))
    again = folds.out_of_fold(spark.createDataFrame(other, SCHEMA), "abcde", "y", "fold", ["id"]).toPandas().sort_values("id")
    own = (pdf["fold"] == 2).to_numpy()
    assert np.allclose(got["mlp"][own], again["mlp"][own]) and np.allclose(got["knn5"][own], again["knn5"][own])
    assert not np.allclose(got["mlp"][~own], again["mlp"][~own])


def test_network_learns():
    """The network's loss on its own rows ends well below that of constant scores."""
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(60, 3)), (draw.random(60) > 0.5).astype(float)
    loss = lambda p: -np.mean(y * np.log(q := np.clip(folds._logistic(folds._forward(p, x)[-1][:, 0]), 1e-12, 1 - 1e-12)) + (1 - y) * np.log(1 - q))
    fitted = folds.network(x, y)
    zero = [np.zeros_like(p) for p in fitted]
    assert loss(fitted) < loss(zero) - 0.2


def test_out_of_fold_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert folds.out_of_fold(empty, "abcde", "y", "fold", ["id"]).count() == 0
    pdf = labelled(20, 2)
    one = pdf.assign(y=pdf["fold"].astype(float))  # each fold learns from one class only
    got = folds.out_of_fold(spark.createDataFrame(one, SCHEMA), "abcde", "y", "fold", ["id"]).toPandas()
    assert (got["mlp"] == 1 - got["y"]).all() and (got["knn5"] == 1 - got["y"]).all()
    alone = pdf.assign(fold=None)
    got = folds.out_of_fold(spark.createDataFrame(alone, SCHEMA), "abcde", "y", "fold", ["id"]).toPandas()
    assert len(got) == 20 and got["mlp"].isna().all()


def test_model_scores(spark):
    rows = [(1.0, 0.9, 0.5), (1.0, 0.4, 0.5), (0.0, 0.4, 0.5), (0.0, 0.1, 0.5), (None, 0.9, 0.5), (1.0, None, 0.5)]
    got = {r.model: r for r in folds.model_scores(spark.createDataFrame(rows, "y double, m double, n double"), "y", ["m", "n"]).collect()}
    assert got["m"]["rows"] == 4 and got["m"].auc == 0.875 and got["m"].recall_1 == 0.5 and got["m"].recall_0 == 1 and got["m"].balanced_accuracy == 0.75
    assert got["n"].auc == 0.5 and got["n"].recall_1 == 1 and got["n"].recall_0 == 0
