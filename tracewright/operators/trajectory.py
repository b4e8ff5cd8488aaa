"""How the slips of an episode change over its time: physical summaries, a corpus-wide map, and two phases.

Samples meet slips by an equi-join on bins of the window's length. The map is fitted on all slips and read by
episode. The silhouette of two phases needs every distance within an episode; rows are dealt to blocks of bounded
size, a task holds two blocks and sends one sum for each row, never a pair. Its work grows as the square of one
episode's slips, not of the corpus; episodes of one block share a task's block. What several steps read is kept.
Both sides of a join grow with the samples or the episodes, so they are merged: small as compressed, a side would be
broadcast, and the driver would hold many times its size, for several joins at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import learn, stats
from .tables import kept

#: Rows of a block of the silhouette.
BLOCK = 2048


def slip_summaries(samples: DataFrame, slips: DataFrame, keys, order: str, half: float, loaded: float = 0.5, ends: int = 8) -> DataFrame:
    """The slips with grip, shear_ang (degrees), cop_y and dcop over [t - half, t + half] of their own finger.

    ``samples``: keys, finger, t, ``order``, fn, sfx, sfy and copy. Centres of pressure count where fn is above ``loaded``;
    dcop is the mean of the last ``ends`` rows less that of the first, rows without a centre included in the count.
    Slips without samples are left out; repeated slips are one.
    """
    keys = [*keys, "finger"]
    width = 2 * half
    bins = F.explode(F.sequence(F.floor((F.col("t") - half) / width), F.floor((F.col("t") + half) / width)))
    e = slips.select(F.struct(*slips.columns).alias("_e"), bins.alias("_bin")).distinct()
    s = samples.select(F.struct(*keys).alias("_k"), F.floor(F.col("t") / width).alias("_b"), "t", F.col(order).alias("_o"), "fn", "sfx", "sfy", F.when(F.col("fn") > loaded, F.col("copy")).alias("_cop"))
    on = (F.col("_bin") == F.col("_b")) & F.col("t").between(F.col("_e.t") - half, F.col("_e.t") + half)
    for k in keys:
        on = on & (F.col(f"_e.{k}") == F.col(f"_k.{k}"))
    w = Window.partitionBy("_e")
    d = e.join(s.hint("merge"), on).withColumn("_r", F.row_number().over(w.orderBy("_o"))).withColumn("_n", F.count("*").over(w))
    first, last = F.avg(F.when(F.col("_r") <= ends, F.col("_cop"))), F.avg(F.when(F.col("_r") > F.col("_n") - ends, F.col("_cop")))
    g = d.groupBy("_e").agg(F.avg("fn").alias("grip"), F.degrees(F.atan2(F.avg("sfy"), F.avg("sfx"))).alias("shear_ang"), F.avg("_cop").alias("cop_y"), (last - first).alias("dcop"))
    return g.select("_e.*", "grip", "shear_ang", "cop_y", "dcop")


def phase_silhouette(points: DataFrame, keys, phase: str, coords, block: int = BLOCK) -> DataFrame:
    """(keys, rows, silhouette): the mean silhouette of the two phases (a boolean) of each key by Euclidean distance.

    Keys with one phase only are left out, as are rows with a null phase or coordinate. A phase of one row counts 0,
    as do rows whose distances are all 0. Equal rows count as often as they stand there.
    """
    keys, coords = list(keys), list(coords)
    d = points.select(F.struct(*keys).alias("_k"), F.col(phase).alias("_p"), F.array(*[F.col(c).cast("double") for c in coords]).alias("_x")).filter("_p is not null and not exists(_x, v -> v is null or isnan(v))")
    # equal rows have equal distances: one of them stands for all
    d = kept(d.groupBy("_k", "_p", "_x").agg(F.count("*").alias("_n")), "phase-rows")
    sizes = d.groupBy("_k").agg(F.sum(F.when(F.col("_p"), F.col("_n")).otherwise(0)).alias("_n1"), F.sum(F.when(F.col("_p"), 0).otherwise(F.col("_n"))).alias("_n0"), F.count("*").alias("_rows"))
    sizes = sizes.filter("_n1 > 0 and _n0 > 0").select("*", F.ceil(F.col("_rows") / block).cast("long").alias("_blocks"), F.monotonically_increasing_id().alias("_id")).withColumnRenamed("_k", "_key")
    sizes = kept(sizes, "phase-sizes")
    # episodes of one block are dealt to groups of about a block's rows, a larger one has groups of its own
    groups = max(math.ceil(d.count() / block), 1)
    group = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("_id"), F.lit(groups))).otherwise(-1 - F.col("_id"))
    dealt = d.join(sizes.hint("merge"), F.col("_k") == F.col("_key")).withColumns({"_at": F.pmod(F.xxhash64("_p", "_x"), F.col("_blocks")), "_g": group}).drop("_k", "_key", "_rows")
    dealt = kept(dealt, "phase-dealt")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    left = dealt.select("_g", F.col("_at").alias("_a"), every.alias("_b"), "_id", "_p", "_x")
    right = dealt.select(F.col("_g").alias("_rg"), every.alias("_ra"), F.col("_at").alias("_rb"), F.col("_id").alias("_rid"), F.col("_p").alias("_rp"), F.col("_x").alias("_rx"), F.col("_n").alias("_rn"))

    def far(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_id": [], "_p": [], "_x": [], "_same": [], "_other": []})
        a, b = a.sort_values("_id", kind="stable"), b.sort_values("_rid", kind="stable")
        x, y = np.stack(a["_x"]), np.stack(b["_rx"])
        n, p, q = b["_rn"].to_numpy(float), a["_p"].to_numpy(bool), b["_rp"].to_numpy(bool)
        one, zero = np.zeros(len(x)), np.zeros(len(x))
        ids, begin = np.unique(a["_id"].to_numpy(), return_index=True)
        known = b["_rid"].to_numpy()
        for at, upto, lo, hi in zip(begin, [*begin[1:], len(x)], np.searchsorted(known, ids), np.searchsorted(known, ids, "right"), strict=True):
            for i in range(at, upto, 256):
                own = slice(i, min(i + 256, upto))
                dist = np.sqrt(((x[own, None] - y[None, lo:hi]) ** 2).sum(-1))
                one[own], zero[own] = dist @ (n * q)[lo:hi], dist @ (n * ~q)[lo:hi]
        return a[["_id", "_p", "_x"]].assign(_same=np.where(p, one, zero), _other=np.where(p, zero, one))

    sums = left.groupBy("_g", "_a", "_b").cogroup(right.groupBy("_rg", "_ra", "_rb")).applyInPandas(far, "_id long, _p boolean, _x array<double>, _same double, _other double")
    sums = sums.groupBy("_id", "_p", "_x").agg(F.sum("_same").alias("_same"), F.sum("_other").alias("_other"))
    back = dealt.select("_id", "_p", "_x", "_n", "_n1", "_n0")
    r = back.join(sums.hint("merge"), ["_id", "_p", "_x"]).withColumns({"_own": F.when(F.col("_p"), F.col("_n1")).otherwise(F.col("_n0")), "_off": F.when(F.col("_p"), F.col("_n0")).otherwise(F.col("_n1"))})
    near, away = F.col("_same") / F.nullif(F.col("_own") - 1, F.lit(0)), F.col("_other") / F.col("_off")
    s = F.coalesce((away - near) / F.nullif(F.greatest(away, near), F.lit(0.0)), F.lit(0.0))
    s = F.when(F.col("_own") > 1, s).otherwise(0.0)
    g = r.groupBy("_id").agg(F.sum("_n").alias("rows"), (F.sum(s * F.col("_n")) / F.sum("_n")).alias("silhouette"))
    return g.join(sizes.hint("merge"), "_id").select(*[F.col(f"_key.{k}").alias(k) for k in keys], "rows", "silhouette")


def slip_trajectory(slips: DataFrame, anchors: DataFrame, keys, t: str, vec: str, anchor: str) -> DataFrame:
    """(keys, slips, grip_rho, cop_rho, drift, pc1_rho, pc2_rho, silhouette) for each key.

    ``slips``: keys, t, grip, cop_y, dcop and ``vec``; ``anchors``: keys and the time at which the second phase begins. The
    map's two components are fitted on z-scored vectors of all slips; their signs, and those of their correlations
    with time, are arbitrary. Slips without a vector are left out. Correlations skip nulls; the silhouette is null
    without an anchor or with all slips on one side of it.
    """
    keys = list(keys)
    own = kept(slips.filter(F.col(vec).isNotNull()).select(*keys, t, "grip", "cop_y", "dcop", vec), "slips")
    m = kept(learn.pca(own, vec).withColumns({"pc1": F.col("map")[0], "pc2": F.col("map")[1]}).select(*keys, t, "grip", "cop_y", "dcop", "pc1", "pc2"), "slip-map")
    out = m.groupBy(*keys).agg(F.count("*").alias("slips"), F.sum("dcop").alias("drift"))
    for x, name in (("grip", "grip_rho"), ("cop_y", "cop_rho"), ("pc1", "pc1_rho"), ("pc2", "pc2_rho")):
        rho = stats.spearman(m.filter(F.col(x).isNotNull() & F.col(t).isNotNull()), keys, x, t).select(*keys, F.col("rho").alias(name))
        out = out.join(rho.hint("merge"), keys, "left")
    phased = m.join(anchors.select(*keys, F.col(anchor).alias("_anchor")).hint("merge"), keys).withColumn("_phase", F.col(t) >= F.col("_anchor"))
    return out.join(phase_silhouette(phased, keys, "_phase", ["pc1", "pc2"]).select(*keys, "silhouette").hint("merge"), keys, "left")
