"""Signatures of exits: what two fingers felt just before and just after one of them let go.

``exit_atoms`` reads the exits from annotation atoms, ``taxel_channels`` reduces taxel forces to channels,
``roughness`` adds the texture of the shear, and ``exit_features`` gives 29 numbers for each exit. Exits
meet samples by an equi-join on bins of the window's length, so an episode of any length spreads over
tasks and a pair is a sample of an exit's own window; all numbers of an exit then come from one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import within
from .intervals import stabbed

# The grammar of exit atoms, of the jaw's travel and of weak spans, and the class of each label.
EXIT_ATOM = r"^\[auto:(\w+)\] (\w+) f(\d)(?: ([\d.]+)s)?(.*)$"
JAW = r"jaw([+-][\d.]+)u"
WEAK = r"weak_contact@([\d.]+)-([\d.]+)s"
CLASSES = {"drop": "loss", "release": "deliberate", "finger_unload": "unload"}
EXIT_FEATURES = (
    "fn_hold_N", "fn_near_N", "fn_last_N", "fn_near_ratio", "fn_slope_near_rel", "unload_80to20_s", "fn_post_N",
    "active_hold", "active_last", "active_slope_near", "copy_travel_near_mm", "copx_travel_near_mm", "cop_speed_near_mm_s",
    "copy_hold_mm", "fs_hold_N", "fs_near_N", "mu_hold", "mu_near", "mu_max_near", "mu_slope_near", "shear_swing_deg",
    "tau_max_near", "tau_hold", "hf_max_near", "hf_hold", "partner_fn_near_N", "partner_fn_post_N", "partner_slope_near_rel",
    "partner_mu_near",
)


@dataclass(frozen=True)
class Reach:
    """Times around an exit, in the clock's unit: hold is [-pre, -near], near [-near, -near_end], last
    [-last, -last_end], post [near_end, post]; unloading counts from -fall."""

    pre: float = 1.0
    post: float = 0.3
    near: float = 0.5
    near_end: float = 0.05
    last: float = 0.2
    last_end: float = 0.02
    fall: float = 0.8

    def times(self, unit: float) -> Reach:
        return Reach(*[v * unit for v in (self.pre, self.post, self.near, self.near_end, self.last, self.last_end, self.fall)])


def exit_atoms(atoms: DataFrame, flags: DataFrame, keys, t: str, content: str, style: str, flag: str, margin: float = 0.05, width: float = 1.0) -> DataFrame:
    """(keys, finger, t, label, conf, jaw, class): the exits among the atoms, without those in a weak span of their keys.

    ``flags``: (keys, flag), any number of spans in one text. Atoms of other styles, labels or grammar go, as do
    those without a time; jaw is null where the content names none. Repeated atoms stay repeated.
    """
    part = lambda k: F.regexp_extract(content, EXIT_ATOM, k)
    jaw = F.nullif(F.regexp_extract(part(5), JAW, 1), F.lit("")).try_cast("double")
    found = atoms.filter((F.col(style) == "interjection") & part(2).isin(*CLASSES) & F.col(t).isNotNull())
    found = found.select(*keys, part(3).cast("int").alias("finger"), F.col(t).cast("double").alias("t"), part(2).alias("label"), part(1).alias("conf"), jaw.alias("jaw"))
    ends = F.explode(F.arrays_zip(F.regexp_extract_all(flag, F.lit(WEAK), 1).alias("a"), F.regexp_extract_all(flag, F.lit(WEAK), 2).alias("b")))
    spans = flags.select(*keys, ends.alias("_s")).select(*keys, (F.col("_s.a").try_cast("double") - margin).alias("_lo"), (F.col("_s.b").try_cast("double") + margin).alias("_hi"))
    out = stabbed(found, spans, keys, "t", "_lo", "_hi", width, "_weak").filter("not _weak").drop("_weak")
    name = F.col("label")
    return out.withColumn("class", F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in CLASSES.items()]))


def seen_losses(exits: DataFrame, seen: DataFrame, keys, t: str = "t", reach: float = 0.03) -> DataFrame:
    """The exits with ``class`` loss where one of ``seen`` (keys, t), known from elsewhere, is nearer than ``reach``."""
    lost = within(exits, seen, keys, t, reach, "left_semi").withColumn("class", F.lit("loss"))
    return lost.unionByName(within(exits, seen, keys, t, reach, "left_anti"))


def _sum(taxels: Column, f) -> Column:
    return F.aggregate(taxels, F.lit(0.0), lambda a, p: a + f(p))


def _moment(taxels: Column, arm: str, f) -> Column:
    """Loads times their arms. Loads with arms of one length are summed first, those on the negative side taken off last, and
    the length multiplies once: on a regular array these are the operations, and the rounding, of the plain formula."""
    lengths = F.array_distinct(F.transform(taxels, lambda q: F.abs(q[arm])))

    def side(a: Column) -> Column:
        ahead = F.aggregate(F.filter(taxels, lambda q: q[arm] == a), F.lit(0.0), lambda s, q: s + f(q))
        return F.aggregate(F.filter(taxels, lambda q: q[arm] == -a), ahead, lambda s, q: s - f(q))

    return F.aggregate(lengths, F.lit(0.0), lambda s, a: s + a * side(a))


def taxel_channels(rows: DataFrame, taxels: str, least: float = 0.2, loaded: float = 0.3) -> DataFrame:
    """The rows with fn, sfx, sfy, fs, active, copx, copy, tau and mu of their taxels (array of x, y, fx, fy, fz).

    Centres of pressure are null, and the spin torque 0, without more than ``least`` pressing; shear over normal
    is null up to ``loaded``. Null taxels give null channels, an empty list zeros without a centre.
    """
    p, press = F.col(taxels), lambda q: F.when(q["fz"] > 0, q["fz"]).otherwise(0.0)
    d = rows.withColumns({
        "fn": _sum(p, lambda q: q["fz"]), "sfx": _sum(p, lambda q: q["fx"]), "sfy": _sum(p, lambda q: q["fy"]),
        "active": _sum(p, lambda q: (q["fz"] > 0).cast("double")), "_m": _sum(p, press), "_mx": _moment(p, "x", press),
        "_my": _moment(p, "y", press), "_spin": _moment(p, "x", lambda q: q["fy"]) - _moment(p, "y", lambda q: q["fx"]),
    })
    d = d.withColumns({"copx": F.when(F.col("_m") > least, F.col("_mx") / F.col("_m")), "copy": F.when(F.col("_m") > least, F.col("_my") / F.col("_m")), "fs": F.sqrt(F.col("sfx") * F.col("sfx") + F.col("sfy") * F.col("sfy"))})
    turn = F.col("_spin") - F.col("copx") * F.col("sfy") + F.col("copy") * F.col("sfx")
    d = d.withColumns({"tau": F.when(F.col("_m") > least, turn).when(F.col("_m").isNotNull(), 0.0), "mu": F.when(F.col("fn") > loaded, F.col("fs") / F.col("fn"))})
    return d.drop("_m", "_mx", "_my", "_spin")


def roughness(rows: DataFrame, keys, order, t: str, x: str = "fs", span: int = 10, out: str = "hf") -> DataFrame:
    """Root of the mean square slope of x over ``span`` rows around each, rows beyond the ends counting 0.

    Slopes are second-order differences on the times as they are, one-sided at the ends, and null (left out)
    where two times are equal or the series has one row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumns({"_h0": F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0)), "_h1": F.nullif(F.lead(t).over(w) - F.col(t), F.lit(0.0)), "_d0": F.col(x) - F.lag(x).over(w), "_d1": F.lead(x).over(w) - F.col(x), "_n": F.lead(F.lit(1)).over(w), "_p": F.lag(F.lit(1)).over(w)})
    back, ahead = F.col("_d0") / F.col("_h0"), F.col("_d1") / F.col("_h1")
    both = (F.col("_h0") * ahead + F.col("_h1") * back) / (F.col("_h0") + F.col("_h1"))
    d = d.withColumn("_g", F.when(F.col("_p").isNull(), ahead).when(F.col("_n").isNull(), back).otherwise(both))
    d = d.withColumn(out, F.sqrt(F.sum(F.col("_g") * F.col("_g")).over(w.rowsBetween(-(span // 2), (span - 1) // 2)) / span))
    return d.drop("_h0", "_h1", "_d0", "_d1", "_n", "_p", "_g")


CHANNELS = ("fn", "fs", "sfx", "sfy", "active", "copx", "copy", "tau", "mu", "hf")


def exit_features(samples: DataFrame, exits: DataFrame, keys, order: str, reach: Reach = Reach()) -> DataFrame:  # noqa: B008
    """The exits with the 29 numbers of EXIT_FEATURES.

    ``samples``: keys, finger (0 or 1), t, ``order`` and CHANNELS; ``exits``: keys, finger, t and what else they have.
    An exit whose window its own finger's series does not cover is left out; repeated exits are one. Means skip
    nulls, slopes need four points, travel more than three; a number without them is null, as are the partner's
    where there is no partner.
    """
    keys = list(keys)
    ends = samples.groupBy(*keys, "finger").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    asked = exits.join(ends, [*keys, "finger"]).filter((F.col("t") - reach.pre >= F.col("_first")) & (F.col("t") + reach.post <= F.col("_last")))
    width = reach.pre + reach.post
    bins = F.explode(F.sequence(F.floor((F.col("t") - reach.pre) / width), F.floor((F.col("t") + reach.post) / width)))
    e = asked.select(F.struct(*exits.columns).alias("_e"), bins.alias("_bin")).distinct()
    s = samples.select(F.struct(*keys).alias("_k"), F.floor(F.col("t") / width).alias("_b"), "finger", "t", F.col(order).alias("_o"), *CHANNELS)
    at, finger = F.col("_e.t"), F.col("_e.finger")
    on = (F.col("_bin") == F.col("_b")) & F.col("t").between(at - reach.pre, at + reach.post) & F.col("finger").isin(finger, 1 - finger)
    for k in keys:
        on = on & (F.col(f"_e.{k}") == F.col(f"_k.{k}"))
    d = e.join(s, on).drop("_k", "_b", "_bin")
    # sums go in the samples' order: a mean that ends in a half must not depend on how rows arrive
    d = d.repartition("_e").sortWithinPartitions("_e", "_o")
    own, t = F.col("finger") == finger, F.col("t")
    hold, near = t.between(at - reach.pre, at - reach.near), t.between(at - reach.near, at - reach.near_end)
    last, post = t.between(at - reach.last, at - reach.last_end), t.between(at + reach.near_end, at + reach.post)
    of = Window.partitionBy("_e")
    d = d.withColumn("_level", F.avg(F.when(own & hold, F.col("fn"))).over(of))
    d = d.withColumn("_t80", F.min(F.when(own & (t > at - reach.fall) & (F.col("fn") <= 0.8 * F.col("_level")), t)).over(of))

    def mean(x, mask, mine=own):
        return F.avg(F.when(mine & mask, F.col(x) if isinstance(x, str) else x))

    def slope(x, mask, mine=own):
        y = F.when(mine & mask, F.col(x))
        return F.when(F.count(y) >= 4, F.regr_slope(y, t - at))

    def top(x, mask):
        return F.max(F.when(own & mask, x))

    def travel(x):
        when = F.when(own & near & F.col(x).isNotNull(), F.struct("t", "_o"))
        return F.when(F.count(when) > 3, F.max_by(x, when) - F.min_by(x, when))

    def over(x, y, floor=0.0):
        return F.when(y > floor, x / y)

    level = F.first("_level")
    unload = F.min(F.when(own & (t >= F.col("_t80")) & (F.col("fn") <= 0.2 * F.col("_level")), t)) - F.first("_t80")
    found = {
        "fn_hold_N": level, "fn_near_N": mean("fn", near), "fn_last_N": mean("fn", last), "fn_near_ratio": over(mean("fn", near), level),
        "fn_slope_near_rel": over(slope("fn", near), level), "unload_80to20_s": unload, "fn_post_N": mean("fn", post),
        "active_hold": mean("active", hold), "active_last": mean("active", last), "active_slope_near": slope("active", near),
        "copy_travel_near_mm": travel("copy"), "copx_travel_near_mm": travel("copx"), "cop_speed_near_mm_s": slope("copy", near),
        "copy_hold_mm": mean("copy", hold), "fs_hold_N": mean("fs", hold), "fs_near_N": mean("fs", near), "mu_hold": mean("mu", hold),
        "mu_near": mean("mu", near), "mu_max_near": top(F.col("mu"), near), "mu_slope_near": slope("mu", near),
        "shear_swing_deg": F.struct(mean("sfx", hold).alias("x0"), mean("sfy", hold).alias("y0"), mean("sfx", last).alias("x1"), mean("sfy", last).alias("y1")),
        "tau_max_near": top(F.abs("tau"), near), "tau_hold": mean(F.abs("tau"), hold), "hf_max_near": top(F.col("hf"), near), "hf_hold": mean("hf", hold),
        "partner_fn_near_N": mean("fn", near, ~own), "partner_fn_post_N": mean("fn", post, ~own),
        "partner_slope_near_rel": over(slope("fn", near, ~own), mean("fn", hold, ~own), 0.3), "partner_mu_near": mean("mu", near, ~own),
    }
    d = d.groupBy("_e").agg(*[x.alias(k) for k, x in found.items()])

    def heading(k: str) -> Column:
        x, y = F.col(f"shear_swing_deg.x{k}"), F.col(f"shear_swing_deg.y{k}")
        return F.when(F.hypot(x, y) > 0.05, F.degrees(F.atan2(y, x)))

    swing = F.abs(F.pmod(heading("0") - heading("1") + 180, F.lit(360.0)) - 180)
    return d.withColumn("shear_swing_deg", swing).select("_e.*", *EXIT_FEATURES)
