"""A hand of several fingers: from finger events to bouts, attempts, cleaned places, honest names and records.

Events are rows (key, finger, seq, label, start, end, conf); ``seq`` orders events of one start. Samples are
(key, finger, t, fn, raw), the jaw (key, t, pos). Every pass is windows and equi-joins; extremes over
intervals come from dyadic blocks (``intervals``), so an episode of any length is spread over tasks. Two
folds whose state is a few numbers (which place a finger is in, who holds) run over rows sorted inside
partitions, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, intervals
from .tables import kept

START = Window.unboundedPreceding
EVENT = ["finger", "seq", "label", "start", "end", "conf"]


@dataclass(frozen=True)
class Hand:
    """Limits of the passes; times in the unit of t, forces and jaw travel in those of the data."""

    bout_gap: float = 0.5
    reach: float = 0.05
    hand_loss: float = 1.0
    quiet_s: float = 0.35
    retry_s: float = 2.5
    retry_rise: float = 10.0
    through: float = 8.0
    held_peak: float = 5.0
    weak_peak: float = 2.3
    air_close: float = 2.0
    air_reach: float = 0.3
    digits: int = 1
    span_reach: float = 0.1
    late_place: float = 1.5
    terminal_reach: float = 0.25
    still_s: float = 1.0
    jaw_reach: float = 0.3
    jaw_open: float = 1.0
    plateau_s: float = 1.0
    settle_s: float = 0.2
    recovered: float = 0.25
    carried_s: float = 1.5
    task_reach: float = 0.2
    hand_reach: float = 0.3
    residual_s: float = 0.5
    block_s: float = 5.0

    def short(self, c: Column) -> Column:
        """A time as flags print it: identity of spans is at this resolution."""
        return F.round(c, self.digits)


def terminal(label: str = "label") -> Column:
    return F.col(label).isin("release", "drop")


def _in_order(key: str) -> Window:
    return Window.partitionBy(key, "finger").orderBy("start", "seq")


def folded(df: DataFrame, keys: list[str], order: list[str], start, step, out: str, kind: str, reads=None) -> DataFrame:
    """The rows with ``out`` from a fold over each key's rows in order: ``step(state, row) -> value`` changes
    the state that ``start()`` gives; ``reads``: the columns that it looks at, if not all. Rows are sorted inside partitions and come in batches; only one
    key's state is held."""
    d = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in frames:
            values = []
            for row in (b if reads is None else b.select([*keys, *[c for c in reads if c not in keys]])).to_pylist():
                here = tuple(row[k] for k in keys)
                if state is None or here != now:
                    now, state = here, start()
                values.append(step(state, row))
            yield b.append_column(out, pa.array(values, pa.from_numpy_dtype("bool") if kind == "boolean" else pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    return d.mapInArrow(run, f"{fields}, `{out}` {kind}")


# --- spans, bouts and the grasp ---


def with_opening(events: DataFrame, key: str) -> DataFrame:
    """``opened``: for a terminal the first onset of its finger since the terminal before it."""
    d = events.withColumn("_g", F.coalesce(F.sum(terminal().cast("int")).over(_in_order(key).rowsBetween(START, -1)), F.lit(0)))
    return d.withColumn("opened", F.min(F.when(F.col("label") == "contact_onset", F.col("start"))).over(Window.partitionBy(key, "finger", "_g"))).drop("_g")


def finger_spans(events: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, finger, start, end): from an onset to the next terminal of the finger, an open one to the
    episode's end. ``lengths``: (key, length)."""
    g = F.coalesce(F.sum(terminal().cast("int")).over(_in_order(key).rowsBetween(START, -1)), F.lit(0))
    d = events.withColumn("_g", g).groupBy(key, "finger", "_g").agg(F.min(F.when(F.col("label") == "contact_onset", F.col("start"))).alias("s"), F.min(F.when(terminal(), F.col("start"))).alias("e"))
    d = d.filter("s is not null").join(lengths.select(key, "length"), key)
    return d.select(key, "finger", F.col("s").alias("start"), F.coalesce("e", "length").alias("end"))


def hand_bouts(spans: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """(key, bout, start, end, finger): finger spans joined where they overlap or nearly touch; ``finger`` is null
    where several took part."""
    w = Window.partitionBy(key).orderBy("start", "end", "finger")
    far = F.max("end").over(w.rowsBetween(START, -1))
    d = spans.withColumn("_n", F.when(F.col("start") <= far + rules.bout_gap, 0).otherwise(1)).withColumn("bout", F.sum("_n").over(w.rowsBetween(START, 0)))
    return d.groupBy(key, "bout").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.when(F.min("finger") == F.max("finger"), F.min("finger")).alias("finger"))


def grasp_bout(bouts: DataFrame, events: DataFrame, key: str, slack: float = 1e-6) -> DataFrame:
    """(key, grasp_bout, grasp_start, grasp_end): the bout that holds the last stable grasp, else the last bout."""
    last = events.filter("label = 'grasp_stable'").groupBy(key).agg(F.max("start").alias("_stable"))
    d = bouts.join(last, key, "left")
    holds = F.coalesce(F.col("_stable").between(F.col("start") - slack, F.col("end") + slack), F.lit(False))
    first = F.min(F.when(holds, F.struct("bout", "start", "end")))
    g = d.groupBy(key).agg(F.coalesce(first, F.max(F.struct("bout", "start", "end"))).alias("g"))
    return g.select(key, F.col("g.bout").alias("grasp_bout"), F.col("g.start").alias("grasp_start"), F.col("g.end").alias("grasp_end"))


# --- attempts ---


def jaw_at(rows: DataFrame, jaw: DataFrame, key: str, at: Column, out: str) -> DataFrame:
    """The jaw position held at a time; before the first sample the first one."""
    d = rows.withColumn("t", at)
    return asof.backward(d, jaw.select(key, "t", "pos"), [key], "t", "pos", out, clamp=True).drop("t")


def named_attempts(spans: DataFrame, jaw: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """``kind`` of spans (key, start, end, finger, peak): air_grasp where the jaw closed on itself,
    weak_contact under the weak peak, else failed_attempt."""
    d = spans.withColumns({"_a": F.col("start") - rules.air_reach, "_z": F.col("end") + rules.air_reach})
    d = intervals.extremes(d, jaw, [key], "_a", "_z", "t", "pos", rules.block_s, "_jaw_")
    kind = F.when(F.col("_jaw_least") < rules.air_close, "air_grasp").when(F.col("peak") < rules.weak_peak, "weak_contact").otherwise("failed_attempt")
    return d.withColumn("kind", kind).select(key, "kind", "start", "end", "finger", "peak")


def early_attempts(bouts: DataFrame, grasp: DataFrame, samples: DataFrame, jaw: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """The bouts before the grasp's: each is a trial that failed. Its peak is the hand's greatest raw force."""
    d = bouts.join(grasp.select(key, "grasp_bout"), key).filter("bout < grasp_bout")
    d = d.withColumns({"_a": F.col("start") - rules.reach, "_z": F.col("end") + rules.reach})
    d = intervals.extremes(d, samples, [key], "_a", "_z", "t", "raw", rules.block_s)
    return named_attempts(d.withColumn("peak", F.greatest(F.coalesce("greatest", F.lit(0.0)), F.lit(0.0))), jaw, key, rules)


def in_bout_attempts(events: DataFrame, samples: DataFrame, jaw: DataFrame, grasp: DataFrame, key: str, rules: Hand = Hand(), slack: float = 1e-6) -> DataFrame:
    """Attempts hidden inside the grasp's bout: spans of a finger that end in a drop before the last release,
    where the whole hand then goes quiet, and the loss is acted on: the jaw reopens, or it closes well
    past the width at which this finger had held with a real load."""
    d = with_opening(events, key)
    d = d.withColumn("_stable", F.max(F.when(F.col("label") == "grasp_stable", F.col("start"))).over(Window.partitionBy(key, "finger").orderBy("start").rangeBetween(START, 0)))
    d = d.withColumn("_last", F.max(F.when(F.col("label") == "release", F.col("start"))).over(Window.partitionBy(key)))
    d = d.filter("label = 'drop' and opened is not null").join(grasp, key)
    d = d.filter((F.col("opened") >= F.col("grasp_start") - slack) & (F.col("start") <= F.col("grasp_end") + slack) & F.coalesce(F.col("start") < F.col("_last") - slack, F.lit(True)))
    d = d.select(key, "finger", "seq", F.col("opened").alias("start"), F.col("start").alias("end"), F.when(F.col("_stable") >= F.col("opened") - slack, F.col("_stable")).alias("_stable"))
    # the hand: all fingers' forces of one time together
    hand = kept(samples.groupBy(key, "t").agg(F.sum("fn").alias("force")), "force")
    d = intervals.extremes(d.withColumn("_q", F.col("end") + rules.quiet_s), hand, [key], "end", "_q", "t", "force", rules.block_s, "_hand_")
    d = d.join(hand.groupBy(key).agg(F.max("t").alias("_over")), key).filter(F.coalesce(F.col("_hand_greatest") < rules.hand_loss, F.lit(True)) & (F.col("_over") > F.col("_q")))
    d = intervals.extremes(d.withColumn("_w", F.col("end") + rules.retry_s), jaw, [key], "end", "_w", "t", "pos", rules.block_s, "_jaw_", open_start=True)
    d = d.withColumns({"_a": F.col("start") - rules.reach, "_z": F.col("end") + rules.reach})
    d = intervals.extremes(d, samples, [key, "finger"], "_a", "_z", "t", "raw", rules.block_s, "_own_").withColumn("peak", F.greatest(F.coalesce("_own_greatest", F.lit(0.0)), F.lit(0.0)))
    d = jaw_at(jaw_at(d, jaw, key, F.col("end"), "_base"), jaw, key, F.coalesce("_stable", "end"), "_hold")
    reopened = F.coalesce(F.col("_jaw_greatest") - F.col("_base") >= rules.retry_rise, F.lit(False))
    through = F.col("_stable").isNotNull() & (F.col("peak") >= rules.held_peak) & F.coalesce(F.col("_jaw_least") <= F.col("_hold") - rules.through, F.lit(False))
    return named_attempts(d.filter(reopened | through).select(key, "start", "end", "finger", "peak"), jaw, key, rules)


def without_same_spans(spans: DataFrame, known: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """Spans that no known one equals as printed; of several equal ones the least finger's."""
    a, b = rules.short(F.col("start")), rules.short(F.col("end"))
    d = spans.withColumns({"_a": a, "_b": b})
    d = d.join(known.select(key, a.alias("_a"), b.alias("_b")).distinct(), [key, "_a", "_b"], "left_anti")
    w = Window.partitionBy(key, "_a", "_b").orderBy("finger", "start", "end")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_a", "_b", "_r").select(spans.columns)


def failure_override(stages: DataFrame, events: DataFrame, spans: DataFrame, lengths: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """Stages (key, label, start, end); an episode without a release whose last drop lies in a failed
    attempt never completed a task: one approach over its whole length."""
    ends = events.groupBy(key).agg(F.count_if(F.col("label") == "release").alias("_r"), F.max(F.when(F.col("label") == "drop", F.col("start"))).alias("_d")).filter("_r = 0 and _d is not null")
    failed = spans.filter("kind = 'failed_attempt'").select(key, (rules.short(F.col("start")) - rules.reach).alias("_s"), (rules.short(F.col("end")) + rules.reach).alias("_e"))
    lost = ends.join(failed, key).filter(F.col("_d").between(F.col("_s"), F.col("_e"))).select(key).distinct()
    many = stages.groupBy(key).count().filter("count > 1").select(key)
    lost = lost.join(many, key, "left_semi")
    whole = lost.join(lengths, key).select(key, F.lit("approach").alias("label"), F.lit(0.0).alias("start"), F.col("length").alias("end"))
    return stages.join(lost, key, "left_anti").select(key, "label", "start", "end").unionByName(whole)


# --- places ---

#: What a place is deleted for, in the order in which the rules are asked.
PLACE_RULES = ["duplicate", "air_grasp", "after_task", "before_grasp", "then_drop", "jaw_closed", "recovered"]


def place_hygiene(events: DataFrame, samples: DataFrame, jaw: DataFrame, grasp: DataFrame, anchors: DataFrame, spans: DataFrame, key: str, rules: Hand = Hand(), slack: float = 1e-6) -> DataFrame:
    """(key, finger, seq, start, end, rule): every place, and why it goes (null: it stays).

    First the places of a finger that overlap the one before them that stayed; the rest in turn where it lies
    in an air grasp, starts long after the place_release anchor, ends before the grasp, is followed by a
    drop, happens with the jaw closed while the hold goes on, or the load recovers. ``anchors``:
    (key, place_release); a missing anchor, grasp or next terminal lets its rules pass.
    """

    def step(state: dict, row: dict) -> bool:
        if state["end"] is not None and row["start"] <= state["end"] + slack:
            return True
        state["end"] = row["end"]
        return False

    own = [key, "finger", "seq", "start", "end"]
    places = folded(events.filter("label = 'place'").select(own), [key, "finger"], ["start", "end", "seq"], lambda: {"end": None}, step, "duplicate", "boolean", ["start", "end"])
    air = spans.filter("kind = 'air_grasp'").select(key, (rules.short(F.col("start")) - rules.span_reach).alias("_s"), (rules.short(F.col("end")) + rules.span_reach).alias("_e"))
    p = intervals.stabbed(places, air, [key], "start", "_s", "_e", rules.block_s, "_air")
    p = p.join(anchors.select(key, "place_release"), key, "left").join(grasp.select(key, "grasp_start"), key, "left")
    # the finger's next terminal from a little before the place's end on: the last one in descending order
    ends = events.filter(terminal()).select(key, "finger", (-F.col("start")).alias("t"), F.struct((-F.col("seq")).alias("order"), "label", "start").alias("x"))
    p = asof.backward(p.withColumn("t", -(F.col("end") - rules.terminal_reach)), ends, [key, "finger"], "t", "x", "next").drop("t")
    p = jaw_at(jaw_at(p, jaw, key, F.col("end") + rules.jaw_reach, "_after"), jaw, key, F.col("start") - rules.jaw_reach, "_before")
    p = p.join(samples.groupBy(key).agg(F.max("t").alias("_over")), key, "left").withColumn("_term", F.coalesce("next.start", "_over"))
    p = p.withColumns({"_a": F.col("start") - rules.plateau_s, "_b": F.col("end") + rules.settle_s})
    p = intervals.extremes(p, samples, [key, "finger"], "_a", "start", "t", "fn", rules.block_s, "_held_")
    p = intervals.extremes(p, samples, [key, "finger"], "_b", "_term", "t", "fn", rules.block_s, "_rest_")
    moved = F.coalesce(F.col("_after") - F.col("_before"), F.lit(0.0))
    still = F.col("_after").isNotNull() & (F.col("next.start") - F.col("end") >= rules.still_s) & (moved < rules.jaw_open)
    back = (F.col("_held_greatest") > 0) & (F.greatest(F.col("_rest_greatest"), F.lit(0.0)) >= rules.recovered * F.col("_held_greatest")) & (F.col("_term") - F.col("end") > rules.carried_s)
    why = [F.col("duplicate"), F.col("_air"), F.col("start") > F.col("place_release") + rules.late_place, F.col("end") < F.col("grasp_start") - slack, F.col("next.label") == "drop", still, back]
    rule = F.coalesce(*[F.when(c, F.lit(name)) for c, name in zip(why, PLACE_RULES, strict=True)])
    return p.select(*own, rule.alias("rule"))


# --- after the task, and honest names ---


def post_task(events: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """The events with ``phantom`` (confidence low): a finger's new contact, and all it brings, after the
    terminal that followed its last place; ``span_start`` and ``span_end`` of that contact."""
    w = Window.partitionBy(key, "finger")
    at = F.struct("start", "seq")
    d = events.withColumn("_p", F.max(F.when(F.col("label") == "place", F.struct("start", "seq", "end"))).over(w))
    d = d.withColumn("_d", F.min(F.when(terminal() & (F.col("start") >= F.col("_p.end") - rules.task_reach), F.col("start"))).over(w))
    d = d.withColumn("_o", F.min(F.when((F.col("label") == "contact_onset") & (F.col("start") > F.col("_d")), at)).over(w))
    d = d.withColumn("phantom", F.coalesce((F.col("start") > F.col("_d")) & (at >= F.col("_o")), F.lit(False)))
    d = d.withColumn("span_end", F.max(F.when(F.col("phantom"), F.col("end"))).over(w)).withColumn("span_start", F.col("_o.start"))
    return d.withColumn("conf", F.when(F.col("phantom"), "low").otherwise(F.col("conf"))).drop("_p", "_d", "_o")


def post_task_spans(judged: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, end, finger, peak): one span for each finger with a contact after its task."""
    d = judged.filter("phantom").groupBy(key, "finger").agg(F.min("span_start").alias("start"), F.max("span_end").alias("end"))
    return d.select(key, F.lit("post_task_contact").alias("kind"), "start", "end", "finger", F.lit(None).cast("double").alias("peak"))


def renamed(judged: DataFrame, anchors: DataFrame, spans: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """Events of ``post_task`` under the names that the whole hand gives them, with ``was``, the old one.

    Phantoms come first. The hand's release is the first at or after the place_release anchor. A release
    before it while a partner holds is a finger_unload, and then no exit for the partner's own test:
    which fingers hold is state that one finger's events pass to the next. A terminal well after it whose
    contact is older is a sensor_residual, and so is a place of such a finger from then on. Nothing
    inside an air grasp is renamed, nor anything without an anchor.
    """
    d = judged.withColumn("was", F.col("label")).withColumn("label", F.when(F.col("phantom"), "phantom").otherwise(F.col("label")))
    d = d.join(anchors.select(key, "place_release"), key, "left")
    hand = F.min(F.when((F.col("label") == "release") & (F.col("start") >= F.col("place_release") - rules.hand_reach), F.struct("start", "seq", "finger"))).over(Window.partitionBy(key))
    d = d.withColumn("_hand", hand)
    air = spans.filter("kind = 'air_grasp'").select(key, (rules.short(F.col("start")) - rules.span_reach).alias("_s"), (rules.short(F.col("end")) + rules.span_reach).alias("_e"))
    d = intervals.stabbed(d, air, [key], "start", "_s", "_e", rules.block_s, "_air")
    d = d.withColumns({"_at": F.col("_hand.start"), "_is": F.coalesce((F.col("_hand.seq") == F.col("seq")) & (F.col("_hand.finger") == F.col("finger")) & (F.col("_hand.start") == F.col("start")), F.lit(False))}).drop("_hand")
    early, late = rules.hand_reach, rules.residual_s

    def start() -> dict:
        return {"now": None, "wait": [], "on": {}, "off": {}}

    def step(s: dict, row: dict) -> str | None:
        t, finger, label, hand_at = row["start"], row["finger"], row["label"], row["_at"]
        if s["now"] is None or t > s["now"]:  # only what is strictly earlier counts
            for where, f, at in s["wait"]:
                s[where][f] = at
            s["now"], s["wait"] = t, []
        new = None
        if hand_at is not None and not row["_air"] and label in ("release", "drop"):
            if label == "release" and t < hand_at - early:
                on = max((v for f, v in s["on"].items() if f != finger), default=-1.0)
                off = max((v for f, v in s["off"].items() if f != finger), default=-1.0)
                new = "finger_unload" if on >= 0 and on > off else None
            elif not row["_is"] and t > hand_at + late and 0 <= s["on"].get(finger, -1.0) <= hand_at:
                new = "sensor_residual"
        label = new or label
        if label == "contact_onset":
            s["wait"].append(("on", finger, t))
        elif label in ("release", "drop"):
            s["wait"].append(("off", finger, t))
        return new

    d = folded(d, [key], ["start", "seq", "finger"], start, step, "_new", "string", ["start", "finger", "label", "_at", "_is", "_air"])
    d = d.withColumn("label", F.coalesce("_new", "label"))
    residual = F.max((F.col("label") == "sensor_residual").cast("int")).over(Window.partitionBy(key, "finger")) == 1
    placed = (F.col("label") == "place") & residual & (F.col("start") >= F.col("_at") - rules.reach)
    d = d.withColumn("label", F.when(F.coalesce(placed, F.lit(False)), "sensor_residual").otherwise(F.col("label")))
    info = F.when(F.col("label") == "phantom", F.concat(F.lit("was "), "was")).when(F.col("label") == "finger_unload", "hand still holding").when(F.col("label") == "sensor_residual", "sensor not re-zeroed")
    return d.withColumn("info", info).drop("_new", "_air", "_at", "_is", "place_release")


def recorded(events: DataFrame, spans: DataFrame, key: str, rules: Hand = Hand()) -> DataFrame:
    """The events that are recorded. Phantoms and residuals are not; a weak contact takes all events of its
    finger inside it, a contact after the task only those of low confidence; a span without a finger
    covers all fingers. Edges are as printed, with a little reach."""
    own = events.filter("label not in ('phantom', 'sensor_residual')")
    s = spans.select(key, "kind", "finger", (rules.short(F.col("start")) - rules.reach).alias("_s"), (rules.short(F.col("end")) + rules.reach).alias("_e"))
    inside = lambda d, kind, out: intervals.stabbed(d, s.filter(F.col("kind") == kind), [key], "start", "_s", "_e", rules.block_s, out, wild="finger")
    d = inside(inside(own, "weak_contact", "_weak"), "post_task_contact", "_post")
    return d.filter(~F.col("_weak") & ~(F.col("_post") & F.coalesce(F.col("conf") == "low", F.lit(False)))).drop("_weak", "_post")


# --- all of it ---


@dataclass
class Story:
    """What the interpretation of a table of episodes gives."""

    events: DataFrame
    spans: DataFrame
    stages: DataFrame
    places: DataFrame


def interpret(events: DataFrame, samples: DataFrame, jaw: DataFrame, anchors: DataFrame, key: str, rules: Hand = Hand(), full: bool = True) -> Story:
    """The passes in their order. ``anchors``: (key, length, stages), stages being an array of (label, start, end).

    ``full`` is a choice of the plan: in base mode (false) places are cleaned, for which the air grasps are
    needed, but nothing is renamed and no span leaves.
    """
    judged = post_task(events, key, rules) if full else events.withColumns({"phantom": F.lit(False), "span_start": F.lit(None).cast("double"), "span_end": F.lit(None).cast("double")})
    judged = kept(judged, "judged")
    bouts = kept(hand_bouts(finger_spans(judged, anchors, key), key, rules), "bouts")
    grasp = kept(grasp_bout(bouts, judged, key), "grasp")
    early = early_attempts(bouts, grasp, samples, jaw, key, rules)
    inner = without_same_spans(in_bout_attempts(judged, samples, jaw, grasp, key, rules), early, key, rules)
    spans = early.unionByName(inner)
    if full:
        spans = spans.unionByName(post_task_spans(judged, key))
    spans = kept(spans, "spans")
    stages = anchors.select(key, F.inline("stages")).select(key, "label", "start", "end")
    if full:
        stages = failure_override(stages, judged, spans, anchors, key, rules)
    stages = kept(stages, "stages")
    # an episode that the override made one approach has no anchor left
    anchors = anchors.select(key, "length").join(stages.filter("label = 'place_release'").groupBy(key).agg(F.min("start").alias("place_release")), key, "left")
    places = place_hygiene(judged, samples, jaw, grasp, anchors, spans, key, rules)
    gone = places.filter("rule is not null").select(key, "finger", "seq", "start")
    named = renamed(judged, anchors, spans, key, rules) if full else judged.withColumns({"was": F.col("label"), "info": F.lit(None).cast("string")})
    final = named.join(gone, [key, "finger", "seq", "start"], "left_anti").drop("span_start", "span_end")
    return Story(final, spans if full else spans.limit(0), stages, places)
