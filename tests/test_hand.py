"""The hand's passes against plain loops on random episodes, and the recording rules on known cases."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import hand, intervals

RULES = hand.Hand()
LABELS = ["contact_onset", "grasp_stable", "place", "release", "drop", "slip"]
EVENT = "episode long, finger int, seq long, label string, start double, end double, conf string"
SPAN = "episode long, kind string, start double, end double, finger int, peak double"


def episode(rng, key, fingers=2):
    """Random events, samples on a grid of 0.05 s with loads and quiet stretches, and a jaw that wanders."""
    events, t = [], 0.0
    for seq in range(rng.randint(0, 40)):
        t += rng.choice([0.0, 0.1, 0.25, 0.4, 1.0, 2.0])
        label = rng.choices(LABELS, [5, 3, 2, 2 if key % 3 else 0, 3, 1])[0]
        events.append((key, rng.randrange(fingers), seq, label, round(t, 3), round(t + (rng.choice([0.1, 0.4, 1.2]) if label == "place" else 0.0), 3), rng.choice(["low", "medium", "high"])))
    steps = int((t + 5) / 0.05)
    samples, jaw, pos, load = [], [], 30.0, [0.0] * fingers
    quiet = [e[4] for e in events if e[3] == "drop" and rng.random() < 0.7]
    for i in range(steps):
        at = round(i * 0.05, 3)
        for f in range(fingers):
            if rng.random() < 0.08:
                load[f] = rng.choice([0.0, 0.0, 0.3, 1.5, 6.0, 20.0])
            held = 0.0 if any(q <= at <= q + 0.5 for q in quiet) else load[f]
            samples.append((key, f, at, held, held * 1.1))
        if rng.random() < 0.1:
            pos = rng.choice([0.5, 10.0, 20.0, 30.0, 45.0])
        jaw.append((key, at, pos))
    return events, samples, jaw


class Plain:
    """One episode, worked through row by row."""

    def __init__(self, events, samples, jaw):
        self.events = sorted(events, key=lambda e: (e[4], e[2]))
        self.samples, self.jaw = samples, jaw
        self.length = max((s[2] for s in samples), default=0.0)

    def jaw_at(self, t):
        held = [p for _, at, p in self.jaw if at <= t]
        return held[-1] if held else self.jaw[0][2]

    def force(self, a, b, finger=None, raw=False):
        return [s[4 if raw else 3] for s in self.samples if a <= s[2] <= b and finger in (None, s[1])]

    def bouts(self):
        spans = []
        for f in {e[1] for e in self.events}:
            open_at = None
            for e in (e for e in self.events if e[1] == f):
                if e[3] == "contact_onset" and open_at is None:
                    open_at = e[4]
                elif e[3] in ("release", "drop") and open_at is not None:
                    spans.append((open_at, e[4], f))
                    open_at = None
            if open_at is not None:
                spans.append((open_at, self.length, f))
        out = []
        for s, e, f in sorted(spans):
            if out and s <= out[-1][1] + RULES.bout_gap:
                out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] | {f})
            else:
                out.append((s, e, {f}))
        return out

    def grasp(self):
        bouts, stable = self.bouts(), [e[4] for e in self.events if e[3] == "grasp_stable"]
        if not bouts:
            return None
        holding = [b for b in bouts if stable and b[0] - 1e-6 <= stable[-1] <= b[1] + 1e-6]
        return (holding or bouts[-1:])[0]

    def kind(self, s, e, peak):
        low = min((p for _, t, p in self.jaw if s - RULES.air_reach <= t <= e + RULES.air_reach), default=None)
        return "air_grasp" if low is not None and low < RULES.air_close else "weak_contact" if peak < RULES.weak_peak else "failed_attempt"

    def early(self):
        out, g = [], self.grasp()
        for b in self.bouts():
            if b == g:
                break
            peak = max([0.0, *self.force(b[0] - RULES.reach, b[1] + RULES.reach, raw=True)])
            out.append((self.kind(*b[:2], peak), b[0], b[1], min(b[2]) if len(b[2]) == 1 else None, peak))
        return out

    def inner(self):
        out, g = [], self.grasp()
        releases = [e[4] for e in self.events if e[3] == "release"]
        for f in sorted({e[1] for e in self.events}):
            open_at = None
            for e in (e for e in self.events if e[1] == f):
                if e[3] == "contact_onset":
                    open_at = e[4] if open_at is None else open_at
                    continue
                if e[3] not in ("release", "drop"):
                    continue
                s, open_at, t = open_at, None, e[4]
                if s is None or e[3] != "drop" or s < g[0] - 1e-6 or t > g[1] + 1e-6 or (releases and t >= releases[-1] - 1e-6):
                    continue
                times = sorted({x[2] for x in self.samples if t <= x[2] <= t + RULES.quiet_s})
                if any(sum(x[3] for x in self.samples if x[2] == at) >= RULES.hand_loss for at in times) or not self.length > t + RULES.quiet_s:
                    continue
                peak = max([0.0, *self.force(s - RULES.reach, t + RULES.reach, f, raw=True)])
                ahead = [p for _, at, p in self.jaw if t < at <= t + RULES.retry_s]
                reopened = any(p - self.jaw_at(t) >= RULES.retry_rise for p in ahead)
                stable = [x[4] for x in self.events if x[1] == f and x[3] == "grasp_stable" and s - 1e-6 <= x[4] <= t]
                through = bool(stable) and peak >= RULES.held_peak and any(p <= self.jaw_at(stable[-1]) - RULES.through for p in ahead)
                if reopened or through:
                    out.append((self.kind(s, t, peak), s, t, f, peak))
        return out

    def places(self, spans, release_at):
        out, g = [], self.grasp()
        air = [(round(s[1], 1) - RULES.span_reach, round(s[2], 1) + RULES.span_reach) for s in spans if s[0] == "air_grasp"]
        for f in {e[1] for e in self.events}:
            upto = None
            for p in sorted((e for e in self.events if e[1] == f and e[3] == "place"), key=lambda e: (e[4], e[5], e[2])):
                s, e = p[4:6]
                if upto is not None and s <= upto + 1e-6:
                    out.append((p[2], "duplicate"))
                    continue
                upto = e
                after = [x for x in self.events if x[1] == f and x[3] in ("release", "drop") and x[4] >= e - RULES.terminal_reach]
                after.sort(key=lambda x: (x[4], x[2]))
                end = after[0][4] if after else self.length
                held, rest = max([0.0, *self.force(s - 1.0, s, f)]), max([0.0, *self.force(e + 0.2, end, f)])
                rule = None
                if any(a <= s <= b for a, b in air):
                    rule = "air_grasp"
                elif release_at is not None and s > release_at + RULES.late_place:
                    rule = "after_task"
                elif g and e < g[0] - 1e-6:
                    rule = "before_grasp"
                elif after and after[0][3] == "drop":
                    rule = "then_drop"
                elif after and after[0][4] - e >= 1.0 and self.jaw_at(e + 0.3) - self.jaw_at(s - 0.3) < 1.0:
                    rule = "jaw_closed"
                elif held > 0 and rest >= 0.25 * held and end - e > 1.5:
                    rule = "recovered"
                out.append((p[2], rule))
        return sorted(out)

    def phantoms(self):
        gone = set()
        for f in {e[1] for e in self.events}:
            own = [e for e in self.events if e[1] == f]
            last = [e[5] for e in own if e[3] == "place"][-1:]
            done = [e[4] for e in own if last and e[3] in ("release", "drop") and e[4] >= last[0] - RULES.task_reach][:1]
            opened = False
            for e in own:
                if done and e[4] > done[0]:
                    opened |= e[3] == "contact_onset"
                    gone |= {e[2]} if opened else set()
        return gone

    def names(self, spans, release_at):
        phantom = self.phantoms()
        label = {e[2]: "phantom" if e[2] in phantom else e[3] for e in self.events}
        hand_ = next((e for e in self.events if release_at is not None and label[e[2]] == "release" and e[4] >= release_at - RULES.hand_reach), None)
        if hand_ is None:
            return label
        air = [(round(s[1], 1) - RULES.span_reach, round(s[2], 1) + RULES.span_reach) for s in spans if s[0] == "air_grasp"]
        for e in self.events:
            f, t = e[1], e[4]
            if any(a <= t <= b for a, b in air):
                continue
            if label[e[2]] == "release" and t < hand_[4] - RULES.hand_reach:
                on = max([-1.0, *(c[4] for c in self.events if c[1] != f and c[4] < t and label[c[2]] == "contact_onset")])
                off = max([-1.0, *(c[4] for c in self.events if c[1] != f and c[4] < t and label[c[2]] in ("release", "drop"))])
                if on >= 0 and on > off:
                    label[e[2]] = "finger_unload"
            elif label[e[2]] in ("release", "drop") and e is not hand_ and t > hand_[4] + RULES.residual_s:
                own = max([-1.0, *(c[4] for c in self.events if c[1] == f and c[4] < t and label[c[2]] == "contact_onset")])
                if 0 <= own <= hand_[4]:
                    label[e[2]] = "sensor_residual"
        residual = {e[1] for e in self.events if label[e[2]] == "sensor_residual"}
        for e in self.events:
            if label[e[2]] == "place" and e[1] in residual and e[4] >= hand_[4] - RULES.reach:
                label[e[2]] = "sensor_residual"
        return label


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    data = {k: episode(rng, k, 2 + k % 2) for k in range(80)}
    flat = [[r for d in data.values() for r in d[i]] for i in range(3)]
    kinds = [EVENT, "episode long, finger int, t double, fn double, raw double", "episode long, t double, pos double"]
    return {k: Plain(*d) for k, d in data.items()}, [spark.createDataFrame(r, kind).cache() for r, kind in zip(flat, kinds, strict=True)]


@pytest.fixture(scope="module")
def found(spark, world):
    """The passes of Spark on the random episodes, in order."""
    plain, (events, samples, jaw) = world
    ends = spark.createDataFrame([(k, p.length, 0.6 * p.length) for k, p in plain.items()], "episode long, length double, place_release double")
    bouts = hand.hand_bouts(hand.finger_spans(events, ends, "episode"), "episode", RULES).cache()
    grasp = hand.grasp_bout(bouts, events, "episode").cache()
    early = hand.early_attempts(bouts, grasp, samples, jaw, "episode", RULES).cache()
    inner = hand.in_bout_attempts(events, samples, jaw, grasp, "episode", RULES).cache()
    spans = early.unionByName(hand.without_same_spans(inner, early, "episode", RULES)).cache()
    return {"ends": ends, "bouts": bouts, "grasp": grasp, "early": early, "inner": inner, "spans": spans}


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def spans_of(plain, k):
    known = {(round(s[1], 1), round(s[2], 1)) for s in plain.early()}
    out = list(plain.early())
    for s in sorted(plain.inner(), key=lambda s: (s[3], s[1], s[2])):
        if (round(s[1], 1), round(s[2], 1)) not in known:
            known.add((round(s[1], 1), round(s[2], 1)))
            out.append(s)
    return out


def test_bouts_and_attempts(world, found):
    plain, _ = world
    assert rows(found["bouts"], "episode", "start", "end", "finger") == sorted(((k, s, e, min(f) if len(f) == 1 else None) for k, p in plain.items() for s, e, f in p.bouts()), key=repr)
    for name in ("early", "inner"):
        want = sorted(((k, *s) for k, p in plain.items() for s in getattr(p, name)()), key=repr)
        assert rows(found[name], "episode", "kind", "start", "end", "finger", "peak") == want
        assert len(want) > 5
    assert {r[1] for r in rows(found["inner"], "episode", "kind")} >= {"air_grasp", "failed_attempt"}


def test_place_hygiene(world, found):
    plain, (events, samples, jaw) = world
    got = hand.place_hygiene(events, samples, jaw, found["grasp"], found["ends"], found["spans"], "episode", RULES)
    want = sorted(((k, *r) for k, p in plain.items() for r in p.places(spans_of(p, k), 0.6 * p.length)), key=repr)
    assert rows(got, "episode", "seq", "rule") == want
    assert {r[2] for r in want} == {None, *hand.PLACE_RULES}


def test_names_across_fingers(world, found):
    plain, (events, _, _) = world
    judged = hand.post_task(events, "episode", RULES)
    assert {(r[0], r[1]) for r in rows(judged.filter("phantom"), "episode", "seq")} == {(k, s) for k, p in plain.items() for s in p.phantoms()}
    got = hand.renamed(judged, found["ends"], found["spans"], "episode", RULES)
    want = sorted(((k, s, name) for k, p in plain.items() for s, name in p.names(spans_of(p, k), 0.6 * p.length).items()), key=repr)
    assert rows(got, "episode", "seq", "label") == want
    assert {r[2] for r in want} >= {"phantom", "finger_unload", "sensor_residual"}


def test_override_and_composition(spark, world, found):
    plain, (events, samples, jaw) = world
    stages = found["ends"].select("episode", "length", F.array(F.struct(F.lit("approach").alias("label"), F.lit(0.0).alias("start"), (0.6 * F.col("length")).alias("end")), F.struct(F.lit("place_release").alias("label"), (0.6 * F.col("length")).alias("start"), F.col("length").alias("end"))).alias("stages"))
    story = hand.interpret(events, samples, jaw, stages, "episode", RULES)
    base = hand.interpret(events, samples, jaw, stages, "episode", RULES, full=False)
    assert base.spans.count() == 0
    assert {r[0] for r in rows(base.events, "label")} <= set(LABELS)
    # names change, rows do not: base and full keep the same events but for places that only one of them cleans
    assert {r[0] for r in rows(story.events, "label")} >= {"phantom", "sensor_residual"}
    one = {r.episode for r in story.stages.groupBy("episode").count().filter("count = 1").collect()}
    for k, p in plain.items():
        drops = [e[4] for e in p.events if e[3] == "drop"]
        lost = not any(e[3] == "release" for e in p.events) and drops and any(s[0] == "failed_attempt" and round(s[1], 1) - 0.05 <= drops[-1] <= round(s[2], 1) + 0.05 for s in spans_of(p, k))
        assert not lost or k in one


# --- recording, restated: one task, then a phantom contact of finger 1 with finger 0's release inside it ---

TASK = [
    (1, 1, 0, "contact_onset", 1.35, 1.35, "low"), (1, 1, 1, "release", 1.834, 1.834, "medium"), (1, 1, 2, "contact_onset", 8.5, 8.5, "high"), (1, 1, 3, "release", 11.68, 11.68, "high"),
    (1, 0, 4, "release", 14.179, 14.179, "medium"), (1, 1, 5, "contact_onset", 14.113, 14.113, "low"), (1, 1, 6, "grasp_stable", 15.537, 15.537, "low"), (1, 1, 7, "drop", 16.577, 16.577, "low"),
]
SPANS = [(1, "post_task_contact", 14.1, 16.6, 1, None), (1, "weak_contact", 1.3, 1.8, 1, None)]
GRAZE = [(1, 1, 0, "contact_onset", 1.35, 1.35, "low"), (1, 1, 1, "release", 1.8, 1.8, "medium"), (1, 0, 2, "contact_onset", 1.5, 1.5, "medium")]


def kept(spark, events, spans):
    return [r[0] for r in rows(hand.recorded(spark.createDataFrame(events, EVENT), spark.createDataFrame(spans, SPAN), "episode"), "seq")]


def test_recording(spark):
    assert kept(spark, TASK, SPANS) == [2, 3, 4]  # low ones after the task go, all of the graze, the partner's stays
    assert kept(spark, TASK[2:], []) == [2, 3, 4, 5, 6, 7]
    assert kept(spark, [(*e[:3], "phantom", *e[4:]) if e[2] == 5 else e for e in TASK[2:]], []) == [2, 3, 4, 6, 7]


def test_recording_is_by_finger(spark):
    assert kept(spark, GRAZE, [(1, "weak_contact", 1.3, 1.8, 1, None)]) == [2]
    assert kept(spark, GRAZE, [(1, "weak_contact", 1.3, 1.8, None, None)]) == []
    low = [(*e[:6], "low") for e in GRAZE]
    assert kept(spark, low, [(1, "post_task_contact", 1.3, 1.8, 1, None)]) == [2]
    assert kept(spark, GRAZE, [(2, "weak_contact", 1.3, 1.8, None, None)]) == [0, 1, 2]


def test_long_intervals_use_few_blocks(spark):
    """A long episode is spread: an interval over all of it meets whole blocks, and rows only at its ends."""
    rng = random.Random(2)
    data = [(1, i * 0.5, rng.random()) for i in range(4000)]
    df = spark.createDataFrame(data, "episode long, t double, x double")
    asked = [(1, a, b) for a, b in [(0.0, 1999.5), (0.0, 1999.5), (-5.0, 5000.0), (10.2, 10.3), (7.0, 7.0), (3.0, 1.0), (12.0, 900.25), (511.5, 1024.0)]] + [(2, 0.0, 9.0)]
    q = spark.createDataFrame(asked, "episode long, lo double, hi double")
    for open_start in (False, True):
        found = intervals.extremes(q, df, ["episode"], "lo", "hi", "t", "x", 4.0, open_start=open_start).collect()
        assert len(found) == len(asked)
        got = {(r.episode, r.lo, r.hi): (r.least, r.greatest, r.rows) for r in found}
        for k, a, b in asked:
            inside = [x for e, t, x in data if e == k and (a < t if open_start else a <= t) and t <= b]
            assert got[k, a, b] == (min(inside, default=None), max(inside, default=None), len(inside))
    cover = spark.range(1).select(F.size(intervals._cover(F.lit(1).cast("long"), F.lit(60_000).cast("long"))).alias("n")).first().n
    assert cover <= 2 * intervals.LEVELS


def test_stabbing(spark):
    rng = random.Random(3)
    points = [(k, round(rng.uniform(-50, 500), 2)) for k in (1, 2) for _ in range(300)]
    spans = [(1, a, a + rng.choice([0.0, 0.5, 30.0, 400.0])) for a in (round(rng.uniform(-60, 300), 2) for _ in range(5))] + [(1, 5.0, 1.0)]
    p, s = spark.createDataFrame(points, "k long, t double"), spark.createDataFrame(spans, "k long, a double, b double")
    inside = sorted((k, t) for k, t in points if any(k == e and a <= t <= b for e, a, b in spans))
    got = intervals.stabbed(p, s, ["k"], "t", "a", "b", 8.0, "inside")
    assert rows(got.filter("inside"), "k", "t") == sorted(inside, key=repr)
    assert rows(got.filter("not inside"), "k", "t") == sorted((x for x in points if x not in inside), key=repr)
