"""Truly sequential steps over one episode's rows, as small functions that Spark runs per group.

Each function takes arrays of one ordered episode; ``per_episode`` sorts and groups with Spark.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_episode(df: DataFrame, key: str, order: str, function, schema: str) -> DataFrame:
    """Run ``function(frame sorted by order) -> frame`` on each episode; the key column is added."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf.sort_values(order, kind="stable").reset_index(drop=True))
        out.insert(0, key, pdf[key].iloc[0] if len(pdf) else None)
        return out

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def latch(t: np.ndarray, x: np.ndarray, enter: float, leave: float, enter_s: float, leave_s: float) -> list[tuple[str, float, float]]:
    """(kind, start, fired): contact begins when x stays above ``enter`` for enter_s, stamped at the
    stretch's start, and ends when it stays below ``leave`` for leave_s; an end still being waited
    for when the series stops never fires."""
    out, held, since = [], False, None
    for now, v in zip(t.tolist(), x.tolist(), strict=True):
        wanted = v < leave if held else v > enter
        if not wanted:
            since = None
            continue
        since = now if since is None else since
        if now - since >= (leave_s if held else enter_s):
            out.append(("terminal" if held else "onset", since, now))
            held, since = not held, None
    return out


def baseline(t: np.ndarray, x: np.ndarray, start: float, tau: float, margin: float) -> np.ndarray:
    """The series less a zero that follows it slowly while the rest is small, and stands under load."""
    out = np.empty(len(x))
    zero, last = start, None
    rate = (len(t) - 1) / (t[-1] - t[0]) if len(t) > 1 and t[-1] > t[0] else 30.0
    for i, (now, v) in enumerate(zip(t.tolist(), x.tolist(), strict=True)):
        rest = v - zero
        out[i] = max(rest, 0.0)
        if abs(rest) < margin:
            step = 1 / rate if last is None else now - last
            zero += min(1.0, step / tau) * rest
        last = now
    return out


def changepoints(x: np.ndarray, most: int, penalty: float, least: int) -> list[tuple[int, float]]:
    """Binary segmentation: (row, gain) in the order of rows; at each turn the split with the
    greatest gain, the first one on ties, until the gain falls below penalty times the whole cost."""
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    cuts, found, total = [0, len(x)], [], cost(0, len(x)) if len(x) else 0.0

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + least, b - least + 1)
        if not len(at):
            return 0.0, -1
        gain = cost(a, b) - (q[at] - q[a] - (s[at] - s[a]) ** 2 / (at - a)) - (q[b] - q[at] - (s[b] - s[at]) ** 2 / (b - at))
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    known = {}
    for _ in range(most):
        top = (0.0, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (a, b) not in known:
                known[a, b] = best(a, b)
            if known[a, b][0] > top[0]:
                top = known[a, b]
        if top[1] < 0 or top[0] < penalty * total:
            break
        found.append((top[1], top[0]))
        cuts = sorted([*cuts, top[1]])
    return sorted(found)


def cycles(t: np.ndarray, x: np.ndarray, travel: float) -> list[tuple[float, float, float]]:
    """(peak time, trough time, end): falls of ``travel`` from a running peak with a rise of as much after."""
    out, i, n = [], 0, len(x)
    while i < n:
        peak = i
        while i < n and x[peak] - x[i] < travel:
            peak = i if x[i] > x[peak] else peak
            i += 1
        low = i
        while i < n and x[i] - x[low] < travel:
            low = i if x[i] < x[low] else low
            i += 1
        if i >= n:
            break
        out.append((float(t[peak]), float(t[low]), float(t[i])))
    return out


def clock_map(frame_t: np.ndarray, frame_v: np.ndarray, raw_t: np.ndarray, raw_v: np.ndarray, reach: float, least: int) -> list[tuple[float, float]]:
    """(frame time, raw time) anchors: each frame takes the next raw row of equal value; the search
    goes on at the last match, an anchor needs a later raw time. Empty with fewer than ``least``.

    Raw rows are looked up by bins of their values, so that a frame without a match costs no scan.
    """
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(np.floor(raw_v / (2 * reach)).astype(np.int64).tolist()):
        bins.setdefault(b, []).append(i)
    out, at = [], 0
    for ft, fv in zip(frame_t.tolist(), frame_v.tolist(), strict=True):
        best = len(raw_v)
        low = math.floor(fv / (2 * reach))
        for b in (low - 1, low, low + 1):
            rows = bins.get(b, [])
            k = bisect_left(rows, at)
            while k < len(rows) and rows[k] < best and abs(raw_v[rows[k]] - fv) > reach:
                k += 1
            if k < len(rows):
                best = min(best, rows[k])
        if best < len(raw_v):
            at = best
            if not out or raw_t[at] > out[-1][1]:
                out.append((ft, float(raw_t[at])))
    return out if len(out) >= least else []


def scale_groups(stats: list[tuple[str, float, float]], decades: float = 2.0) -> list[list[str]]:
    """Groups of series within so many decades of each other's extremes, in the given order;
    constant and non-finite series stay alone."""
    log = lambda v: np.log10(abs(v) + 1e-9)
    out: list[list[str]] = []
    used = set()
    for i, (name, lo, hi) in enumerate(stats):
        if name in used:
            continue
        group, usable = [name], np.isfinite(lo) and np.isfinite(hi) and lo != hi
        for other, a, b in stats[i + 1 :]:
            if usable and other not in used and np.isfinite(a) and np.isfinite(b) and a != b and abs(log(lo) - log(a)) <= decades and abs(log(hi) - log(b)) <= decades:
                group.append(other)
        used |= set(group)
        out.append(group)
    return out
