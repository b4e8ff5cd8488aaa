"""The causal part of the detector on a stream: watermarked windows and a latch kept as state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, keys, x: str, width: str, late: str) -> DataFrame:
    """Count, mean and peak for each key and tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.max(x).alias("peak")).select(*keys, F.col("w.start").alias("start"), "n", "mean", "peak")


def sessions(stream: DataFrame, ts: str, keys, gap: str, late: str) -> DataFrame:
    """Sessions of a key: rows no further apart than the gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latched(stream: DataFrame, key: str, ts: str, t: str, seq: str, x: str, closing: str, enter: float, leave: float, enter_t: float, leave_t: float, late: str) -> DataFrame:
    """(key, kind, start, fired): the debounced latch with its state kept between batches.

    ``ts`` is the event time and ``t`` the same as a number. Rows wait in the state until the watermark
    (the latest event time less ``late``) has passed them, and then go through the latch in the order of
    ``t`` and ``seq``, whatever batches and files they came in; rows later than that are dropped. A row with
    ``closing`` ends its key: all that waits is let through.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, since, *waiting = state.get if state.exists else (False, None, [], [], [])
        rows = list(zip(*waiting, strict=True))
        ended = False
        for pdf in frames:
            ended = ended or bool(pdf[closing].any())
            own = pdf[~pdf[closing]]
            rows += zip(own[t].tolist(), own[seq].tolist(), own[x].tolist(), strict=True)
        rows.sort()
        passed = state.getCurrentWatermarkMs() * 1000.0  # microseconds, as t
        ready = len(rows) if ended else bisect_left(rows, (passed,))
        out = []
        for now, _, v in rows[:ready]:
            if not (v < leave if held else v > enter):
                since = None
                continue
            since = now if since is None else since
            if now - since >= (leave_t if held else enter_t):
                out.append((k[0], "terminal" if held else "onset", since, now))
                held, since = not held, None
        rest = rows[ready:]
        state.update((held, since, *([r[i] for r in rest] for i in range(3))))
        if rest:
            state.setTimeoutTimestamp(max(int(passed // 1000) + 1, int(rest[0][0] // 1000) + 1))
        yield pd.DataFrame(out, columns=[key, "kind", "start", "fired"])

    kind = stream.schema[key].dataType.simpleString()
    kept = "held boolean, since double, ts array<double>, seqs array<long>, xs array<double>"
    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, kind string, start double, fired double", kept, "append", "EventTimeTimeout")
