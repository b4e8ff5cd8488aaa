"""Table functions for SQL: an episode's rows in, its events out.

    spark.udtf.register("contact_latch", ContactLatch)
    SELECT * FROM contact_latch(TABLE(signal) PARTITION BY (episode) ORDER BY (i), 34D, 20D, 3600D, 3600D)

Spark partitions and sorts the rows; a function holds a few numbers of the episode at hand.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="episode bigint, kind string, start double, fired double", useArrow=False)
class ContactLatch:
    """Onsets and terminals of the debounced latch over a table with episode, t and x, ordered in time. A null
    in x breaks what was waiting; an episode without rows gives none."""

    def __init__(self):
        self.held, self.since = False, None

    def eval(self, row, enter: float, leave: float, enter_s: float, leave_s: float):
        x, t = row["x"], row["t"]
        if x is None or not (x < leave if self.held else x > enter):
            self.since = None
            return
        self.since = t if self.since is None else self.since
        if t - self.since >= (leave_s if self.held else enter_s):
            yield row["episode"], "terminal" if self.held else "onset", self.since, t
            self.held, self.since = not self.held, None


@udtf(returnType="episode bigint, span int, start double, end double, rows bigint, peak double", useArrow=False)
class LoadSpans:
    """Spans of a table with episode, t and x while x is above a limit; one ends at its last row."""

    def __init__(self):
        self.episode, self.span, self.start, self.end, self.rows, self.peak = None, 0, None, None, 0, None

    def _out(self):
        out = (self.episode, self.span, self.start, self.end, self.rows, self.peak)
        self.span, self.start, self.rows, self.peak = self.span + 1, None, 0, None
        return out

    def eval(self, row, limit: float):
        self.episode = row["episode"]
        x = row["x"]
        if x is not None and x > limit:
            self.start = row["t"] if self.start is None else self.start
            self.end, self.rows, self.peak = row["t"], self.rows + 1, x if self.peak is None else max(self.peak, x)
        elif self.start is not None:
            yield self._out()

    def terminate(self):
        if self.start is not None:
            yield self._out()


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("contact_latch", ContactLatch)
    spark.udtf.register("load_spans", LoadSpans)
