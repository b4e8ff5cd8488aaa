"""Runs over many episodes with a result row for each, resumable; and the trimmed copy of a dataset."""

from __future__ import annotations

import traceback

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shape, trim


def run(df: DataFrame, key: str, order: str, function) -> DataFrame:
    """(key, status, rows, flags, error): ``function(sorted frame) -> (rows, flags)`` on each episode.

    An error in one episode is its ``failed`` row and stops no other; Spark still retries tasks that
    are lost, as only errors of the function are caught.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {key: pdf[key].iloc[0], "status": "ok", "rows": None, "flags": [], "error": None}
        try:
            row["rows"], row["flags"] = function(pdf.sort_values(order, kind="stable"))
        except Exception:
            row |= {"status": "failed", "error": traceback.format_exc().splitlines()[-1]}
        return pd.DataFrame([row])

    return df.groupBy(key).applyInPandas(one, f"{key} {kind}, status string, rows long, flags array<string>, error string")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The episodes that have no result yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def summary(results: DataFrame) -> DataFrame:
    """One row: total, ok, failed, flagged."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.size("flags") > 0).alias("flagged"))


def write_trimmed(frames: DataFrame, cuts: DataFrame, out: str, key: str, i: str, fps: float, block: str | None = None, renumber: bool = True) -> None:
    """Data, episode metadata, statistics and cuts of the trimmed dataset as tables below ``out``.

    The source is never touched; an existing target is an error.
    """
    kept = trim.rebase(frames, trim.check_cuts(cuts), key, i, fps, renumber)
    kept.drop(key, i).withColumnRenamed("new_episode", "episode_index").repartitionByRange("index").sortWithinPartitions("index").write.parquet(f"{out}/data")
    written = frames.sparkSession.read.parquet(f"{out}/data")
    trim.metadata(written, "episode_index").write.parquet(f"{out}/meta/episodes")
    if block:
        shape.axis_stats(written, block, ["episode_index"]).write.parquet(f"{out}/meta/stats")
    cuts.write.parquet(f"{out}/meta/cuts")
