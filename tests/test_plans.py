"""Plans: what must not be in them, and what the scans read."""

import re

import pytest

from tracewright.plans import registry
from tracewright.plans.views import signal

#: Queries that join one row of totals to a table.
ONE_ROW = {"nice_histogram", "mann_whitney", "pair_by_suffix"}
#: Queries whose point is a Python table function.
TABLE_FUNCTIONS = {"latch_table_function", "spans_table_function"}
#: Queries that run jobs while they are built.
EAGER = {"stream_windows", "stream_counts", "stream_latch", "kmeans_sweep", "cluster_contingency", "pca2", "knn_nearest", "knn_votes", "knn_confusion", "knn_scores", "signal_screen", "screen_votes_by_class", "reference_build"}
EAGER |= {"hand_bouts", "early_attempts", "in_bout_attempts", "failure_override", "place_hygiene", "renamed_events", "recorded_by_finger", "detected_episodes", "exit_predictions", "exit_model_scores", "slip_trajectory"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER))
def test_no_product_of_rows(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text or name in TABLE_FUNCTIONS
    if name not in ONE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER))
def test_frames_grow_from_one_end(spark, sf, name):
    """A frame that moves its start and reaches to the end is computed anew for each row."""
    assert not re.search(r"specifiedwindowframe\(\w+, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan(registry.QUERIES[name](spark, sf)))


def test_scans_read_what_they_need(spark, sf):
    text = plan(registry.QUERIES["contact_bouts"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text
    text = plan(registry.QUERIES["episode_set_difference"](spark, sf))
    assert "ReadSchema: struct<o_custkey:bigint>" in text
    text = plan(signal(spark, sf).filter("episode = 3"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in text


def test_bouts_shuffle_once_for_each_key(spark, sf):
    """Windows, runs, merging and totals of one key share one exchange of the rows."""
    text = plan(registry.QUERIES["contact_bouts"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1
