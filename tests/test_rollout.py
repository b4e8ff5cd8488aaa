"""Rollout stages on known trajectories, joint names, table functions."""

import pytest

from tracewright.operators import matching, rollout, table_functions

FRAME = "episode long, i int, area double, x double, y double, near boolean"


def part(n, x, y, area, near=False):
    return [(area, float(x), float(y), near)] * n


CASES = {
    "S5": (part(10, 100, 120, 200.0) + part(8, 150, 105, 260.0) + part(6, 220, 92, 200.0), True, None, "F0"),
    "S3": (part(10, 100, 120, 200.0) + part(8, 200, 110, 260.0) + part(6, 60, 200, 200.0), True, None, "F5"),
    "S2": (part(10, 60, 200, 200.0) + part(8, 62, 198, 260.0) + part(6, 60, 200, 200.0), True, None, "F4"),
    "S1": (part(12, 100, 120, 200.0) + part(8, 100, 120, 200.0, True), True, None, "F2"),
    "S0": (part(20, 100, 120, 200.0), True, None, "F6"),
    "S1 gripped, never seen": (part(20, -1, -1, 0.0), True, True, "F3"),
    "S1 gripped": (part(20, 100, 120, 200.0), True, True, "F3"),
    "S0 never seen": (part(2, 100, 120, 200.0) + part(9, 0, 0, 0.0), True, None, "F6"),
    "S2 no bowl": (part(10, 100, 120, 200.0) + part(8, 200, 100, 260.0) + part(6, 220, 92, 200.0), False, None, "F4"),
    "S0 two high ones only": (part(10, 100, 120, 200.0) + part(2, 150, 105, 260.0) + part(3, 220, 92, 200.0) + part(2, 150, 105, 260.0), True, None, "F6"),
}


def test_stages(spark):
    frames, bowls, grips = [], [], []
    for k, (rows, bowl, grip, _) in enumerate(CASES.values()):
        frames += [(k, i, *r) for i, r in enumerate(rows)]
        bowls += [(k, 220.0, 90.0, 36.0)] if bowl else []
        grips += [(k, True)] if grip else []
    d = rollout.decided_stages(
        spark.createDataFrame(frames, FRAME), spark.createDataFrame(bowls, "episode long, bowl_x double, bowl_y double, bowl_r double"),
        spark.createDataFrame(grips, "episode long, actuated boolean"), "episode", rollout.Stages(scale=0.5),
    )
    got = {r.episode: r for r in d.collect()}
    for k, (name, (rows, _, _, failure)) in enumerate(CASES.items()):
        assert (got[k].stage, got[k].failure, got[k].frames) == (name[:2], failure, len(rows)), name
        assert got[k].seen == sum(r[0] > 0 for r in rows)


def test_joint_cascade(spark):
    joints = [(1, j) for j in ("Elbow", "left_elbow_joint", "openarm_left_joint3", "openarm_right_finger_joint1", "openarm_right_finger_joint2", "wrist", "nothing", "twice")] + [(2, "Elbow")]
    columns = [(1, c, i) for i, c in enumerate(("observation.state | elbow", "action | elbow", "state | kLeftElbow.q", "action | kLeftElbow.q", "state | left_joint_3.pos", "state | right_gripper", "state | my_wrist_roll", "twice | a", "twice | b"))]
    aliases = [("kleftelbow.q", "left_elbow_joint")]
    d = matching.matched_joints(spark.createDataFrame(joints, "robot int, joint string"), spark.createDataFrame(columns, "robot int, column string, place int"), "robot", spark.createDataFrame(aliases, "suffix string, joint string"))
    assert {(r.robot, r.joint): (r["column"], r.rule) for r in d.collect()} == {
        (1, "Elbow"): ("observation.state | elbow", "exact"), (1, "left_elbow_joint"): ("action | kLeftElbow.q", "alias"), (1, "openarm_left_joint3"): ("state | left_joint_3.pos", "pattern"),
        (1, "openarm_right_finger_joint1"): ("state | right_gripper", "pattern"), (1, "wrist"): ("state | my_wrist_roll", "fuzzy"), (1, "twice"): ("twice | a", "fuzzy"),
    }


def test_table_functions(spark):
    table_functions.register(spark)
    rows = [(1, i, float(i), x) for i, x in enumerate([0, 5, 5, 5, None, 5, 5, 0, 0, 0, 0, 5])] + [(2, i, float(i), 5.0) for i in range(4)] + [(3, 0, 0.0, None)]
    spark.createDataFrame([(k, i, t, None if x is None else float(x)) for k, i, t, x in rows], "episode long, i int, t double, x double").createOrReplaceTempView("rows_of_test")
    got = spark.sql("SELECT * FROM contact_latch(TABLE(rows_of_test) PARTITION BY (episode) ORDER BY (i), 1D, 1D, 2D, 2D)").collect()
    assert sorted(tuple(r) for r in got) == [(1, "onset", 1.0, 3.0), (1, "terminal", 7.0, 9.0), (2, "onset", 0.0, 2.0)]
    got = spark.sql("SELECT * FROM load_spans(TABLE(SELECT * FROM rows_of_test) PARTITION BY (episode) ORDER BY (i), 1D)").collect()
    assert sorted(tuple(r)[:5] for r in got) == [(1, 0, 1.0, 3.0, 3), (1, 1, 5.0, 6.0, 2), (1, 2, 11.0, 11.0, 1), (2, 0, 0.0, 3.0, 4)]
    with pytest.raises(Exception, match="(?i)contact_latch|argument|UDTF"):
        spark.sql("SELECT * FROM contact_latch(TABLE(rows_of_test) PARTITION BY (episode) ORDER BY (i))").collect()
