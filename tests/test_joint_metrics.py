"""Metrics of several targets at once, against counts by hand and the metrics of each target alone."""

import pytest

from barline.operators import stats

SIDES, MOVES = ("up", "down", "flat"), ("over", "under")
TARGETS = {"side": ("a", "p", SIDES), "move": ("m", "q", MOVES)}
SCHEMA = "k string, a string, p string, m string, q string"


def test_joint_accuracy_and_counts(spark):
    rows = [("x", "up", "up", "over", "over"), ("x", "up", "down", "over", "over"), ("x", "down", "down", "under", "over"), ("x", "flat", None, "over", None), ("y", "up", "up", "under", "under")]
    got = {r.k: r for r in stats.joint_metrics(spark.createDataFrame(rows, SCHEMA), TARGETS, ["k"]).collect()}
    assert (got["x"].samples, got["x"].joint_accuracy, got["y"].joint_accuracy) == (4, 0.25, 1.0)
    assert got["x"].side_actual == {"up": 2, "down": 1, "flat": 1} and got["x"].side_predicted == {"up": 1, "down": 2, "flat": 0}
    assert got["x"].move_predicted == {"over": 3, "under": 0} and got["x"].side_macro_precision == pytest.approx((1 + 0.5 + 0) / 3)
    assert got["y"].side_balanced_accuracy == 1.0 and got["y"].side_macro_recall == pytest.approx(1 / 3)


def test_each_target_as_alone(spark):
    rows = spark.range(5000).selectExpr(
        "IF(id % 3 = 0, 'rare', 'hot') AS k", "element_at(array('up', 'down', 'flat'), CAST(id * 7 % 3 + 1 AS INT)) AS a", "element_at(array('up', 'down', 'flat'), CAST(id DIV 5 % 3 + 1 AS INT)) AS p",
        "IF(id % 4 = 0, 'over', 'under') AS m", "IF(id % 6 < 3, 'over', 'under') AS q",
    )
    both = {r.k: r.asDict() for r in stats.joint_metrics(rows, TARGETS, ["k"]).collect()}
    for name, (a, p, labels) in TARGETS.items():
        for r in stats.class_metrics(rows, a, p, labels, ["k"]).collect():
            assert {f"{name}_{c}": v for c, v in r.asDict().items() if c not in ("k", "samples")}.items() <= both[r.k].items()


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert stats.joint_metrics(none, TARGETS, ["k"]).count() == 0
    (row,) = stats.joint_metrics(none, TARGETS).collect()
    assert (row.samples, row.joint_accuracy) == (0, None)
