import pytest
from fleet import fleet_rows, log_of, rows_of

from togglelog.operators import groups_without_execution, pair_executions, preview, profile, unbalanced_groups
from togglelog.schema import TIMING_SCHEMA, normalise

MESSY = [
    ("e", 1, True, "d", 1.0, None),
    ("e", 2, True, "d", 1.0, None),
    ("e", 3, False, "d", 1.0, None),
    ("f", 4, False, "d", 1.0, None),
    ("f", 5, True, "d", 1.0, None),
    ("g", 5, True, None, 1.0, None),
]


def test_fleet_is_balanced(spark):
    log = log_of(spark, fleet_rows())
    assert unbalanced_groups(log).count() == 0
    assert groups_without_execution(log, pair_executions(log)).count() == 0
    assert profile(log).first().asDict() == {
        "row_count": 42, "events": 6, "devices": 4, "toggle_values": 2, "min_time_ns": 100, "max_time_ns": 9080
    }


def test_messy_log(spark):
    log = log_of(spark, MESSY)
    assert rows_of(unbalanced_groups(log)) == [("d", "e", 2, 1)]
    assert rows_of(groups_without_execution(log, pair_executions(log))) == [("d", "f")]
    basic = pair_executions(log, by_device=False)
    assert rows_of(groups_without_execution(log, basic, by_device=False)) == [("f",), ("g",)]
    assert [r["time_ns"] for r in preview(log, 3).collect()] == [1, 2, 3]
    empty = profile(log.where("false")).first()
    assert (empty["row_count"], empty["events"], empty["min_time_ns"]) == (0, 0, None)


def test_normalise(spark):
    log = log_of(spark, MESSY).drop("device_id", "message_id").selectExpr("*", "1 AS note")
    log = log.withColumn("position", log["position"].cast("int"))
    full = normalise(log)
    assert {f.name: f.dataType for f in TIMING_SCHEMA}.items() <= {f.name: f.dataType for f in full.schema}.items()
    assert "note" in full.columns
    with pytest.raises(ValueError, match="Missing required columns: time_ns"):
        normalise(log.drop("time_ns"))
