"""Nested JSON logs and results."""

import json

from fleet import SCHEMA, fleet_rows, log_of

from togglelog.operators import pair_executions
from togglelog.sources import flatten_executions, flatten_log, flatten_messages, nest_executions, nest_log, read_nested_log


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def test_log_documents_of_any_shape(spark):
    toggles = [{"time": 1, "toggled": True, "message": "m"}, {"time": "2", "toggled": "false", "ord": 77}, {"time": 3, "toggled": True, "position": 9, "note": [1]}]
    found = flatten_log(
        lines(
            spark,
            {"device": "a", "position": 2, "events": {"e": toggles, "f": [], "g": None}},
            {"events": {"h": [{"time": 2**60 + 1, "toggled": False}]}, "extra": {"x": 1}},
            {"device": "b", "events": {"e": [{"time": "soon", "toggled": True}, {"toggled": True}, {"time": 5, "toggled": "perhaps"}]}},
            {"device": "c"},
            {"device": "c", "events": [1, 2]},
            "no json",
            "[]",
        )
    )
    rows = sorted(tuple(r)[:6] for r in found.rows.collect())
    assert rows == [
        ("e", 1, True, "a", 2.0, "m"),
        ("e", 2, False, "a", 2.0, None),
        ("e", 3, True, "a", 9.0, None),
        ("h", 2**60 + 1, False, None, None, None),
    ]
    assert [r["ord"] for r in found.rows.where("time_ns = 2").collect()] == [77]
    assert found.has_devices
    reasons = sorted(r["reason"] for r in found.quarantine.collect())
    assert [r for r in reasons if r != "bad_time"] == ["bad_json", "bad_toggle", "no_events", "no_events", "no_events"]
    assert reasons.count("bad_time") >= 2


def test_round_trip(spark, tmp_path):
    log = log_of(spark, fleet_rows())
    nest_log(log).write.text(f"{tmp_path}/log")
    read = read_nested_log(spark, f"{tmp_path}/log")
    columns = ["event", "time_ns", "toggled", "device_id", "position", "message_id", "ord"]
    assert sorted(map(repr, read.rows.select(columns).collect())) == sorted(map(repr, log.select(columns).collect()))
    assert read.quarantine.count() == 0
    executions = pair_executions(log)
    back = flatten_executions(nest_executions(executions))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, executions.select(back.columns).collect()))


def test_messages_and_nothing(spark):
    docs = lines(spark, {"message": "m", "source": "a", "details": [{"device": "b", "hops": 2, "time": 7}, {"device": "c"}]}, {"message": "n", "details": 3}, "x")
    assert sorted(map(tuple, flatten_messages(docs).collect())) == [("m", "a", "b", 2.0, 7), ("m", "a", "c", None, None)]
    nothing = spark.createDataFrame([], "value string")
    assert flatten_messages(nothing).count() == flatten_executions(nothing).count() == flatten_log(nothing).rows.count() == 0
    assert nest_log(spark.createDataFrame([], SCHEMA)).count() == 0
