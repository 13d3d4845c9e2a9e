import random
import subprocess
import sys

import pyarrow as pa
import pytest
from fleet import EXECUTIONS, SCHEMA, fleet_rows, log_of, rows_of
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark import cloudpickle

from togglelog.operators import label_rows, pair_executions, pair_or_open

COLUMNS = ("device_id", "event", "start_ns", "start_ord", "end_ns", "end_ord")


def pair_by_hand(rows, match, by_device=True):
    """The automaton, one row at a time. Returns all pairs, open starts with None as end."""
    groups = {}
    for event, time, toggled, device, _, message, ord_ in rows:
        if None in (event, time, toggled) or (by_device and device is None):
            continue
        key = (device if by_device else None, event)
        groups.setdefault(key, []).append((time, ord_, toggled, message))
    found = []
    for key, steps in groups.items():
        start = None
        for time, ord_, toggled, message in sorted(steps, key=lambda s: s[:2]):
            if toggled:
                start = start or (time, ord_, message)
            elif start and (not match or start[2] == message):
                found.append((*key, *start[:2], time, ord_))
                start = None
        if start:
            found.append((*key, *start[:2], None, None))
    return sorted(found, key=lambda r: [(v is not None, v) for v in r])


def random_rows(seed, n, messages, p_true=0.5, hot=0.4, times=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot_one = rng.random() < hot
        device = "hot" if hot_one else rng.choice(["a", "b", "c", None])
        event = "e0" if hot_one else rng.choice(["e0", "e1", None])
        message = rng.choice([None, *(f"m{j}" for j in range(messages))])
        rows.append((event, rng.randrange(times), rng.random() < p_true, device, 1.0, message, i))
    return rows


def test_fleet_pairs(spark):
    log = log_of(spark, fleet_rows())
    for match in (False, True):
        got = pair_executions(log, match_message=match)
        assert rows_of(got, "device_id", "event", "start_ns", "duration_ns") == sorted(
            (station, event, start, length) for event, station, start, length, _ in EXECUTIONS
        )


CASES = [
    ([("F", "1"), ("T", "2"), ("F", "3")], [(2, 3)], [(2, 3)]),
    ([("T", 1), ("T", 2), ("F", 3), ("F", 4), ("T", 5)], [(1, 3)], [(1, 3)]),
    ([("T", 1, "a"), ("F", 2, "b"), ("F", 3, "a")], [(1, 2)], [(1, 3)]),
    ([("T", 1, "a"), ("T", 2, "b"), ("F", 3, "b"), ("F", 4, "a")], [(1, 3)], [(1, 4)]),
    ([("T", 1, "a"), ("F", 2, "b"), ("T", 3, "b"), ("F", 4, "b")], [(1, 2), (3, 4)], []),
    ([("T", 1), ("F", 2)], [(1, 2)], [(1, 2)]),
    ([("T", 1), ("F", 2, "a")], [(1, 2)], []),
    # equal times: file order decides
    ([("F", 1), ("T", 1), ("F", 1)], [(1, 1)], [(1, 1)]),
    ([("T", 5)], [], []),
    ([("F", 5)], [], []),
]


@pytest.mark.parametrize("rows_per_group", [None, 1])
def test_edge_cases(spark, rows_per_group):
    """All cases at once, each in its own group."""
    rows = []
    for n, (steps, _, _) in enumerate(CASES):
        for kind, time, *message in steps:
            rows.append((f"case{n}", int(time), kind == "T", "d", 1.0, message[0] if message else None))
    log = log_of(spark, rows)
    for match, column in ((False, 1), (True, 2)):
        got = pair_executions(log, match_message=match, rows_per_group=rows_per_group)
        expected = sorted((f"case{n}", *pair) for n, case in enumerate(CASES) for pair in case[column])
        assert rows_of(got, "event", "start_ns", "end_ns") == expected


@pytest.mark.parametrize("messages, p_true", [(3, 0.5), (25, 0.4), (1, 0.85), (0, 0.5)])
@pytest.mark.parametrize("match", [False, True])
def test_random_logs_whole_and_split(spark, messages, p_true, match):
    rows = random_rows(messages, 2500, messages, p_true)
    log = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = pair_by_hand(rows, match)
    for rows_per_group in (None, 10**9, 60):
        got = pair_or_open(log, match_message=match, rows_per_group=rows_per_group)
        assert rows_of(got, *COLUMNS) == expected


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.integers(0, 6), st.booleans(), st.sampled_from([None, "a", "b", "c"])), min_size=1, max_size=40
    )
)
def test_any_log_split_into_chunks(spark, steps):
    rows = [("e", time, toggled, "d", 1.0, message, i) for i, (time, toggled, message) in enumerate(steps)]
    log = spark.createDataFrame(rows, SCHEMA)
    for match in (False, True):
        got = pair_or_open(log, match_message=match, rows_per_group=4)
        assert rows_of(got, *COLUMNS) == pair_by_hand(rows, match)


@pytest.mark.parametrize("rows_per_group", [None, 100])
def test_basic_format_ignores_devices_and_messages(spark, rows_per_group):
    rows = random_rows(7, 1500, 4)
    log = spark.createDataFrame(rows, SCHEMA)
    got = pair_or_open(log, by_device=False, rows_per_group=rows_per_group)
    assert rows_of(got, *COLUMNS) == pair_by_hand(rows, False, by_device=False)
    assert got.where("device_id IS NOT NULL OR message_id IS NOT NULL").count() == 0


def test_log_without_device_or_message_columns(spark):
    log = log_of(spark, [("e", 1, True, None, None, None), ("e", 4, False, None, None, None)])
    log = log.drop("device_id", "position", "message_id")
    assert rows_of(pair_executions(log, by_device=False), "start_ns", "duration_ns") == [(1, 3)]


def test_fractional_time(spark):
    log = log_of(spark, [("e", 1, True, "d", 1.0, "m"), ("e", 2, False, "d", 1.0, "x"), ("e", 3, False, "d", 1.0, "m")])
    log = log.withColumn("time_ns", log["time_ns"] + 0.25)
    for rows_per_group in (None, 1):
        got = pair_executions(log, rows_per_group=rows_per_group)
        assert rows_of(got, "start_ns", "end_ns", "duration_ns") == [(1.25, 3.25, 2.0)]


def test_fold_crosses_arrow_batches(spark):
    rows = random_rows(3, 900, 3)
    log = spark.createDataFrame(rows, SCHEMA)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows_of(pair_or_open(log, rows_per_group=None), *COLUMNS)
        split = rows_of(pair_or_open(log, rows_per_group=50), *COLUMNS)
        labels = rows_of(label_rows(log, rows_per_group=None), "role")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == split == pair_by_hand(rows, True)
    closed = sum(r[-1] is not None for r in got)
    assert (labels.count(("start",)), labels.count(("end",))) == (closed, closed)
    assert labels.count(("unclosed",)) == len(got) - closed


@pytest.mark.parametrize("rows_per_group", [None, 80])
def test_labels(spark, rows_per_group):
    rows = random_rows(11, 1200, 3)
    log = spark.createDataFrame(rows, SCHEMA)
    roles = {}
    for *_, start, _, end in pair_by_hand(rows, True):
        roles[start] = "start" if end is not None else "unclosed"
        roles[end] = "end"
    expected = [
        (r[6], roles.get(r[6], "ignored")) for r in rows if r[0] is not None and r[3] is not None
    ]
    assert rows_of(label_rows(log, rows_per_group=rows_per_group), "ord", "role") == sorted(expected)


def test_python_code_travels_without_the_package(spark, monkeypatch, tmp_path):
    """Executors need not have the package: what is shipped to them must not import it."""
    log = spark.createDataFrame(random_rows(2, 300, 2), SCHEMA)
    frame, shipped = type(log), []
    original = frame.mapInArrow

    def recorded(self, func, schema):
        shipped.append(func)
        return original(self, func, schema)

    monkeypatch.setattr(frame, "mapInArrow", recorded)
    pair_executions(log, rows_per_group=50).count()
    assert {f.__name__ for f in shipped} == {"pair", "exits", "carry"}
    batch = pa.RecordBatch.from_pydict(
        {
            "device_id": ["d", "d"], "event": ["e", "e"], "chunk": [0, 0], "time_ns": [1, 2], "ord": [0, 1],
            "toggled": [True, False], "message_id": [None, None], "first": [True, False], "idle": [True, True],
            "entry": pa.array([None, None], pa.string()), "open": [True, False],
        }
    )
    for n, func in enumerate(shipped):
        path = tmp_path / f"{n}.pickle"
        path.write_bytes(cloudpickle.dumps((func, batch)))
        code = f"import pickle; f, b = pickle.load(open({str(path)!r}, 'rb')); print(len(list(f(iter([b])))))"
        subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)
