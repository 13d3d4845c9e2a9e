import json

import pytest
from fleet import fleet_rows, log_of, rows_of

from togglelog.operators import build_topology, device_table, exec_stats, pair_executions
from togglelog.sources import export_topology, read_first_log, read_timing_log, write_result

EXTENDED = """\
// a comment
# another
   # indented

Event,Time,Toggled,Device_ID,Position,Message_ID,Note
GPIO,1000,True,D1,1,,"a,b"
GPIO,1e3,0,D2,x,MSG_1
GPIO,2.5,1,D2
GPIO,5.0,False,D2,2,12345.0,z
GPIO,6,False,D2,2,12345,z,more
GPIO,,False,D2
GPIO,1705798295527282001.0,yes,NA,2.0,0,q
#Z,1,True
GPIO,12,maybe,D
GPIO,13,2,D
GPIO,n/a,True,D
"""


def test_extended_format(spark, tmp_path):
    path = tmp_path / "log.CSV"
    path.write_text(EXTENDED)
    log = read_timing_log(spark, str(path))
    assert log.has_devices
    got = log.rows.orderBy("ord").select("event", "time_ns", "toggled", "device_id", "position", "message_id", "Note")
    assert [tuple(r) for r in got.collect()] == [
        ("GPIO", 1000, True, "D1", 1.0, None, "a,b"),
        ("GPIO", 1000, False, "D2", None, "MSG_1", None),
        ("GPIO", 5, False, "D2", 2.0, "12345.0", "z"),
        ("GPIO", 1705798295527282001, True, None, 2.0, "0", "q"),
        ("GPIO", 13, True, "D", None, None, None),
    ]
    assert rows_of(log.quarantine, "value", "reason") == sorted(
        [
            ("GPIO,2.5,1,D2", "bad_time"),
            ("GPIO,6,False,D2,2,12345,z,more", "extra_fields"),
            ("GPIO,,False,D2", "bad_time"),
            ("GPIO,12,maybe,D", "bad_toggle"),
            ("GPIO,n/a,True,D", "bad_time"),
        ]
    )
    assert log.rows.count() + log.quarantine.count() == 10


def test_fractional_times(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("Event,Time,Toggled\ne,2.5,True\ne,1e3,False\ne,inf,True\ne,NaN,True\n")
    log = read_timing_log(spark, str(path), time_type="double")
    assert rows_of(log.rows, "time_ns") == [(2.5,), (1000.0,)]
    assert log.quarantine.count() == 2
    with pytest.raises(ValueError, match="time_type"):
        read_timing_log(spark, str(path), time_type="float")


def test_basic_format_in_any_column_order(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("﻿Time,Toggled,Event\n5,True,e\n7,False,e\n")
    log = read_timing_log(spark, str(path))
    assert not log.has_devices
    assert rows_of(pair_executions(log.rows, by_device=log.has_devices), "event", "duration_ns") == [("e", 2)]


def test_folder_of_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\nEvent,Time,Toggled,Device_ID\ne,1,True,A\ne,3,False,A\n")
    (tmp_path / "b.csv").write_text("Event,Time,Toggled,Device_ID\ne,10,True,B\ne,14,False,B\n")
    (tmp_path / "c.csv").write_text("Toggled,Time,Event,Device_ID,Note\nTrue,20,e,C,n\n// c\nFalse,28,e,C,m\n")
    (tmp_path / "notes.txt").write_text("not a log")
    log = read_timing_log(spark, str(tmp_path))
    assert rows_of(pair_executions(log.rows), "device_id", "duration_ns") == [("A", 2), ("B", 4), ("C", 8)]
    assert log.quarantine.count() == 0
    assert "Note" in log.rows.columns


def test_many_layouts(spark, tmp_path):
    """Each file has its own order, its own extra column with a quoted name, and one line too long."""
    names = ["Event", "Time", "Toggled", "Device_ID", "Message_ID"]
    cells = {"Event": "e", "Time": "7", "Toggled": "no", "Device_ID": "D", "Message_ID": "m"}
    for i in range(12):
        order = names[i % 5 :] + names[: i % 5]
        line = ",".join(cells[n] for n in order)
        (tmp_path / f"{i}.csv").write_text(f'{",".join(order)},"x,{i}"\n{line},v{i}\n{line}\n{line},v,more\n')
    log = read_timing_log(spark, str(tmp_path))
    want = ("e", 7, False, "D", "m")
    assert rows_of(log.rows, "event", "time_ns", "toggled", "device_id", "message_id") == [want] * 24
    for i in range(12):
        assert rows_of(log.rows.where(f"`x,{i}` IS NOT NULL"), f"`x,{i}`") == [(f"v{i}",)]
    assert rows_of(log.quarantine, "reason") == [("extra_fields",)] * 12
    (tmp_path / "headless.csv").write_text("e,1,True\n")
    with pytest.raises(ValueError, match="Missing required columns: Event, Time, Toggled"):
        read_timing_log(spark, str(tmp_path))


def test_refused_files(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("# only\nEvent,When\ne,1\n")
    with pytest.raises(ValueError, match="Missing required columns: Time, Toggled"):
        read_timing_log(spark, str(path))
    path.write_text("# nothing\n\n")
    with pytest.raises(ValueError, match="Missing required columns: Event, Time, Toggled"):
        read_timing_log(spark, str(path))
    other = tmp_path / "log.txt"
    other.write_text("Event,Time,Toggled\n")
    with pytest.raises(ValueError, match="CSV file"):
        read_timing_log(spark, str(other))


def test_first_existing_path(spark, tmp_path):
    path = tmp_path / "fallback.csv"
    path.write_text("Event,Time,Toggled\ne,1,True\n")
    log = read_first_log(spark, [str(tmp_path / "none.csv"), str(path)])
    assert log.rows.count() == 1
    with pytest.raises(FileNotFoundError):
        read_first_log(spark, [str(tmp_path / "none.csv")])


def test_round_trip_of_a_written_log(spark, tmp_path):
    """Many splits of one file keep the order of its lines."""
    log = log_of(spark, fleet_rows())
    lines = ["Event,Time,Toggled,Device_ID,Position,Message_ID"]
    for e, t, toggled, device, position, message in fleet_rows():
        lines.append(f"{e},{t},{toggled},{device},{position:.0f},{message or ''}")
    (tmp_path / "log.csv").write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        read = read_timing_log(spark, str(tmp_path / "log.csv"))
        assert read.rows.rdd.getNumPartitions() > 5
        got = [tuple(r) for r in read.rows.orderBy("ord").select(*log.columns[:-1]).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [tuple(r)[:-1] for r in log.orderBy("ord").collect()]


def test_sinks(spark, tmp_path):
    log = log_of(spark, fleet_rows())
    stats = exec_stats(pair_executions(log))
    write_result(stats, str(tmp_path / "stats"), partition_by=["event"])
    assert rows_of(spark.read.parquet(str(tmp_path / "stats")).select(*stats.columns)) == rows_of(stats)
    write_result(stats, str(tmp_path / "text"), format="csv", order_by=["device_id", "event"])
    assert spark.read.csv(str(tmp_path / "text"), header=True).count() == stats.count()
    devices = device_table(log)
    export_topology(devices, build_topology(devices, "ring"), str(tmp_path / "topology"), "ring")
    found = [json.loads(line) for f in (tmp_path / "topology/connections").glob("*.json") for line in f.open()]
    assert sorted((e["src"], e["dst"]) for e in found)[0] == ("east", "tank")
    assert {e["mode"] for e in found} == {"ring"} and len(found) == 4
    assert spark.read.json(str(tmp_path / "topology/devices")).count() == 4
