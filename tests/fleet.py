"""A small log of our own, and helpers of the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from togglelog.functions.columns import RECEIVE_EVENT, SEND_EVENT, SYNC_EVENT

SCHEMA = "event string, time_ns long, toggled boolean, device_id string, position double, message_id string, ord long"


def log_of(spark: SparkSession, rows) -> DataFrame:
    """A log of (event, time, toggled, device, position, message) rows in file order."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], SCHEMA)


# An invented water works: stations in order of appearance, with their positions.
STATIONS = {"west": 2.0, "tank": 7.0, "east": 1.0, "well": 4.0}
# event, station, start, duration, message
EXECUTIONS = [
    ("Fill", "west", 100, 40, None),
    ("Fill", "tank", 130, 55, None),
    ("Fill", "east", 210, 35, None),
    ("Fill", "well", 260, 61, None),
    ("Fill", "west", 400, 44, None),
    ("Drain", "tank", 500, 900, None),
    ("Drain", "east", 520, 730, None),
    ("Sample", "well", 1500, 12, None),
    ("Sample", "well", 1600, 17, None),
    (SEND_EVENT, "west", 2000, 300, "open-valve"),
    (RECEIVE_EVENT, "east", 2140, 25, "open-valve"),
    (RECEIVE_EVENT, "tank", 2410, 31, "open-valve"),
    (RECEIVE_EVENT, "well", 2230, 22, "open-valve"),
    (SEND_EVENT, "tank", 3000, 280, "level"),
    (RECEIVE_EVENT, "west", 3550, 27, "level"),
    (RECEIVE_EVENT, "east", 3720, 24, "level"),
    (SYNC_EVENT, "west", 5000, 9, "SYNC_noon"),
    (SYNC_EVENT, "tank", 5033, 8, "SYNC_noon"),
    (SYNC_EVENT, "well", 5004, 9, "SYNC_noon"),
    (SYNC_EVENT, "east", 9000, 7, "SYNC_dusk"),
    (SYNC_EVENT, "well", 9070, 10, "SYNC_dusk"),
]


def fleet_rows():
    return [
        (event, time, toggled, station, STATIONS[station], message)
        for event, station, start, length, message in EXECUTIONS
        for time, toggled in ((start, True), (start + length, False))
    ]


def durations(*columns: int) -> dict:
    """Durations of the executions, by columns of EXECUTIONS."""
    found: dict = {}
    for row in EXECUTIONS:
        key = tuple(row[c] for c in columns)
        found.setdefault(key[0] if len(key) == 1 else key, []).append(row[3])
    return found


def rows_of(df: DataFrame, *columns: str):
    """The rows as a sorted list of tuples; NULLs sort first."""
    found = df.select(*columns) if columns else df
    return sorted(map(tuple, found.collect()), key=lambda r: [(v is not None, v) for v in r])
