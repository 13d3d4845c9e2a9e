"""The toggle-log data model: one row says "event E on device D went True/False at time T"."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TIMING_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("time_ns", T.LongType()),
        T.StructField("toggled", T.BooleanType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("position", T.DoubleType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)

REQUIRED = ("event", "time_ns", "toggled", "ord")
OPTIONAL = ("device_id", "position", "message_id")

# `ord` is the place of a row in its file. Two rows of one group may carry the same time, so every
# ordered operator sorts by both.
TIME_ORDER = ("time_ns", "ord")


def normalise(df: DataFrame) -> DataFrame:
    """Give a toggle log every model column with its model type; extra columns are kept.

    `time_ns` may stay DOUBLE, for logs with fractional nanoseconds.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    typed = {}
    for field in TIMING_SCHEMA:
        if field.name not in df.columns:
            typed[field.name] = F.lit(None).cast(field.dataType)
            continue
        have = df.schema[field.name].dataType
        if have != field.dataType and not (field.name == "time_ns" and have == T.DoubleType()):
            typed[field.name] = F.col(field.name).cast(field.dataType)
    return df.withColumns(typed) if typed else df
