"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# They must equal the analysed log format.
SYNC_EVENT = "Sync_Pulse"
SEND_EVENT = "UART_Send"
RECEIVE_EVENT = "UART_Receive"
SYNC_PREFIX = "SYNC_"


def is_sync_message(message: str | Column = "message_id") -> Column:
    """A message that belongs to a sync pulse."""
    message = F.col(message) if isinstance(message, str) else message
    return message.startswith(SYNC_PREFIX)


def is_usable_message(message: str | Column = "message_id", numeric: bool = False) -> Column:
    """A message id that is present and not empty. In a column of numbers (`numeric`) zero is no id
    either; among text ids '0' is one like any other."""
    message = F.col(message) if isinstance(message, str) else message
    usable = message.isNotNull() & (message != "")
    return usable & F.coalesce(message.try_cast("double") != 0, F.lit(True)) if numeric else usable


def to_us(nanoseconds: str | Column) -> Column:
    nanoseconds = F.col(nanoseconds) if isinstance(nanoseconds, str) else nanoseconds
    return nanoseconds / F.lit(1000.0)


def per_hop(time: Column, hops: Column) -> Column:
    """Time over hops, 0 where there is no hop (or the hop count is unknown)."""
    return F.when(hops > 0, time / hops).otherwise(F.lit(0.0))


def exact_sum(df: DataFrame, column: str) -> Column:
    """Sum of a time column without rounding: sums of LONG nanoseconds leave the LONG range, so they
    are added as DECIMAL(38, 0)."""
    value = F.col(column)
    return F.sum(value.cast("decimal(38,0)") if df.schema[column].dataType == T.LongType() else value)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
